import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmark.llm import rule_ensemble as R
from gridmark.llm.hashing import joined, raw, words as hashed_words
from gridmark.llm.lm_score import lm_scores
from gridmark.llm.source_mix import mix_sources, mixed_rows
from gridmark.llm.text_stats import NAMES, statistics
from gridmark.llm.topk_search import top_k
from tests.llm.helpers import corpus, frame, words


def test_words_are_those_of_the_pattern():
    texts = [t or "" for _, t, _ in corpus()] + ["", " ", "a\x0bb\x0cc\xa0d　e", "a" * 3_000_000 + " b"]
    found = hashed_words(*raw(pa.array(texts, pa.large_string())))
    known = {}
    for k, text in enumerate(texts):
        own = found.hashes[found.first[k] : found.first[k + 1]].tolist()
        expected = words(text)
        assert len(own) == len(expected)
        for h, w in zip(own, expected, strict=True):
            assert known.setdefault(h, w) == w
    assert len(set(known.values())) == len(known)
    assert len(joined(found.hashes[:3], 4)) == 0 and joined(found.hashes[:4], 4).shape == (1,)


def brute_scores(rows, order, least=2):
    counts, total = Counter(), 0
    for _, text, _ in rows:
        w = words(text)
        total += len(w)
        counts.update(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    out = []
    for i, text, _ in rows:
        w, score = words(text), 0.0
        for k in range(len(w)):
            s = counts[w[k],] / total
            for n in range(2, min(order, k + 1) + 1):
                c = counts[tuple(w[k - n + 1 : k + 1])]
                s = c / counts[tuple(w[k - n + 1 : k])] if c >= least else 0.4 * s
            score += math.log10(s)
        out.append((i, len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order):
    rows = corpus(6, 60) + [(77, "same words again here", "s")] * 2 + [(None, "no id", None)]
    found = lm_scores(frame(spark, rows), order).collect()
    plain = sorted((i if i is not None else -1, n, pytest.approx(s)) for i, n, s in brute_scores(rows, order))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.log10_score) for r in found) == plain
    assert all((r.mean_log10 is None) == (r.n_words == 0) for r in found)
    assert lm_scores(frame(spark, rows).limit(0), order).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "'x' AS rank", "'y' AS v")


def brute_top(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(ok, reverse=True)}.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale,k", [(1.0, 5), (0.01, 3), (1e6, 5)])
def test_top_k(spark, scale, k):
    rng = random.Random(3)
    rows = [(n, [rng.uniform(-1, 1) * scale for _ in range(4)]) for n in range(150)]
    rows += [(200 + n, rows[7][1]) for n in range(40)] + [(300, [0.0] * 4), (301, None), (302, [None, 1.0, 1.0, 1.0]), (303, [math.nan] * 4), (304, [math.inf] * 4), (None, [1.0] * 4), (305, [scale]), (3, rows[3][1])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k).collect())
    assert found == brute_top(rows, k)


def test_top_k_in_blocks(spark):
    rng = random.Random(5)
    rows = [(n * 10, [rng.uniform(-1, 1) for _ in range(3)]) for n in range(120)]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, 4, block=7).collect())
    assert found == brute_top(rows, 4)


def test_top_k_of_few(spark):
    for rows in ([], [(0, [1.0])], [(1, [1.0])], [(0, [1.0]), (1, [2.0])], [(0, [])]):
        found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()]
        assert found == brute_top(rows, 5)


@pytest.mark.parametrize("weights,block", [(None, 4), ({"src0": 5, "src1": 2.5, "src3": 1}, 3), (None, 1)])
def test_mix(spark, weights, block):
    rows = corpus(7, 200) + [(9100 + k, "t", "hot") for k in range(120)]
    found = mix_sources(frame(spark, rows), weights=weights, block=block, period=50).toPandas()
    found["src"] = found["source"].fillna("none")
    per_block = found.drop_duplicates(["src", "block"]).sort_values("slot")
    slots = per_block["slot"].tolist()
    assert slots == list(range(len(slots)))
    assert (per_block["release"] <= per_block["slot"]).all() and (per_block["slot"] < per_block["deadline"]).all()
    shares = {s: len(g) for s, g in per_block.groupby("src")}
    if weights is None:
        assert set(found["doc_id"]) == {r[0] for r in rows}
    else:
        assert set(shares) == set(weights)
        for s, w in weights.items():
            share = max(1, round(w / 8.5 * 50))
            whole = sum(max(1, round(x / 8.5 * 50)) for x in weights.values())
            had = (per_block["src"] == s).cumsum().tolist()
            assert all(abs(n - (t + 1) * share / whole) < 1 for t, n in enumerate(had))
    assert found.groupby(["src", "block"])["doc_id"].count().max() <= block and found["position"].is_unique
    epochs = found.groupby(["src", "epoch"])["doc_id"].agg(["count", "nunique"])
    assert (epochs["count"] == epochs["nunique"]).all()


def test_mix_odd_tables(spark):
    rows = corpus(7, 20)
    docs = frame(spark, rows)
    assert mix_sources(docs.limit(0)).count() == 0
    mixed = mixed_rows(docs, block=2)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r[0] for r in rows}
    repeated = frame(spark, [(1, "a", None), (1, "a", None), (None, None, None)])
    assert mix_sources(repeated).count() == 3


def test_schedule_of_a_thousand_sources(spark):
    """Every block inside its window, and as a plain earliest-deadline-first run gives it."""
    import time
    from fractions import Fraction

    from gridmark.llm.source_mix import schedule

    rng = random.Random(1)
    shares = [(f"s{k:04}", rng.choice([1, 1, 1, 2, 5])) for k in range(1000)]
    began = time.time()
    found = schedule(spark.createDataFrame(shares, "src string, a int")).collect()
    assert time.time() - began < 120
    period, had, slots = sum(a for _, a in shares), dict.fromkeys((s for s, _ in shares), 0), {}
    for t in range(period):
        due = [(math.ceil(Fraction((had[s] + 1) * period, a)), s) for s, a in shares if had[s] < a and had[s] * period // a <= t]
        chosen = min(due)[1]
        slots[t] = (chosen, had[chosen])
        had[chosen] += 1
    assert {r.slot: (r.src, r.turn) for r in found} == slots


def test_mix_of_rows_without_ids(spark):
    """Rows that share an id, or have none, are dealt over buckets, and each is placed once an epoch."""
    rows = [(None, f"t{k}", "a") for k in range(300)] + [(7, f"u{k}", "a") for k in range(200)] + [(k, "v", "b") for k in range(30)]
    mixed = mixed_rows(frame(spark, rows), crowd=2, block=8)
    found = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(found) == {r[:2] for r in rows} and all(found[r[:2]] == 1 for r in rows if r[2] == "a")


def labelled(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["kara", "nosen", "tib", "lo", "muxx"]) + ("" if good else "###") for _ in range(rng.randint(20, 60)))
        rows.append((k, text, "s"))
        labels.append((k, int(good), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(spark)
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "x", "s")]
    odd = labels + [(5000, 7, 0), (None, 1, 0), (99999, 1, 0)]
    table = spark.createDataFrame(odd, "doc_id long, quality int, toxic int")
    found = R.quality(frame(spark, rows), table).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert len(held) > 50 and np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.98
    kept = R.keep_good(frame(spark, rows), table)
    assert kept.columns == frame(spark, rows).columns and 250 < kept.count() < 320


def test_keep_good_of_rows_that_share_an_id(spark):
    rows, labels = labelled(spark, 300)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    predicted = {r.doc_id: r.predicted for r in R.quality(frame(spark, rows), table).collect()}
    bad, good = (next(r for r in rows if r[0] is not None and r[1] and predicted[r[0]] == k) for k in (0, 1))
    shared = [(None, bad[1], "odd"), (None, good[1], "odd"), (90001, bad[1], "odd"), (90001, good[1], "odd")]
    kept = [(r.doc_id, r.text) for r in R.keep_good(frame(spark, rows + shared), table).filter("source = 'odd'").collect()]
    assert sorted(kept, key=str) == sorted([(None, good[1]), (90001, good[1])], key=str)


def test_quality_of_repeated_ids_and_clashing_columns(spark):
    """An id with several texts or labels is one row of the sample, the same one however the rows are spread."""
    rows, labels = labelled(spark, 120)
    rows += [(i, "### ### 123", "s") for i, _, _ in rows[:40]]
    table = spark.createDataFrame(labels + [(i, 1 - q, 0) for i, q, _ in labels[:20]], "doc_id long, quality int, toxic int")
    clash = ("__bad", "__labelled", "labelled", "y", "s", "text2", "row_key", "gone", "id", "row")
    docs = frame(spark, rows).drop("key").selectExpr("*", "1 AS key", *[f"'x' AS `{c}`" for c in clash])
    first = {(r.doc_id, r.score) for r in R.quality(docs, table).collect()}
    assert first == {(r.doc_id, r.score) for r in R.quality(docs.repartition(5, "text"), table.repartition(2)).collect()}
    kept = R.keep_good(docs, table)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = labelled(spark, 200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    make = lambda ls: sorted((r.doc_id, r.score) for r in R.quality(frame(spark, rows), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    assert make(labels) == make(flipped)


def test_few_labels(spark):
    rows, labels = labelled(spark, 30)
    docs = frame(spark, rows)
    for some in ([], [(1, 1, 0)], [x for x in labels if x[1] == 1]):
        found = R.quality(docs, spark.createDataFrame(some, "doc_id long, quality int, toxic int")).collect()
        assert len({r.score for r in found}) == 1
    assert R.quality(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_rules_as_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(NAMES)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    rules = R.fit(x, y)
    assert np.mean((rules.score(x) > 0.5) == y) > 0.97 and len(rules.weighted) < 120
    stats = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(NAMES))
    assert [r.s for r in stats.select(rules.column().alias("s")).collect()] == pytest.approx(rules.score(x[:50]).tolist())


def test_statistics():
    rows = statistics(pa.array(["", "Ab cd!! ab", "x\nx\ny z", "a b c a b c a b c"], pa.large_string()))
    column = dict(zip(NAMES, rows.T, strict=True))
    assert column["n_words"].tolist() == [0, 3, 4, 9] and column["upper"][1] == pytest.approx(1 / 6) and column["exclaim"][1] == pytest.approx(0.2)
    assert column["again_lines"][2] == pytest.approx(1 / 3) and column["distinct_words"][3] == pytest.approx(1 / 3) and column["again_grams"][3] == pytest.approx(1 - 3 / 7)
    assert not rows[0].any()
