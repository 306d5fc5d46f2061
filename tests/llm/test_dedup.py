import hashlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridmark.llm.common import Scratch
from gridmark.llm.components import connected_components
from gridmark.llm.exact_dedup import exact_dedup, keep_one
from gridmark.llm.line_dedup import dropped_lines, line_dedup, within_one
from gridmark.llm.near_dedup import keep_firsts, near_duplicates
from tests.llm.helpers import UP, components, corpus, frame, words


def expected_exact(rows, pick):
    groups = {}
    for i, text, _ in rows:
        groups.setdefault((text or "").translate(UP), []).append(i)
    out = {}
    for text, ids in groups.items():
        for i in ids:
            out[i] = (pick(ids), len(ids), i == pick(ids), hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact(spark, keep, pick):
    rows = corpus()
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, rows), keep=keep).collect()}
    assert found == expected_exact(rows, pick)


def test_exact_with_collisions(spark):
    rows = corpus(2, 60)
    weak = exact_dedup(frame(spark, rows), keep="largest", hash_of=lambda c: F.substring(F.md5(c), 1, 1))
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in weak.collect()} == expected_exact(rows, max)


def test_exact_odd_rows(spark):
    rows = [(None, "a", "s"), (None, "A", "s"), (1, "a", "s"), (1, "a", "s"), (None, "b", None)]
    found = sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows), keep="largest").collect() if r.group_size > 1)
    assert found == [(False, 1, 4, True), (False, 1, 4, True), (True, 1, 4, False), (True, 1, 4, False)]
    empty = frame(spark, rows).limit(0)
    assert exact_dedup(empty).count() == 0 and keep_one(empty).columns == empty.columns
    with pytest.raises(ValueError):
        exact_dedup(empty, keep="first")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_keep_one_of_rows_that_share_an_id(spark, keep):
    rows = [(None, "a", "s"), (1, "A", "s"), (2, "a", "s"), (None, "only", "s"), (2, "other", "s"), (1, "another", "s"), (None, None, "s")]
    lost = {(None, "a"), (1, "A")} if keep == "largest" else {(1, "A"), (2, "a")}
    assert {(r.doc_id, r.text) for r in keep_one(frame(spark, rows), keep=keep).collect()} == {r[:2] for r in rows} - lost


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_near(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    linked = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, components(sets, linked)


def test_near(spark):
    rows = corpus(3, 150)
    sets, least = expected_near(rows)
    found = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}
    assert len(found) == len(rows) and sum(r.kept for r in found) < len(rows)


def test_near_family(spark):
    """Many copies of one text with one to four edits each: links run in chains, and no pair list of the family is needed."""
    import random

    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((1000 - k, " ".join(text), "s"))
    sets, least = expected_near(rows)
    found = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert found == least and len(set(least.values())) > 1


def test_near_odd_rows(spark):
    long = "a b c d e f g h i j"
    rows = [(5, long, "s"), (5, long, "s"), (None, long.upper(), "s"), (7, "A b", "s"), (8, "a  b", "s"), (9, None, "s"), (9, "x y", "s"), (3, "x y", "s"), (None, None, None)]
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert found == [(0, 0, 0, False), (0, 6, 5, False), (3, 1, 3, True), (5, 6, 5, True), (5, 6, 5, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (9, 1, 3, False)]
    empty = frame(spark, rows).limit(0)
    assert near_duplicates(empty).count() == 0 and keep_firsts(frame(spark, rows)).columns == empty.columns


def clashing(spark, rows):
    """Columns whose names could be those of a step in between."""
    names = ("row", "id", "key", "__gone", "__gone_key", "__key", "__bad", "__labelled", "labelled", "gone", "first", "score", "r", "g")
    return frame(spark, rows).select("*").drop("key", "score").selectExpr("*", *[f"'x' AS `{c}`" for c in names])


def test_keep_firsts_of_rows_that_share_an_id(spark):
    w = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, w, "s"), (5, w.upper(), "s"), (5, "other words", "s"), (5, "and more of them", "s"), (7, w + " end", "s"), (7, "only here", "s"), (None, w, "s"), (None, "no id", "s"), (9, w, "s"), (9, None, None), (9, "third text", "s")]
    docs = clashing(spark, rows)
    kept = keep_firsts(docs)
    lost = {(5, w.upper()), (7, w + " end"), (9, w)}
    assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(r[:2]) for r in rows if r[:2] not in lost)
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(frame(spark, rows[:6])).collect()}
    assert found == {(1, 22): (1, True), (5, 22): (1, False), (5, 1): (5, True), (7, 23): (1, False), (7, 1): (7, True)}


def test_keep_firsts_of_near_rows_with_one_id(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(2**62 + 5, " ".join(w), "s"), (2**62 + 5, " ".join(w[:-1]), "s"), (-4, " ".join(w[:-2]), "s"), (-4, "x", "s"), (-4, "y", "s")]
    kept = {(r.doc_id, r.text) for r in keep_firsts(frame(spark, rows)).collect()}
    assert kept == {(-4, " ".join(w[:-2])), (-4, "x"), (-4, "y")}
    assert len(keep_firsts(frame(spark, rows[:2])).collect()) == 1


def test_keep_one_with_clashing_columns(spark):
    rows = [(5, "A", "s"), (7, "a", "s"), (5, "B", "s"), (None, "a", "s"), (None, "b", "s"), (None, "C", "s")]
    docs = clashing(spark, rows)
    kept = keep_one(docs, keep="largest")
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(7, "a"), (5, "B"), (None, "C")}


def test_near_in_rounds_of_many_centres(spark):
    """A family whose pairs mostly do not link, listed in small parts: the same components as at once, and as by brute force."""
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(50):
        text = list(base)
        for _ in range(rng.choice([1, 2, 6])):
            text[rng.randrange(100)] = f"x{rng.randrange(6)}"
        rows.append((k, " ".join(text), "s"))
    _, least = expected_near(rows)
    assert len(set(least.values())) > 5
    found = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), rounds=1, exact=True, budget=3000).collect()}
    assert found == least


def test_components_of_a_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))
    found = {r.node: r.label for r in connected_components(links, Scratch(spark, "test"), "x").collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


COARSE = {"min_words": 4, "near_words": 8, "near_chars": None}


def expected_lines(rows, min_words=4, near_words=8):
    lines = sorted((i, k, tuple((line.lower()).split())) for i, t, _ in rows if i is not None and t is not None for k, line in enumerate(t.encode().split(b"\n")))
    first, gone = {}, set()
    for i, k, w in lines:
        if len(w) >= min_words:
            if any(v == w or len(v) >= near_words and len(w) >= near_words and within_one(list(v), list(w)) for v in first):
                gone.add((i, k))
            first.setdefault(w, (i, k))
    return gone


def test_lines(spark):
    rows = corpus(5, 120)
    gone = expected_lines(rows)
    docs = frame(spark, rows)
    assert {tuple(r) for r in dropped_lines(docs, **COARSE).collect()} == gone and len(gone) > 20
    texts = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(docs, **COARSE).collect()}
    for i, text, _ in rows:
        kept = [x for k, x in enumerate((text or "").split("\n")) if (i, k) not in gone]
        assert texts[i] == (None if text is None else "\n".join(kept), sum(g[0] == i for g in gone))


def test_lines_one_edit_apart(spark):
    base = [f"w{k}" for k in range(9)]
    edits = [base, base[:4] + ["z"] + base[5:], base[:-1], ["y", *base], base[:3] + base[5:], base[::-1]]
    rows = [(k, "Keep.\n" + " ".join(e), "s") for k, e in enumerate(edits)]
    assert {tuple(r) for r in dropped_lines(frame(spark, rows), **COARSE).collect()} == {(1, 1), (2, 1), (3, 1)} == expected_lines(rows)


def test_lines_of_wide_ids(spark):
    rows = [(2**62, "a b c d e f g h", "s"), (-(2**62), "a b c d e f g x", "s"), (None, "a b c d e f g h", "s"), (5, None, "s"), (6, "", "s")]
    assert {tuple(r) for r in dropped_lines(frame(spark, rows)).collect()} == {(2**62, 0)}
    assert line_dedup(frame(spark, rows)).count() == 5 and line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_lines_without_cut_offs(spark):
    """Every line that isn't blank; near ones by words from 4 words on, by characters below that from 16 characters on."""
    url, han = "https://example.org/a/long/path?x=", "流量表与水位表的逐日平均值和年统计数据说明"
    odd = ["All rights reserved.", "ALL rights  reserved.", "", " ", "wh the.", "wh tho.", url + "1", url + "2", url + "345", han, han[:5] + han[6:], han[::-1], "a b c d", "a b x d", "a b c", "a b y", "short", "shore"]
    rows = corpus(6, 80) + [(20000 + k, "\n".join([odd[k], odd[-1 - k], "Keep."]), "s") for k in range(len(odd))]
    lines = sorted((i, k, tuple(line.lower().split())) for i, t, _ in rows if i is not None and t is not None for k, line in enumerate(t.encode().split(b"\n")))
    first, gone = {}, set()
    for i, k, w in lines:
        text = b" ".join(w).decode()
        mode = "words" if len(w) >= 4 else "chars" if len(text) >= 16 else None
        parts = list(w) if mode == "words" else list(text)
        if w and (w in first or any(mode and m == mode and within_one(p, parts) for m, p in first.values())):
            gone.add((i, k))
        if w:
            first.setdefault(w, (mode, parts))
    assert {tuple(r) for r in dropped_lines(frame(spark, rows)).collect()} == gone
    assert len(gone - expected_lines(rows)) > 40


def test_within_one():
    import random

    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 6))] for _ in range(2))
        assert within_one(a, b) == (distance(a, b) <= 1)
