import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmark.functions import names as N
from gridmark.functions.subsequence import Titles
from gridmark.operators import align


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name,key", [("水環潭(电站)站", "涢水澴潭(电站)"), ("澴水不花园站", "澴水花园"), ("大富水应城(二)站", "大富水应城"), ("涢水安陆", "涢涢水安陆"), (" a－b.c站 ", "abc")])
def test_normal_name(spark, name, key):
    assert one(spark, name, N.normal_name) == key


def test_parsing(spark):
    parts = lambda x: one(spark, x, lambda c: F.array(*N.station_parts(c)))
    assert parts("皇庄_2006_汉江_已校准") == ["皇庄", "2006", "汉江"] and parts("a_1_b_c") == ["a", "1", "b_c"]
    assert one(spark, "page_3_table12_a_b_2006", lambda c: F.array(*N.image_parts(c))) == ["page_3_table12", "a_b", "2006"]
    for make, bad in ((N.station_parts, "a_b"), (N.image_parts, "page_x")):
        with pytest.raises(Exception, match="Unexpected"):
            one(spark, bad, lambda c, make=make: F.array(*make(c)))


def sides(spark, csvs, images):
    return spark.createDataFrame(csvs, "csv_pos long, station_name string, river string, year string"), spark.createDataFrame(images, "image_pos long, title_text string, year string")


def test_scores(spark):
    csvs, images = sides(spark, [(0, "花园", "澴水", "2006")], [(0, "澴水草店站", "2006"), (1, "澴水不花园站", "2006"), (2, "澴水花园站", "2007")])
    score = {r.image_pos: r.score for r in align.match_candidates(csvs, images).collect()}
    assert score == {0: 57.5, 1: 170.0, 2: 0.0}


def test_two_clear_pairs(spark):
    csvs, images = sides(spark, [(0, "花园", "澴水", "2006"), (1, "安陆", "涢水", "2006")], [(0, "澴水不花园站", "2006"), (1, "安陆站", "2006")])
    resolved = align.resolve_matches(csvs, images, 60, 5, 5)
    audit = align.match_audit(resolved, images).first()
    assert audit.confirmed_count == 2 and audit.unmatched_image_count == 0
    with pytest.raises(ValueError, match="No images"):
        align.resolve_matches(csvs, images.limit(0))


def brute(csvs, images):
    """All pairs, scored in plain Python."""

    def key(x):
        x = x.strip()
        for a, b in N.REPLACEMENTS:
            x = x.replace(a, b)
        return x.removesuffix("站").translate(str.maketrans("", "", ",:：，。.-"))

    def sim(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        if a in b or b in a:
            return min(len(a), len(b)) / max(len(a), len(b))
        return SequenceMatcher(None, a, b).ratio()

    out = {}
    for c, station, river, y in csvs:
        for i, title, y2 in images:
            score = 0.0
            if y == y2:
                s, r, t = key(station), key(river), key(title)
                score = 70 * sim(r + s, t) + 45 * sim(s, t) + 25 * sim(r, t)
                score += 30 if r + s == t else 20 if r + s in t else 0
                score += 20 * bool(s and s in t) + 10 * bool(r and r in t) + 5 * t.endswith(s)
            out[c, i] = round(score, 4)
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcxyz") for _ in range(n))
    csvs = [(k, word(rng.randint(0, 3)), word(rng.randint(0, 2)), rng.choice("1234")) for k in range(30)]
    images = [(k, word(rng.randint(1, 6)), rng.choice("12345")) for k in range(25)]
    score = brute(csvs, images)
    left, right = sides(spark, csvs, images)
    top = {(r.csv_pos, r["rank"]): (r.image_pos, pytest.approx(r.score, abs=2e-4)) for r in align.top_candidates(left, right).collect()}
    resolved = {r.csv_pos: r for r in align.resolve_matches(left, right, 60, 5, 5).collect()}
    for c, *_ in csvs:
        ranked = sorted(range(len(images)), key=lambda i: (-score[c, i], i))
        for k in range(3):
            assert top[c, k + 1] == (ranked[k], score[c, ranked[k]])
        best = ranked[0]
        of_image = sorted(range(len(csvs)), key=lambda x: (-score[x, best], x))
        margins = score[c, best] - score[c, ranked[1]], score[c, best] - score[of_image[1], best]
        ok = of_image[0] == c and score[c, best] >= 60 and min(margins) >= 5
        assert (resolved[c].match_status == "confirmed") == ok and resolved[c].image_margin == pytest.approx(margins[1], abs=2e-4)


def test_rows_without_a_year(spark):
    """A label file without a year is still one row; an image without one matches nothing."""
    csvs, images = sides(spark, [(0, "花园", "澴水", None), (1, "花园", "澴水", "2006"), (2, None, None, "2006")], [(0, "澴水花园站", None), (1, "澴水花园站", "2006"), (2, None, "2006")])
    resolved = {r.csv_pos: (r.image_pos, r.score, r.match_status) for r in align.resolve_matches(csvs, images).collect()}
    assert resolved == {0: (0, 0.0, "needs_review"), 1: (1, 170.0, "confirmed"), 2: (2, 35.0, "needs_review")}
    assert align.top_candidates(csvs, images).count() == 9


def test_blocks(spark, monkeypatch):
    """The best of many small blocks are those of all pairs."""
    monkeypatch.setattr(align, "BLOCK", 4)
    test_against_all_pairs(spark)


def test_titles(spark):
    assert one(spark, " 12 a/b：?（x） .", lambda c: N.title_clean(c, F.lit("f"))) == "12a_b：_(x)"
    assert one(spark, "._", lambda c: N.title_clean(c, F.lit("f"))) == "f"
    assert one(spark, "12汉江：逐日平均流量表", lambda c: N.title_prefix(c, "逐日平均流量表")) == "汉江" and one(spark, "x", lambda c: N.title_prefix(c, "流量")) == ""
    assert one(spark, "2006_a", N.year_of_key) == "2006" and one(spark, "a/流量/b", N.expected_keyword) == "逐日平均流量表" and one(spark, "a/b c（），\\", N.stem_clean) == "a_b_c(),_"


def test_copies_and_long_names(spark, monkeypatch):
    """Names that come again, names of several words of bits, and titles in many blocks: the best are those of all pairs."""
    monkeypatch.setattr(align, "BLOCK", 4)
    monkeypatch.setattr(align, "WIDTH", 1)
    monkeypatch.setattr(align, "PAIRS", 8)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab水𠀀 .") for _ in range(n))
    few = [word(n) for n in (0, 1, 2, 3, 5, 8, 70, 140)]
    csvs = [(k, rng.choice(few), rng.choice(few), rng.choice("12")) for k in rng.sample(range(99), 40)]
    images = [(k, rng.choice(few) + rng.choice(few), rng.choice("123")) for k in rng.sample(range(99), 50)]
    score = brute(csvs, images)
    left, right = sides(spark, csvs, images)
    top = {(r.csv_pos, r["rank"]): (r.image_pos, pytest.approx(r.score, abs=2e-4)) for r in align.top_candidates(left, right).collect()}
    resolved = {r.csv_pos: r for r in align.resolve_matches(left, right).collect()}
    assert len(top) == 3 * len(csvs) and len(resolved) == len(csvs)
    for c, *_ in csvs:
        ranked = sorted((i for i, *_ in images), key=lambda i: (-score[c, i], i))
        assert [top[c, k + 1] for k in range(3)] == [(i, score[c, i]) for i in ranked[:3]]
        of_image = sorted((x for x, *_ in csvs), key=lambda x: (-score[x, ranked[0]], x))
        margins = score[c, ranked[0]] - score[c, ranked[1]], score[c, ranked[0]] - score[of_image[1], ranked[0]]
        found = resolved[c]
        assert found.image_pos == ranked[0] and (found.csv_margin, found.image_margin) == pytest.approx(margins, abs=2e-4)
        assert (found.match_status == "confirmed") == (of_image[0] == c and score[c, ranked[0]] >= 95 and min(margins) >= 8)


def test_few_pairs_are_matched(monkeypatch):
    """Titles of the same letters in another order don't reach the sequence matcher, nor do later ones of equal scores."""
    runs = []

    class Counted(SequenceMatcher):
        def ratio(self):
            runs.append(1)
            return super().ratio()

    monkeypatch.setattr(align, "SequenceMatcher", Counted)
    rng = random.Random(3)
    titles = [f"{rng.choice(['oldring', 'hotbolt'])}Supplier" + "".join(rng.sample("0123456", 7)) for _ in range(600)]
    labels = pd.DataFrame({"of_year": "1", "csv_pos": range(40), "station_key": [f"Supplier#{k * 7919:09}" for k in range(40)], "river_key": ""})
    found = align._best_of_cell(3, 0)(labels, pd.DataFrame({"to_year": "1", "image_pos": range(600), "title_key": titles}))
    assert len(found) >= 3 * 40 and len(runs) <= 40 * 30


def test_common_subsequences():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc水𠀀\0") for _ in range(n))
    titles = ["", *[word(rng.randint(0, 90)) for _ in range(30)]]
    keys = ["", "zz", *[word(n) for n in (1, 31, 32, 33, 63, 64, 65, 200)]]
    common = Titles(titles).common(keys)
    for k, key in enumerate(keys):
        for t, title in enumerate(titles):
            assert common[k, t] == plain(key, title) if len(key) <= 64 else plain(key, title) <= common[k, t] <= len(title)


def test_plain_names(spark):
    """ASCII names take a shorter way to the same key."""
    for name in ("\t a_b, c:d-e.f\x1f", "\x1c.x\ty.\n", "", "  ", "(1) page"):
        after = "".join(x for x in name.strip() if x not in " _,:.-")
        assert one(spark, name, N.normal_name) == after and one(spark, name + "水", N.normal_name) == "".join(x for x in (name + "水").strip() if x not in " _,:.-")
    assert one(spark, None, N.normal_name) is None
