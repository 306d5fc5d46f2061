"""Small corpora and plain-Python versions of the operators."""

import random
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [a + b for a in ("ka", "no", "ti", "rés", "lo", "Mu", "日") for b in ("ra", "b", "sen", "", "xx", "o")]


def words(text):
    return WORD.findall((text or "").translate(UP))


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus(seed=1, n=120):
    """(doc_id, text, source): random texts with exact copies, near copies, repeated lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows, texts = [], []
    shared = [sentence(rng, 12) for _ in range(4)]
    for k in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)
        elif texts and kind < 0.45:
            parts = rng.choice(texts).split(" ")
            parts[rng.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        else:
            text = "\n".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5)))
            if rng.random() < 0.4:
                text += "\n" + rng.choice(shared)
        texts.append(text)
        rows.append((k * 3, text, f"src{min(3, rng.randrange(8))}"))
    rows += [(9001, None, "src0"), (9002, "", None), (9003, " \n ", "src1"), (9004, sentence(rng, 20000), "src2"), (9005, "ABC", "src1"), (9006, "abc", "src1")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows):
    """With columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    clash = ("h", "n", "kept", "rep", "key", "slot", "rank", "label", "sid", "place", "score", "block")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(None).cast("string") for c in clash})


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
