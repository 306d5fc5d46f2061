"""Text functions against Python's own."""

import random

from pyspark.sql import functions as F

from gridmark.functions import text as T

ODD = ["a", "é", "1", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "　", " ", " ", " ", " ", ",", "_"]


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def samples(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_strip(spark):
    assert column(spark, samples(), T.strip) == [x.strip() for x in samples()]


def test_lines(spark):
    assert column(spark, samples(), T.lines) == [x.splitlines() for x in samples()]


def is_float(x):
    try:
        float(x.strip())
        return True
    except ValueError:
        return False


def test_is_number(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("0129.eE+-_ xdfnai１ \t") for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    values += ["1_000", "1__0", "_1", "1_", "1e5", "1e", ".5", "5.", ".", "nan", "-inf", "+Infinity", "infinit", "0x1p3", "1d", "1f", "１２", "1_0.0_1e1_0"]
    assert column(spark, values, T.is_number) == [is_float(x) for x in values]


def test_sample_id_and_labels(spark):
    import hashlib

    values = ["皇庄_2006_汉江_已校准", "flow_v0_00001", ""]
    assert column(spark, values, T.sample_id) == ["flow_" + hashlib.sha1(x.encode()).hexdigest()[:12] for x in values]
    assert column(spark, ["a b/c", "__x__", "base-1", "模型 1"], T.safe_label) == ["a_b_c", "x", "base-1", "模型_1"]


def test_pretty_latex(spark):
    dense = "\\begin{tabular}{|c|}\\hline 1 & 2 \\\\ \\hline\r\n\r\n3 & 4 \\\\\r\\end{tabular}"
    assert column(spark, [dense], T.pretty_latex) == ["\\begin{tabular}{|c|}\n\\hline\n1 & 2 \\\\\n\\hline\n3 & 4 \\\\\n\\end{tabular}\n"]
    assert column(spark, ["no table \r\n \n"], T.pretty_latex) == ["no table\n"]


def test_clip(spark):
    assert column(spark, ["x" * 500, "x" * 501], T.clip) == ["x" * 500, "x" * 500 + "\n..."]
