"""Names of stations, rivers and page titles: parsing, normal forms, similarity."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from gridmark.functions.text import BLANK, col, strip

#: Fixed values, applied in this order.
REPLACEMENTS = (
    ("（", "("),
    ("）", ")"),
    (" ", ""),
    ("　", ""),
    ("_", ""),
    ("－", "-"),
    ("環", "澴"),
    ("不花园", "花园"),
    ("月万福闸", "万福闸"),
    ("涢水安陆", "涢水安陆"),
    ("水安陆", "涢水安陆"),
    ("水澴潭", "涢水澴潭"),
    ("水環潭", "涢水澴潭"),
    ("温水随州", "涢水随州"),
    ("溫水随州", "涢水随州"),
)
#: Names of files and of the keywords in titles.
ASCII_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
CALIBRATED = "_已校准"
IMAGE_STEM = r"^(page_[0-9]+_table[0-9]+)_(.+)_([0-9]{4})$"
FLOW, LEVEL = ("流量", "逐日平均流量表"), ("水位", "逐日平均水位表")


def normal_name(c: Column | str) -> Column:
    """Replacements in order, then without a last 站, ordinals in brackets and punctuation."""
    c = col(c)
    # Of all these, plain ASCII has only marks that are left out.
    plain = F.translate(F.btrim(c, F.lit(ASCII_BLANK)), " _,:.-", "")
    text = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), REPLACEMENTS, strip(c))
    text = F.regexp_replace(text, "站$", "")
    text = F.regexp_replace(text, r"\([一二三四五六七八九十]+\)", "")
    return F.when(F.char_length(c) == F.octet_length(c), plain).otherwise(F.regexp_replace(text, r"[,:：，。.\-]", ""))


def title_key(c: Column | str) -> Column:
    return F.regexp_replace(normal_name(c), r"^page\p{Nd}+table\p{Nd}+", "")


def _or_raise(ok: Column, value: Column, message: str, what: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), what)))


def station_parts(stem: Column | str) -> list[Column]:
    """station, year and river of a file stem ``station_year_river``, with or without the suffix of calibrated files."""
    stem = col(stem)
    parts = F.split(F.regexp_replace(stem, f"{CALIBRATED}$", ""), "_", -1)
    ok = F.size(parts) >= 3
    river = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return [_or_raise(ok, x, "Unexpected station filename", stem) for x in (F.get(parts, 0), F.get(parts, 1), river)]


def image_parts(stem: Column | str) -> list[Column]:
    """stable name, title text and year of an image's file stem."""
    stem = col(stem)
    return [_or_raise(stem.rlike(IMAGE_STEM), F.regexp_extract(stem, IMAGE_STEM, k), "Unexpected image filename", stem) for k in (1, 2, 3)]


def easy_similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, the share of lengths if one contains the other; else null."""
    la, lb = F.char_length(a), F.char_length(b)
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, F.least(la, lb) / F.greatest(la, lb))


@F.pandas_udf(DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def round4(x: pd.Series) -> pd.Series:
    """Four digits by the exact binary value, half to even."""
    return x.map(lambda v: None if v is None or v != v else round(v, 4)).astype("float64")


def stem_clean(c: Column | str) -> Column:
    return F.translate(col(c), "/\\ （），", "___(),")


def title_clean(title: Column | str, fallback: Column | str, limit: int = 100) -> Column:
    text = F.translate(strip(title), "（）", "()")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", ""), r'[\\/:*?"<>|]', "_"), "_+", "_")
    text = F.regexp_replace(text, r"^[._]+|[._]+$", "")
    return F.left(F.when(text == "", col(fallback)).otherwise(text), F.lit(limit))


def title_prefix(title: Column | str, keyword: str) -> Column:
    """What stands before the keyword, without digits at its start and punctuation around it; empty where it is missing."""
    title = col(title)
    at = F.instr(title, keyword)
    head = F.regexp_replace(F.left(title, F.greatest(at - 1, F.lit(0))), r"^\p{Nd}+", "")
    return F.when(at > 0, strip(F.regexp_replace(head, r"^[ _\-:：,，.。]+|[ _\-:：,，.。]+$", ""))).otherwise("")


def year_of_key(key: Column | str) -> Column:
    key = col(key)
    return _or_raise(key.rlike(r"^\p{Nd}{4}_"), F.left(key, F.lit(4)), "Unable to extract year from output folder key", key)


def expected_keyword(path: Column | str) -> Column:
    path = col(path)
    error = F.raise_error(F.concat(F.lit("Unable to infer expected title keyword from path: "), path))
    return F.when(F.contains(path, F.lit(FLOW[0])), FLOW[1]).when(F.contains(path, F.lit(LEVEL[0])), LEVEL[1]).otherwise(error)
