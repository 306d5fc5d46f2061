"""Text functions that follow Python's rules for white space, lines and numbers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What str.strip() removes and where str.splitlines() breaks, as Java classes.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"
#: Fixed value: what float() accepts after stripping.
_D = r"\p{Nd}(?:_?\p{Nd})*"
NUMBER = rf"^[+-]?(?:(?i:inf|infinity|nan)|(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{BLANK}+|{BLANK}+$", "")


def lines(c: Column | str) -> Column:
    """The lines of a text; a break at its end doesn't begin another line."""
    return let(F.split(col(c), BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def newlines(c: Column | str) -> Column:
    """Line ends of all kinds as \\n."""
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def is_number(c: Column | str) -> Column:
    return strip(c).rlike(NUMBER)


def clip(c: Column | str, limit: int = 500) -> Column:
    c = col(c)
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("\n..."))).otherwise(c)


def sample_id(name: Column | str) -> Column:
    return F.concat(F.lit("flow_"), F.substring(F.sha1(F.encode(col(name), "UTF-8")), 1, 12))


def safe_label(c: Column | str) -> Column:
    """Letters, digits, - and _ as they are, others as _, without _ at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")


def pretty_latex(c: Column | str) -> Column:
    """A LaTeX table with rules on lines of their own and no blank lines; other text without space at its end."""
    apart = F.replace(newlines(c), F.lit("\\hline"), F.lit("\n\\hline\n"))
    kept = F.filter(F.transform(F.split(apart, "\n", -1), strip), lambda x: x != "")
    table = F.concat(F.array_join(kept, "\n"), F.lit("\n"))
    other = F.concat(F.regexp_replace(newlines(c), f"{BLANK}+$", ""), F.lit("\n"))
    return F.when(F.contains(col(c), F.lit("\\begin{tabular}")), table).otherwise(other)


def format_score(c: Column | str) -> Column:
    return F.format_string("%.4f", col(c))
