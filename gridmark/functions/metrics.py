"""Scores of a predicted grid against a target grid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridmark.functions.grid import cell_count, is_proper_prefix, plain_text, same_shape
from gridmark.functions.text import col

CHAR_WEIGHT, CELL_WEIGHT = 0.3, 0.7
SLICES = ("front_25", "middle_50", "back_25")


def edit_distance(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


def char_accuracy(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.lit(1.0) - edit_distance(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def matching_cells(a: Column, b: Column) -> Column:
    """Equal cells of two grids of one shape."""
    return F.aggregate(F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def cell_accuracy(predicted: Column | str, target: Column | str) -> Column:
    predicted, target = col(predicted), col(target)
    share = matching_cells(predicted, target) / F.greatest(cell_count(target), F.lit(1))
    return F.when(F.coalesce(same_shape(predicted, target), F.lit(False)), share.cast("double")).otherwise(F.lit(0.0))


def error_type(predicted: Column | str, target: Column | str) -> Column:
    """An equal grid counts as value_error: there is no class of its own."""
    predicted = col(predicted)
    return (
        F.when(predicted.isNull(), "structure_error")
        .when(is_proper_prefix(predicted, target), "truncation")
        .when(~same_shape(predicted, target), "structure_error")
        .otherwise("value_error")
    )


def slice_bounds(n: Column) -> list[tuple[Column, Column]]:
    """First and end row of the front, middle and back of n rows."""
    front = F.greatest(F.lit(1), F.bround(n * F.lit(0.25)).cast("int"))
    back = F.least(n, F.greatest(front, F.bround(n * F.lit(0.75)).cast("int")))
    return [(F.lit(0), front), (front, back), (back, n)]


def slice_scores(predicted: Column | str, target: Column | str) -> list[Column]:
    """Cell accuracy of each of SLICES; a predicted grid that ends before a slice does scores 0 there."""
    predicted, target = col(predicted), col(target)
    out = []
    for start, end in slice_bounds(F.size(target)):
        wanted = F.slice(target, start + 1, F.greatest(end - start, F.lit(0)))
        given = F.slice(predicted, start + 1, F.greatest(end - start, F.lit(0)))
        there = predicted.isNotNull() & (F.size(predicted) > 0) & (F.size(predicted) >= end) & (F.size(wanted) > 0)
        out.append(F.when(there, cell_accuracy(given, wanted)).otherwise(F.lit(0.0)))
    return out


def compared_text_accuracy(prediction: Column | str, target_text: Column | str, predicted: Column | str, target: Column | str) -> Column:
    """Character accuracy of the grids' texts, or of the raw texts where the prediction has no grid."""
    parsed = col(predicted).isNotNull()
    a = F.when(parsed, plain_text(predicted)).otherwise(col(prediction))
    b = F.when(parsed, plain_text(target)).otherwise(col(target_text))
    return char_accuracy(a, b)
