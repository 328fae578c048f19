"""Array expressions over per-class probability vectors and padded sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """A1: numerically stable softmax over an array column, linear in its length.

    What a lambda refers to from outside is evaluated again for each element, so the maximum, the
    exponentials and their total are handed on as values: each step maps a one-element array.
    """
    shifted = F.transform(F.array(F.struct(logits.alias("x"), F.array_max(logits).alias("top"))), lambda s: F.transform(
        s["x"], lambda x: F.exp(x - s["top"])))
    scaled = F.transform(shifted, lambda ex: F.struct(ex.alias("ex"), F.aggregate(
        ex, F.lit(0.0), lambda acc, x: acc + x).alias("total")))
    return F.transform(scaled, lambda s: F.transform(s["ex"], lambda x: x / s["total"]))[0]


def outside_prob(probs: Column, n_classes: int | None = None) -> Column:
    """A4: the last class is the outside class 'O'.

    With ``n_classes`` known the element is read by literal index, which the optimizer folds
    when the array is built in the same plan (element_at(..., -1) is not folded).
    """
    if n_classes:
        return probs.getItem(n_classes - 1)
    return F.element_at(probs, -1)


def posexplode_rows(arr: Column, pos: str = "pos", value: str = "value"):
    """posexplode without the inferred ``size(arr) > 0`` filter (which would re-evaluate a derived
    array below the projection); callers drop the null row of empty arrays."""
    return F.posexplode_outer(arr).alias(pos, value)


def argmax_entity(probs: Column) -> Column:
    """A5: 0-based id of the best non-outside class; ties go to the lowest id."""
    head = F.slice(probs, 1, F.size(probs) - 1)
    return F.array_position(head, F.array_max(head)) - F.lit(1)


def pad_to(arr: Column, length: Column, value) -> Column:
    """Right-pad an array with ``value`` up to ``length``."""
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0))))


def round_up(x: Column, multiple: int) -> Column:
    return (F.ceil(x / F.lit(float(multiple))) * F.lit(multiple)).cast("int")


def round_half_away(x, digits: int):
    """Round a double to ``digits`` decimals, half away from zero, on the binary value:
    sign(x) * R(|x| * 10^d) / 10^d with R(y) = floor(y) + (y - floor(y) >= 0.5) = (floor(2 y) + 1) div 2.

    Pure arithmetic (whole-stage codegen), unlike ``round`` which builds a BigDecimal per
    value; 2 y is exact, so R equals C's round() and results agree with engines that
    round that way. From 2^52 on a scaled double has no fraction left and the value is returned as it is, like NaN
    and null, for which the comparison is not true. Short on purpose: 13 of these share one generated method,
    which HotSpot compiles below 8000 bytes only.
    """
    x = F.col(x) if isinstance(x, str) else x
    m = float(10 ** digits)
    y2 = F.abs(x) * F.lit(2.0 * m)
    r = F.shiftright(F.floor(y2) + F.lit(1).cast("long"), 1).cast("double")
    return F.when(y2 < F.lit(2.0 ** 53), F.signum(x) * r / F.lit(m)).otherwise(x)
