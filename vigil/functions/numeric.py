"""Numeric functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sigmoid(x: ColumnOrName) -> Column:
    """logistic function clamped to exactly 0 / 1 beyond +-50."""
    v = _c(x).cast("double")
    return (F.when(v < -50, F.lit(0.0))
            .when(v > 50, F.lit(1.0))
            .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-v))))


def clamp_scale(v: ColumnOrName, cap: float) -> Column:
    """``min(v, cap) / cap``."""
    return F.least(_c(v).cast("double"), F.lit(float(cap))) / F.lit(float(cap))


def l2_norm(vec: ColumnOrName) -> Column:
    """Euclidean norm of an array column (0 for an empty/null array)."""
    return F.sqrt(F.aggregate(F.coalesce(_c(vec).cast("array<double>"), F.array().cast("array<double>")),
                              F.lit(0.0), lambda acc, x: acc + x * x))


def softmax3(e0: ColumnOrName, e1: ColumnOrName, e2: ColumnOrName) -> Column:
    """max-shifted softmax of three energies; all-zero energies give 1/3 each.

    Returns ARRAY<DOUBLE> of length 3.
    """
    a, b, c = _c(e0).cast("double"), _c(e1).cast("double"), _c(e2).cast("double")
    top = F.greatest(a, b, c)
    xa, xb, xc = F.exp(a - top), F.exp(b - top), F.exp(c - top)
    total = xa + xb + xc
    third = F.lit(1.0 / 3.0)
    all_zero = (a == 0) & (b == 0) & (c == 0)
    return F.when(all_zero, F.array(third, third, third)).otherwise(
        F.array(xa / total, xb / total, xc / total))


def round_prob(p: ColumnOrName, digits: int = 4) -> Column:
    """round half-up to ``digits`` decimals."""
    return F.round(_c(p), digits)
