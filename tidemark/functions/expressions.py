"""Column expressions that the operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def d(x: float) -> Column:
    return F.lit(float(x))


def trimmed(c: str | Column) -> Column:
    """Trimmed text; the literal nan counts as missing."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(F.lower(t) != "nan", t)


def number(c: str) -> Column:
    """A lenient double: null for what isn't a number, and for NaN."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_0(c: str) -> Column:
    return F.coalesce(number(c), d(0))


def whole_or_0(c: str) -> Column:
    return number_or_0(c).cast("bigint")


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def namespaced(channel: str, c: str) -> Column:
    return F.concat_ws("_", F.lit(channel), F.trim(F.col(c)))


def first_part(c: str) -> Column:
    """The text before the first underscore; unknown for null and empty text."""
    return F.when(F.col(c).isNull() | (F.col(c) == ""), "unknown").otherwise(F.substring_index(F.col(c), "_", 1))


def guarded(num: str, den: str) -> Column:
    """num / den where den is over 1e-10, else 0. A null numerator stays null."""
    return F.when(F.col(den) > d(TINY), F.col(num).cast("double") / F.col(den)).otherwise(d(0))


def clamped(c: str) -> Column:
    """At least 0; null stays null."""
    return F.when(F.col(c) < 0, d(0)).otherwise(F.col(c))


def width() -> Column:
    return F.col("p90") - F.col("p10")


def relative_width(alpha: Column | float = 1.0) -> Column:
    a = alpha if isinstance(alpha, Column) else d(alpha)
    return width() * a / F.greatest(F.col("p50"), d(TINY))


def confidence(mean_relative_width: Column, threshold: float) -> Column:
    return F.greatest(d(0), 1 - F.least(mean_relative_width / d(threshold), d(1)))


def efficiency(delta: Column, base: Column) -> Column:
    """Diminishing returns: one half for a change of three times the base."""
    return 1 / (1 + F.abs(delta) / (3 * base + d(1e-9)))


def ordered_floor(p10: Column, p50: Column, p90: Column) -> list[Column]:
    """The three in rising order, at least 0, as p10, p50, p90."""
    s = F.array_sort(F.array(p10, p50, p90))
    return [F.greatest(s[i], d(0)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))]


def nonconformity(kind: str = "normalized_residual") -> Column:
    a, lo, mid, hi = (F.col(c) for c in ("actual", "p10", "p50", "p90"))
    if kind == "scaling_factor":
        return F.when(a < lo, (mid - a) / F.greatest(mid - lo, d(TINY))).when(a > hi, (a - mid) / F.greatest(hi - mid, d(TINY))).otherwise(d(1))
    return F.abs(a - mid) / F.greatest((hi - lo) / 2, d(TINY))


def covered(alpha: Column, kind: str = "normalized_residual") -> Column:
    """Whether the actual value lies in the band scaled by alpha, ends included."""
    a, lo, mid, hi = (F.col(c) for c in ("actual", "p10", "p50", "p90"))
    if kind == "scaling_factor":
        return a.between(mid - alpha * (mid - lo), mid + alpha * (hi - mid))
    return a.between(mid - alpha * ((hi - lo) / 2), mid + alpha * ((hi - lo) / 2))
