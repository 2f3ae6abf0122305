"""Weights, measures and fits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf_ln(n_docs: Column, df: Column) -> Column:
    """Natural inverse document frequency."""
    return F.log(n_docs / df)


def idf_log2(n_docs: Column, df: Column) -> Column:
    """Base-2 inverse document frequency; 0 where no document has the term."""
    return F.when(df > 0, F.log2(n_docs / df)).otherwise(0.0)


def log_tf(tf: Column, idf: Column) -> Column:
    """(1 + ln tf) * idf."""
    return (1 + F.log(tf)) * idf


def raw_tf(tf: Column, idf: Column) -> Column:
    """tf * idf."""
    return tf * idf


def norm(weight: Column) -> Column:
    """Euclidean norm, an aggregate."""
    return F.sqrt(F.sum(weight * weight))


def cosine(dot: Column, a: Column, b: Column) -> Column:
    """dot / (a * b), 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot, a * b), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation, an aggregate; null where a side does not vary (rounding kept off the zero test)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-15, spread))


def slope(x: Column, y: Column) -> Column:
    """Slope of the least-squares line, an aggregate."""
    return F.regr_slope(y, x)


def intercept(x: Column, y: Column) -> Column:
    """Intercept of the least-squares line, an aggregate."""
    return F.regr_intercept(y, x)


def power_law(scale: Column, base: Column, exponent: Column) -> Column:
    """scale * base ** exponent."""
    return scale * F.pow(base, exponent)


def block_size(n: Column) -> Column:
    """floor(sqrt(n)), at least 1."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(n))).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def ratio(before: Column, after: Column) -> Column:
    """before / after, null for nothing."""
    return F.try_divide(before.cast("double"), after.cast("double"))


def saving(before: Column, after: Column) -> Column:
    """Percentage saved."""
    return percent(before - after, before)
