"""Statistics that skip what is not finite, and guarded correlations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as double; null if it is not a finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number(x: Column) -> Column:
    """x as double without NaN; infinities stay."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def pearson(x: Column, y: Column, least: int = 3, flat: float = 1e-15) -> Column:
    """Aggregate: correlation of the pairs of finite numbers; null with fewer than ``least`` or a constant side."""
    a, b = F.when(finite(y).isNotNull(), finite(x)), F.when(finite(x).isNotNull(), finite(y))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b)) * F.count(a)
    return F.when((F.count(a) >= least) & (spread > flat), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def pearson_of_all(x: Column, y: Column, least: int = 3, flat: float = 1e-12) -> Column:
    """Aggregate: correlation of all pairs without nulls; NaN with fewer than ``least``, with a deviation below ``flat``, or where any number is NaN or infinite."""
    both = x.isNotNull() & y.isNotNull()
    a, b = (F.when(both, v.cast("double")) for v in (x, y))
    odd = F.count_if(both & ~(finite(x).isNotNull() & finite(y).isNotNull())) > 0
    usable = (F.count(a) >= least) & ~odd & (F.stddev_pop(a) >= flat) & (F.stddev_pop(b) >= flat)
    return F.when(usable, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).otherwise(F.lit(float("nan")))


def rate(flag: Column) -> Column:
    """Aggregate: share of rows where flag holds; null counts as no."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def mean(x: Column) -> Column:
    return F.avg(number(x))


def sample_std(x: Column) -> Column:
    return F.stddev_samp(number(x))


def group_std(x: Column) -> Column:
    return F.stddev_pop(number(x))
