"""Guarded arithmetic and intervals. NaN and infinities are values here; nulls are not expected."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NAN, INF = float("nan"), float("inf")
#: Two-sided 95 % critical values of Student's t by degrees of freedom.
T95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
    24: 2.064, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980,
}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


@F.arrow_udf(DoubleType())
def libm_exp(x: pa.Array) -> pa.Array:
    """The C library's, as DuckDB has it; the JVM's differs in last bits."""
    return pc.exp(x)


@F.arrow_udf(DoubleType())
def libm_log10(x: pa.Array) -> pa.Array:
    return pc.log10(x)


def safe_exp(c: Column, limit: float = 50.0, exp: Callable[[Column], Column] = F.exp) -> Column:
    return F.when(finite(c) & (c < limit), exp(F.when(c < limit, c).otherwise(0.0))).otherwise(INF)


def prob_from_log(c: Column, exp: Callable[[Column], Column] = F.exp) -> Column:
    return F.when(c == -INF, 0.0).when(~finite(c), NAN).when(c < -745, 0.0).otherwise(exp(c))


def log10_from_log(c: Column) -> Column:
    return F.when(c == -INF, -INF).when(~finite(c), NAN).otherwise(c / math.log(10))


def log10_or_nan(c: Column, log10: Callable[[Column], Column] = F.log10) -> Column:
    return F.when(finite(c) & (c > 0), log10(F.when(c > 0, c).otherwise(1.0))).otherwise(NAN)


def log10_floored(c: Column, floor: float, log10: Callable[[Column], Column] = F.log10) -> Column:
    return F.when(finite(c), log10(F.greatest(c, F.lit(floor)))).otherwise(NAN)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def t95(n: Column) -> Column:
    """Critical value for n observations: of the largest tabled degrees of freedom not above n - 1."""
    out = F.when(n <= 1, NAN).when(n - 1 > 120, 1.96)
    for df in sorted(T95, reverse=True):
        out = out.when(n - 1 >= df, T95[df])
    return out


def ci95(std: Column, n: Column) -> Column:
    return F.when((n <= 1) | ~finite(std), 0.0).otherwise(t95(n) * std / F.sqrt(F.greatest(n, F.lit(1)).cast("double")))


def binomial_ci95(count: Column, total: Column, scale: float = 100.0) -> Column:
    rate = count / F.greatest(total, F.lit(1))
    return F.when(total <= 0, 0.0).otherwise(1.96 * F.sqrt(rate * (1 - rate) / F.greatest(total, F.lit(1))) * scale)


def band(value: Column, spread: Column, low: float, high: float) -> tuple[Column, Column]:
    """[value - spread, value + spread] inside [low, high]; an unknown spread counts as none; no value gives no band."""
    spread = F.when(finite(spread), spread).otherwise(0.0)
    lower = F.when(F.isnan(value), NAN).otherwise(F.least(F.greatest(value - spread, F.lit(low)), F.lit(high)))
    upper = F.when(F.isnan(value), NAN).otherwise(F.greatest(F.least(value + spread, F.lit(high)), lower))
    return F.when(value.isNotNull(), lower), F.when(value.isNotNull(), upper)


def number(c: Column) -> Column:
    """A string as a finite double, else null."""
    x = c.try_cast("double")
    return F.when(finite(x), x)


def row_ci95(metric: str) -> Column:
    """Of a rolled-up row: columns {metric}_std and num_windows."""
    return ci95(F.col(f"{metric}_std"), F.col("num_windows"))


def rate_ci95(metric: str) -> Column:
    """In percent: by the deviation where it gives a width, else by {metric}_count."""
    t = row_ci95(metric) * 100.0
    return F.when(finite(t) & (t > 0), t).otherwise(binomial_ci95(F.col(f"{metric}_count"), F.col("num_windows")))


def log_errors(value: Column, error: Column, floor: float = 1e-12) -> tuple[Column, Column]:
    """Lengths below and above value on a logarithmic axis: the lower end stays at a twentieth of it, and at floor."""
    fine = finite(value) & (value > 0) & finite(error)
    low = F.greatest(value - error, value * 0.05, F.lit(floor))
    return F.when(fine, value - low).otherwise(0.0), F.when(fine, F.greatest(value + error, low) - value).otherwise(0.0)


def densities(rows: DataFrame, value: str, keys: list[str], bins: int, margin: float) -> DataFrame:
    """keys, bin, n, share: values of every key's rows in even bins over the finite values of all, and a margin on either
    side; a share is of the key's rows. Without a range (one value, or none) there are no bins."""
    rows = rows.filter(finite(F.col(value)))
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.col("hi") - F.col("lo")
    ends = ends.filter("lo < hi").select((F.col("lo") - margin * span).alias("_a"), (span * (1 + 2 * margin) / bins).alias("_w"))
    at = F.greatest(F.least(F.floor((F.round(value, 6) - F.col("_a")) / F.col("_w")), F.lit(bins - 1)), F.lit(0))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))  # a row beside each
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def log_grid(low: float, high: float, steps: int) -> Column:
    """Powers of ten at even steps from low to high, both included; one step is low alone."""
    gap = (high - low) / max(steps - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.pow(F.lit(10.0), low + gap * i))


def limits(rows: DataFrame, value: str, error: str, floor: float | None = None, pad: float = 0.12) -> DataFrame:
    """low, high of an axis around finite values and their errors (which count if all are finite)."""
    v, e = F.col(value), F.col(error)
    some = rows.filter(finite(v))
    whole = some.agg(F.min(v).alias("v0"), F.max(v).alias("v1"), F.min(v - e).alias("e0"), F.max(v + e).alias("e1"), F.bool_and(finite(e)).alias("known"))
    lo, hi = F.when(F.col("known"), F.col("e0")).otherwise(F.col("v0")), F.when(F.col("known"), F.col("e1")).otherwise(F.col("v1"))
    at_least = lambda c: c if floor is None else F.greatest(c, F.lit(floor))
    whole = whole.filter("v0 is not null").select(at_least(lo).alias("lo"), hi.alias("hi"))
    step = F.when(F.col("lo") == 0, 0.1).otherwise(F.abs("lo") * 0.1)
    span = (F.col("hi") - F.col("lo")) * pad
    flat = F.col("lo") == F.col("hi")
    return whole.select(F.when(flat, F.col("lo") - step).otherwise(at_least(F.col("lo") - span)).alias("low"), F.when(flat, F.col("hi") + step).otherwise(F.col("hi") + span).alias("high"))
