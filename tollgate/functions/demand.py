"""Time-of-day demand."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Morning and evening peak hour, width in hours, night floor, steps of the spread.
AM_PEAK, PM_PEAK, SIGMA_H, NIGHT, STEPS = 8.0, 17.5, 1.75, 0.18, 240


def factor_at_hour(hour: Column) -> Column:
    bump = lambda peak: F.exp(F.lit(-0.5) * ((hour - peak) / SIGMA_H) * ((hour - peak) / SIGMA_H))
    return F.lit(NIGHT) + F.lit(1.0 - NIGHT) * F.greatest(bump(AM_PEAK), bump(PM_PEAK))


def hour_of_day(ts: Column) -> Column:
    """Hours since midnight, whole seconds."""
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0


def diurnal_factor(ts: Column) -> Column:
    """Demand relative to the peak, by the clock alone."""
    return factor_at_hour(hour_of_day(ts))


def factor_of_seconds(s: float) -> float:
    """The same for seconds since midnight, on the driver."""
    h = (int(s) % 86400) / 3600.0
    return NIGHT + (1 - NIGHT) * max(math.exp(-0.5 * ((h - p) / SIGMA_H) ** 2) for p in (AM_PEAK, PM_PEAK))


def departure_spread(spark: SparkSession, start_s: float, window_s: float, n: int) -> DataFrame:
    """(idx, depart_s): ``n`` departures over the window, as dense as demand is.

    The mid-points of ``n`` equal shares of demand are mapped through the
    inverse of its trapezoidal distribution, which has a fixed number of steps.
    """
    if n <= 0:
        return spark.range(0).select(F.col("id").alias("idx"), F.lit(0.0).alias("depart_s"))
    if window_s <= 0:
        return spark.range(n).select(F.col("id").alias("idx"), F.lit(0.0).alias("depart_s"))
    dt = window_s / STEPS
    at = [factor_of_seconds(start_s + i * dt) for i in range(STEPS + 1)]
    cdf = [0.0]
    for a, b in zip(at, at[1:]):
        cdf.append(cdf[-1] + 0.5 * (a + b) * dt)
    # The distribution has a fixed number of steps, so it goes into the plan as a literal.
    steps = F.array(*(F.lit(x) for x in cdf))
    q = (F.col("id") + 0.5) / float(n) * cdf[-1]
    k = F.size(F.filter(steps, lambda x: x < F.col("q")))
    low, high = F.get(steps, F.col("k") - 1), F.get(steps, F.col("k"))
    return spark.range(n).withColumn("q", q).withColumn("k", k).select(F.col("id").alias("idx"), F.when(F.col("k") == 0, 0.0).otherwise((F.col("k") - 1 + (F.col("q") - low) / (high - low)) * dt).alias("depart_s"))


def hash_uniform(seed: int, idx: Column) -> Column:
    """A number in [0, 1) from seed and index, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), idx.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def running_sum(value: Column, partition, order) -> Column:
    return F.sum(value).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
