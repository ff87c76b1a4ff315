"""What an assignment is worth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import Bpr, vc_ratio
from ..session import cut
from .network import Network
from .ranking import numbered


def edge_state(network: Network, load: DataFrame, bpr: Bpr = Bpr()) -> DataFrame:
    """Edges with load_vph, vc and time_s under the load."""
    e = network.with_load(load)
    cap, v = F.col("capacity_vph"), F.col("load_vph")
    return e.withColumn("vc", vc_ratio(v, cap, bpr.scale)).withColumn("time_s", bpr.cost(F.col("freeflow_s"), v, cap))


def realized_times(routes: DataFrame, state: DataFrame) -> DataFrame:
    """(request_id, time_s): each route's time on the final load; an unknown edge adds nothing."""
    steps = routes.select("request_id", F.explode_outer("edges").alias("edge_id"))
    return steps.join(state.select("edge_id", "time_s"), "edge_id", "left").groupBy("request_id").agg(F.coalesce(F.sum("time_s"), F.lit(0.0)).alias("time_s"))


def nearest_rank(value: str, share: float) -> Column:
    """The nearest-rank percentile of each of many groups, 0 without rows; of one large group ``tail``."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def tail(values: DataFrame, value: str, share: float) -> float:
    """The nearest-rank percentile over all rows, 0 without rows. Equal values are counted
    first and ranked range by range, so no task sees them all."""
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    ranked = numbered(counted, "below", "x", weight="k")
    n = ranked.agg(F.sum("k")).first()[0] or 0
    at = max(1, math.ceil(share * n - 1e-9))
    found = ranked.where((F.col("below") < at) & (F.col("below") + F.col("k") >= at)).select("x").first()
    return float(found[0]) if found else 0.0


def gini(values: DataFrame, value: str) -> DataFrame:
    """One row with gini, over all rows, zeros included; 0 without rows or sum.

    Equal values are counted before they are ranked; the window sees distinct
    values only, of which a network has at most one for each edge.
    """
    counted = values.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    ranked = counted.withColumn("below", F.sum("k").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
    # Equal values have ranks below .. below + k - 1, counted from 0.
    total = ranked.agg(F.sum("k").alias("n"), F.sum(F.col("x") * F.col("k")).alias("s"), F.sum(F.col("x") * F.col("k") * (2 * F.col("below") + F.col("k") - 1)).alias("r"))
    g = (F.col("r") - (F.col("n") - 1) * F.col("s")) / (F.col("n") * F.col("s"))
    return total.select(F.when((F.col("n") > 0) & (F.col("s") > 0), g).otherwise(F.lit(0.0)).alias("gini"))


def evaluate(network: Network, routes: DataFrame, load: DataFrame, bpr: Bpr = Bpr()) -> DataFrame:
    """One row: mean_realized_s, p95_realized_s, total_network_time_s, gini_vc, max_vc."""
    state = edge_state(network, load, bpr)
    times = cut(realized_times(routes, state))
    trips = times.agg(F.coalesce(F.avg("time_s"), F.lit(0.0)).alias("mean_realized_s")).withColumn("p95_realized_s", F.lit(tail(times, "time_s", 0.95)))
    edges = state.agg(F.coalesce(F.sum(F.col("load_vph") * F.col("time_s")), F.lit(0.0)).alias("total_network_time_s"), F.coalesce(F.max("vc"), F.lit(0.0)).alias("max_vc"))
    return trips.join(edges).join(gini(state, "vc").withColumnRenamed("gini", "gini_vc")).select("mean_realized_s", "p95_realized_s", "total_network_time_s", "gini_vc", "max_vc")


def price_of_anarchy(total: Column, optimal: Column) -> Column:
    """Total time over the optimal one; 1 where either isn't positive."""
    return F.when((total > 0) & (optimal > 0), total / optimal).otherwise(F.lit(1.0))


def poa_by_level(cells: DataFrame) -> DataFrame:
    """(router, demand_level, target_vc, total_s) with poa against the level's system optimum."""
    best = F.max(F.when(F.col("router") == "systemoptimal", F.col("total_s"))).over(Window.partitionBy("demand_level"))
    return cells.withColumn("poa", price_of_anarchy(F.col("total_s"), F.coalesce(best, F.lit(0.0))))


def headline(cells: DataFrame) -> DataFrame:
    """The level where the better of incremental and systemoptimal saves most against naive; the first of equals."""
    by = cells.groupBy("demand_level", "target_vc").agg(F.max(F.when(F.col("router") == "naive", F.col("total_s"))).alias("naive"), F.min(F.when(F.col("router").isin("incremental", "systemoptimal"), F.struct("total_s", "router"))).alias("best"))
    pct = F.when(F.col("naive") > 0, (F.col("naive") - F.col("best.total_s")) / F.col("naive") * 100).otherwise(F.lit(0.0))
    return by.select("demand_level", F.col("best.router").alias("router"), pct.alias("improvement_pct"), "target_vc").orderBy(F.desc("improvement_pct"), "target_vc").limit(1)


def rank_by(metrics: DataFrame, value: str, order: tuple[str, ...]) -> DataFrame:
    """Strategies with their rank, smallest value first, those without a finite one last; ties in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("router"))
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return metrics.withColumn(value, v).withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), place)))


def median_of_ns(values: DataFrame, value: str) -> DataFrame:
    """The median of whole numbers; of an even count the whole mean of the middle two."""
    return values.agg(F.floor(F.coalesce(F.median(value), F.lit(0))).cast("long").alias("median"))
