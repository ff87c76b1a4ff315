"""From window messages to load on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demand import hash_uniform

#: A message counts five minutes; load is per hour.
PER_HOUR = 12.0


def keep_latest(messages: DataFrame) -> DataFrame:
    """The latest message of each segment by window start, then emission; the first of
    equals by input order (column ``row`` where there is one).

    An aggregate of one struct per segment, so a hot segment is reduced before
    the exchange. Overlapping windows replace each other and are never added.
    """
    order = [F.col("window_start"), F.col("emit_time")] + ([-F.col("row")] if "row" in messages.columns else [])
    return messages.groupBy("segment_id").agg(F.max_by(F.struct(*[c for c in messages.columns if c != "segment_id"]), F.struct(*order)).alias("m")).select("segment_id", "m.*")


def loads(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, load_vph) from each known segment's latest message."""
    return keep_latest(messages).join(edges.select("segment_id", "edge_id"), "segment_id").select("edge_id", (F.col("vehicle_count") * PER_HOUR).alias("load_vph"))


def unknown_segments(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Latest messages of segments that no edge has."""
    return keep_latest(messages).join(edges.select("segment_id"), "segment_id", "left_anti")


def snapshot(edges: DataFrame, load: DataFrame) -> DataFrame:
    """(segment_id, load_vph) of loaded edges, by segment."""
    return edges.join(load, "edge_id").where("load_vph > 0").select("segment_id", "load_vph").orderBy("segment_id")


def sliding_windows(pings: DataFrame, size_min: int = 5, slide_min: int = 1) -> DataFrame:
    """Per segment and half-open event-time window: distinct vehicles, mean speed, pings.

    Distinct vehicles are counted in two aggregates, by vehicle and then by
    segment, so that a hot segment's vehicles never meet in one row.
    """
    each = pings.withColumn("w", F.window("ts", f"{size_min} minutes", f"{slide_min} minutes"))
    one = each.groupBy("segment_id", "w", "taxi_id").agg(F.count(F.lit(1)).alias("n"), F.sum("speed_kmh").alias("s"))
    return one.groupBy("segment_id", "w").agg(F.count(F.lit(1)).alias("vehicle_count"), (F.sum("s") / F.sum("n")).alias("avg_speed_kmh"), F.sum("n").alias("sample_pings")).select("segment_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "vehicle_count", "avg_speed_kmh", "sample_pings")


def inject(load: DataFrame, jam: DataFrame) -> DataFrame:
    """Loads with ``jam`` (edge_id, load_vph) added, never below zero."""
    both = load.select("edge_id", "load_vph").union(jam.select("edge_id", "load_vph"))
    return both.groupBy("edge_id").agg(F.greatest(F.lit(0.0), F.sum("load_vph")).alias("load_vph"))


def perturb(load: DataFrame, seed: int, steps: int = 1, share: float = 0.1) -> DataFrame:
    """Loads after ``steps`` random changes of up to ``share`` either way, each drawn from seed, step and edge."""
    v = F.col("load_vph")
    for k in range(max(0, steps)):
        v = v * (1.0 - share + 2 * share * hash_uniform(seed, F.concat_ws(":", F.lit(k), F.col("edge_id"))))
    return load.select("edge_id", F.when(F.col("load_vph") > 0, F.greatest(F.lit(0.0), v)).otherwise(F.col("load_vph")).alias("load_vph"))

