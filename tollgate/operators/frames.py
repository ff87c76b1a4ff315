"""Replay frames: what a viewer gets of a simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import ns_to_ms, vc_bucket


def due_ticks(ticks: DataFrame, tick_s: float, speed: float, tick_hz: float) -> DataFrame:
    """``ticks`` (algo, tick, ...) with the frame that sends them; ticks due at once
    are coalesced to the last. Frame 0 is the snapshot of each algorithm's first tick."""
    step = speed / tick_hz
    first = F.min("tick").over(Window.partitionBy("algo"))
    offset = (F.col("tick") - F.col("first")) * tick_s
    out = ticks.withColumn("first", first).withColumn("frame", F.when(F.col("tick") == F.col("first"), 0).otherwise(F.greatest(F.lit(1), F.ceil(offset / step))).cast("int"))
    last = F.max("tick").over(Window.partitionBy("algo", "frame"))
    return out.withColumn("last", last).where("tick = last").drop("first", "last")


def deltas(states: DataFrame) -> DataFrame:
    """``states`` (algo, frame, segment_id, vc) whose bucket differs from the segment's last one,
    with bucket and kind; a segment's first state belongs to the snapshot."""
    b = states.withColumn("bucket", vc_bucket(F.col("vc")))
    before = F.lag("bucket").over(Window.partitionBy("algo", "segment_id").orderBy("frame"))
    b = b.withColumn("before", before).where("before is null or before <> bucket")
    return b.withColumn("kind", F.when(F.col("before").isNull(), "snapshot").otherwise("delta")).drop("before")


def fold(changes: DataFrame) -> DataFrame:
    """The state after all frames: each segment's last bucket."""
    return changes.groupBy("algo", "segment_id").agg(F.max_by("bucket", "frame").alias("bucket"))


def frame_json(changes: DataFrame, sent: DataFrame, start: str, tick_s: float) -> DataFrame:
    """(algo, frame, type, body) as JSON of every frame of ``sent`` (algo, frame, tick, and the
    metrics in_flight, completed, realized_total_s, poa, compute_ns, route_median_ns).

    A snapshot has all segments, a delta those that changed, which may be none;
    both by id, with the tick, the simulated instant and the metrics. Tick 1
    begins at ``start``.
    """
    one = F.struct("segment_id", "vc", "bucket")
    g = changes.groupBy("algo", "frame").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    metrics = F.struct(ns_to_ms(F.col("compute_ns")).alias("compute_ms"), "route_median_ns", "realized_total_s", "poa", "in_flight", "completed").alias("metrics")
    clock = F.date_format(F.timestamp_add("SECOND", ((F.col("tick") - 1) * tick_s).cast("int"), F.lit(start).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sim_time")
    f = sent.join(g, ["algo", "frame"], "left").withColumn("segments", F.coalesce("segments", F.array().cast(g.schema["segments"].dataType)))
    f = f.withColumn("type", F.when(F.col("frame") == 0, "snapshot").otherwise("delta"))
    head = [F.col("type"), F.col("algo"), F.col("tick"), clock]
    body = F.when(F.col("frame") == 0, F.to_json(F.struct(*head, "segments", metrics))).otherwise(F.to_json(F.struct(*head, F.col("segments").alias("changed"), metrics)))
    return f.select("algo", "frame", "type", body.alias("body"))
