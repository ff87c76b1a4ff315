"""Congestion messages: JSON lines with exactly ten keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segment import format_instant, parse_instant

SCHEMA = "schema_version int, segment_id string, window_start string, window_end string, vehicle_count long, avg_speed_kmh double, sample_pings long, is_final boolean, emit_time string, producer string"
KEYS = [x.split()[0] for x in SCHEMA.split(", ")]


class InvalidMessage(ValueError):
    pass


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with the ten fields, timestamps parsed, and ``error``: what is wrong first, or null.

    An extra or missing key, a value of another type, a timestamp that isn't in
    canonical form and a value out of bounds are errors.
    """
    v, m = F.col(value), F.col("m")
    d = raw.withColumn("m", F.from_json(v, SCHEMA)).withColumn("keys", F.coalesce(F.json_object_keys(v), F.array().cast("array<string>")))
    start, end, emit = (parse_instant(m[c]) for c in ("window_start", "window_end", "emit_time"))
    error = (
        F.when(F.size(F.array_except("keys", F.array(*map(F.lit, KEYS)))) > 0, "unknown field")
        .when(F.size(F.array_except(F.array(*map(F.lit, KEYS)), "keys")) > 0, "missing field")
        .when(F.coalesce(m["schema_version"] != 1, F.lit(True)), "schema_version")
        .when(m["segment_id"].isNull() | m["producer"].isNull() | m["is_final"].isNull(), "type")
        .when(F.coalesce(m["vehicle_count"] < 0, F.lit(True)), "vehicle_count")
        .when(F.coalesce(F.isnan(m["avg_speed_kmh"]) | (m["avg_speed_kmh"] <= 0) | (m["avg_speed_kmh"] == float("inf")), F.lit(True)), "avg_speed_kmh")
        .when(F.coalesce(m["sample_pings"] < 0, F.lit(True)), "sample_pings")
        .when(start.isNull(), "window_start")
        .when(end.isNull(), "window_end")
        .when(emit.isNull(), "emit_time")
    )
    fields = [start.alias(c) if c == "window_start" else end.alias(c) if c == "window_end" else emit.alias(c) if c == "emit_time" else m[c].alias(c) for c in KEYS]
    return d.select(*[c for c in raw.columns], *fields, error.alias("error"))


def read_messages(spark, path: str) -> DataFrame:
    """All messages of JSON-lines files, or an error if any is invalid."""
    d = decode(spark.read.text(path))
    bad = d.where("error is not null").limit(1).collect()
    if bad:
        raise InvalidMessage(f"{bad[0]['error']}: {bad[0]['value'][:200]}")
    return d.drop("value", "error")


def encode(messages: DataFrame) -> DataFrame:
    """(key, value) of messages, keyed by segment."""
    fields = [format_instant(F.col(c)).alias(c) if c in ("window_start", "window_end", "emit_time") else F.col(c) for c in KEYS]
    return messages.select(F.col("segment_id").alias("key"), F.to_json(F.struct(*fields)).alias("value"))
