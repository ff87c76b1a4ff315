"""The ping stream: event-time windows, late pings, provisional and final messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.congestion import keep_latest
from ..session import drop_path
from ..sources.messages import encode

# Fixed values of the stream: window, slide, lateness.
WINDOW, SLIDE, LATENESS = "5 minutes", "1 minute", "2 minutes"
PINGS = "taxi_id string, ts timestamp, segment_id string, speed_kmh double"


def windowed(pings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of the sliding-window aggregate; the distinct vehicles of a
    window are an exact set, bounded by who drives a segment in five minutes."""
    w = pings.withWatermark("ts", lateness).groupBy(F.window("ts", WINDOW, SLIDE).alias("w"), "segment_id")
    out = w.agg(F.size(F.collect_set("taxi_id")).alias("vehicle_count"), F.avg("speed_kmh").alias("avg_speed_kmh"), F.count(F.lit(1)).alias("sample_pings"))
    return out.select("segment_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("vehicle_count").cast("long").alias("vehicle_count"), "avg_speed_kmh", "sample_pings")


def messages(windows: DataFrame, final: bool | Column, producer: str, emit_time=None) -> DataFrame:
    """Window rows in the form of the ten-field message."""
    emit = F.current_timestamp() if emit_time is None else emit_time
    return windows.select(F.lit(1).alias("schema_version"), "segment_id", "window_start", "window_end", "vehicle_count", "avg_speed_kmh", "sample_pings", (final if isinstance(final, Column) else F.lit(final)).alias("is_final"), F.date_trunc("second", emit).alias("emit_time"), F.lit(producer).alias("producer"))


def start(pings: DataFrame, final: bool, sink, checkpoint: str, producer: str = "stream", available_now: bool = False) -> StreamingQuery:
    """One builder, two triggers: provisional messages in update mode or final ones in append
    mode; ``sink(df, batch_id)`` gets each batch in the order of window and segment."""

    def each(df: DataFrame, batch: int) -> None:
        sink(messages(df, final, producer).sortWithinPartitions("window_start", "segment_id"), batch)

    w = windowed(pings).writeStream.outputMode("append" if final else "update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


#: What a segment's state holds, as JSON: for each open window its vehicles, and sum, count of speeds and pings.
MESSAGES = "segment_id string, window_start timestamp, window_end timestamp, vehicle_count long, avg_speed_kmh double, sample_pings long, is_final boolean, dropped_late long"


def both_kinds(pings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Provisional and final rows of one job with one state: a batch that touches a window
    gives it as provisional, and the watermark that passes its end gives it as
    final, once. A ping behind the watermark is left out and counted in
    ``dropped_late`` of a row without a window.
    """
    length, slide = pd.Timedelta(WINDOW), pd.Timedelta(SLIDE)

    def step(key, batches: Iterator[pd.DataFrame], state):
        held = json.loads(state.get[0]) if state.exists else {}
        mark, late, touched = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), 0, set()
        for b in () if state.hasTimedOut else batches:
            for taxi, ts, speed in zip(b["taxi_id"], b["ts"], b["speed_kmh"]):
                if ts < mark:
                    late += 1
                    continue
                first = ts.floor(slide) - length + slide
                for k in range(int(length / slide)):
                    at = str((first + k * slide).value // 10**9)
                    w = held.setdefault(at, {"taxis": {}, "sum": 0.0, "speeds": 0, "pings": 0})
                    w["pings"] += 1
                    if taxi is not None:
                        w["taxis"][taxi] = 1
                    if speed == speed and speed is not None:
                        w["sum"] += speed
                        w["speeds"] += 1
                    touched.add(at)
        rows = [_message(key[0], at, held[at], False, length) for at in sorted(touched, key=int) if _end(at, length) > mark]
        ended = sorted((at for at in held if _end(at, length) <= mark), key=int)
        rows += [_message(key[0], at, held.pop(at), True, length) for at in ended]
        if late:
            rows.append((key[0], None, None, None, None, None, None, late))
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(int(min(map(int, held)) * 1000 + length.total_seconds() * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    return pings.withWatermark("ts", lateness).groupBy("segment_id").applyInPandasWithState(step, MESSAGES, "windows string", "update", "EventTimeTimeout")


def _end(at: str, length: pd.Timedelta) -> pd.Timestamp:
    return pd.Timestamp(int(at), unit="s") + length


def _message(segment: str, at: str, w: dict, final: bool, length: pd.Timedelta) -> tuple:
    return segment, pd.Timestamp(int(at), unit="s"), _end(at, length), len(w["taxis"]), w["sum"] / w["speeds"] if w["speeds"] else None, w["pings"], final, 0


def start_both(pings: DataFrame, sink, checkpoint: str, producer: str = "stream", available_now: bool = False, dropped: list[int] | None = None) -> StreamingQuery:
    """The one job, live or over all that is there: ``sink(df, batch_id)`` gets each batch's
    messages of both kinds in the order of window and segment; ``dropped``
    takes each batch's number of late pings, which is no part of a message."""

    def each(df: DataFrame, batch: int) -> None:
        df.persist()
        if dropped is not None:
            dropped.append(df.agg(F.coalesce(F.sum("dropped_late"), F.lit(0)).alias("n")).first()["n"])
        rows = df.where("window_start is not null")
        out = messages(rows, F.col("is_final"), producer)
        sink(out.repartition("segment_id").sortWithinPartitions("window_start", "segment_id", "is_final"), batch)
        df.unpersist()

    w = both_kinds(pings).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def drop_late(pings: DataFrame, lateness_s: int = 120) -> DataFrame:
    """Pings with ``late``: whether one's event time is more than ``lateness_s`` behind the
    greatest its key has brought in earlier batches.

    The built-in watermark drops by window end and one batch later; this keeps
    the strict rule, by state of one instant per key, and lets the caller count
    what it drops. The key is ``source_key``; one that is silent for a day is forgotten.
    """
    fields = [f for f in pings.schema.fields]

    def strict(key, batches: Iterator[pd.DataFrame], state):
        top = state.get[0] if state.exists else None
        mark, rows = top, []
        for b in batches:
            b = b.assign(late=False if mark is None else b["ts"] < pd.Timestamp(mark) - pd.Timedelta(seconds=lateness_s))
            newest = b["ts"].max()
            top = newest if top is None or newest > pd.Timestamp(top) else top
            rows.append(b)
        if state.hasTimedOut:
            state.remove()
            return
        state.update((pd.Timestamp(top).to_pydatetime(),))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield from rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", late boolean"
    return pings.groupBy("source_key").applyInPandasWithState(strict, schema, "top timestamp", "append", "ProcessingTimeTimeout")


def latest_loads(spark: SparkSession, path: str):
    """A sink that keeps each segment's latest message as a table: old and new meet in one
    keep-latest, and the result replaces the table under a new version. The
    version before it stays for readers; older ones go."""

    def sink(df: DataFrame, batch: int) -> None:
        before = f"{path}/v={batch - 1}"
        old = [spark.read.parquet(before)] if batch > 0 else []
        both = df
        for o in old:
            both = both.unionByName(o)
        keep_latest(both).select(*df.columns).write.mode("overwrite").parquet(f"{path}/v={batch}")
        if batch > 1:
            drop_path(spark, f"{path}/v={batch - 2}")

    return sink


def kafka_pings(spark: SparkSession, servers: str, topic: str = "gps-pings") -> DataFrame:
    """Pings from Kafka with their key, the vehicle, as source_key; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string").alias("source_key"), F.from_json(F.col("value").cast("string"), PINGS).alias("p")).select("source_key", "p.*")


def kafka_sink(servers: str, topic: str = "segment-congestion"):
    """A sink of encoded messages, keyed by segment for a compacted topic."""

    def sink(df: DataFrame, batch: int) -> None:
        encode(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return sink


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Pings from CSV files as a stream, some files a batch."""
    return spark.readStream.schema(PINGS).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


