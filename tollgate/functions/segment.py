"""Segment ids "{way}:{seq}:{F|R}" and canonical timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([1-9][0-9]*):(0|[1-9][0-9]*):([FR])\z"
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def format_segment_id(way: Column, seq: Column, direction: Column) -> Column:
    return F.concat_ws(":", way.cast("string"), seq.cast("string"), direction)


def parse_segment_id(text: Column) -> Column:
    """struct<way,seq,dir>; null unless the text is exactly what format would give
    and both numbers fit 64 bits."""
    way = F.regexp_extract(text, PATTERN, 1).try_cast("bigint")
    seq = F.regexp_extract(text, PATTERN, 2).try_cast("bigint")
    ok = text.rlike(PATTERN) & way.isNotNull() & seq.isNotNull()
    return F.when(ok, F.struct(way.alias("way"), seq.alias("seq"), F.regexp_extract(text, PATTERN, 3).alias("dir")))


def direction_name(code: Column) -> Column:
    """0 and 1 as F and R, anything else spelt out."""
    return F.when(code == 0, "F").when(code == 1, "R").otherwise(F.concat(F.lit("Direction("), code.cast("string"), F.lit(")")))


def parse_instant(text: Column) -> Column:
    """A timestamp from "YYYY-MM-DDTHH:MM:SSZ"; null unless it formats back to the same text."""
    ts = F.try_to_timestamp(F.when(text.rlike(INSTANT), text), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(format_instant(ts) == text, ts)


def format_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
