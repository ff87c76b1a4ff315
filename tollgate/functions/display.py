"""Buckets, colours, labels and other forms for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS, BUCKET_WIDTH = 24, 0.1


def vc_bucket(vc: Column) -> Column:
    """The v/c bucket, saturating at the top; 0 for nothing, NaN or less than nothing."""
    b = F.floor(vc / BUCKET_WIDTH + 1e-9)
    return F.when(vc.isNull() | F.isnan(vc) | (vc <= 0), 0).when(b >= BUCKETS - 1, BUCKETS - 1).otherwise(b).cast("int")


def bucket_rgb(bucket: Column, stops) -> Column:
    """array<int> red, green, blue on a ramp through ``stops``; halves round up."""
    at = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), bucket)) / float(BUCKETS - 1) * (len(stops) - 1)
    i = F.least(F.lit(len(stops) - 2), F.floor(at)).cast("int")
    table = F.array(*(F.array(*map(F.lit, s)) for s in stops))
    lo, hi = F.get(table, i), F.get(table, i + 1)
    return F.zip_with(lo, hi, lambda a, b: F.floor(a + (b - a) * (at - i) + 0.5).cast("int"))


def metric_text(value: Column, digits: int = 2) -> Column:
    """A number with fixed digits; a dash for none."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, "—").otherwise(F.format_string(f"%.{digits}f", value))


def ns_to_ms(ns: Column) -> Column:
    """Whole nanoseconds as milliseconds."""
    return ns.cast("double") / 1e6


def clock_label(minutes: Column) -> Column:
    """Minutes since midnight as HH:MM, wrapping at a day."""
    m = F.pmod(minutes, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def start_instant(date: Column, minutes: Column) -> Column:
    """A date and minutes since midnight as an instant."""
    return F.concat(date, F.lit("T"), clock_label(minutes), F.lit(":00Z"))


def start_parts(instant: Column) -> Column:
    """struct<date,minutes> of an instant; empty date and midnight where it can't be read."""
    p = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2})"
    part = lambda k: F.coalesce(F.regexp_extract(instant, p, k).try_cast("int"), F.lit(0))
    return F.struct(F.coalesce(F.regexp_extract(instant, p, 1), F.lit("")).alias("date"), (part(2) * 60 + part(3)).alias("minutes"))


def instant_label(instant: Column) -> Column:
    """An instant as a date and time for people; other text stays."""
    ts = F.try_to_timestamp(instant, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(F.date_format(ts, "MMM d, yyyy · HH:mm 'UTC'"), instant)


def etag_matches(header: Column, tag: Column) -> Column:
    """Whether an If-None-Match header names the tag or any; weak tags count as equal."""
    one = F.transform(F.split(header, ","), lambda x: F.regexp_replace(F.trim(x), "^W/", ""))
    return F.coalesce((F.trim(header) == "*") | F.array_contains(one, tag), F.lit(False))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def etag(body: Column) -> Column:
    return F.concat(F.lit('"'), F.sha2(body, 256), F.lit('"'))
