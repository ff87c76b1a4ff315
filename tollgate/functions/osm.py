"""Reading road tags: class, directions, lanes, speed, capacity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the road classes: default lanes, default speed in km/h and
# capacity factor, in this order of classes; and vehicles per hour and lane.
CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service")
LANES = (3, 2, 2, 2, 1, 1, 1)
SPEED_KMH = (100.0, 80.0, 60.0, 50.0, 40.0, 30.0, 20.0)
CAPACITY_FACTOR = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)
SATURATION_VPH = 1800.0
KMH_PER_MPH = 1.609344


def of_class(values, road_class: Column) -> Column:
    """The value of a class, null for any other."""
    pairs = [x for c, v in zip(CLASSES, values) for x in (F.lit(c), F.lit(v))]
    return F.create_map(*pairs)[road_class]


def road_class(highway: Column) -> Column:
    """One of the seven classes, link roads with their class; null for any other."""
    base = F.regexp_replace(F.trim(highway), r"_link\z", "")
    return F.when(base.isin(*CLASSES), base)


def leading_int(text: Column) -> Column:
    """The number a tag begins with, if it is at least 1."""
    n = F.regexp_extract(F.trim(text), r"^([0-9]+)", 1).try_cast("int")
    return F.when(n >= 1, n)


def speed_kmh(text: Column) -> Column:
    """A speed tag in km/h; null for words and for what doesn't begin with a number."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double")
    v = F.when(t.contains("mph"), n * KMH_PER_MPH).otherwise(n)
    return F.when(~t.isin("none", "signals", "variable", "walk") & (v > 0), v)


def directions(oneway: Column, junction: Column, cls: Column) -> Column:
    """Array of F and R, as allowed by the tags; motorways and roundabouts are one-way unless tagged."""
    ow = F.lower(F.trim(F.coalesce(oneway, F.lit(""))))
    forward, backward, both = F.array(F.lit("F")), F.array(F.lit("R")), F.array(F.lit("F"), F.lit("R"))
    return (
        F.when(ow.isin("yes", "true", "1"), forward)
        .when(ow.isin("-1", "reverse"), backward)
        .when(ow.isin("no", "false", "0"), both)
        .when((cls == "motorway") | F.lower(F.coalesce(junction, F.lit(""))).isin("roundabout", "circular"), forward)
        .otherwise(both)
    )


def effective_lanes(own: Column, bare: Column, one_way: Column, cls: Column) -> Column:
    """The direction's own tag; else all lanes of a one-way road or half of a two-way one; else the default."""
    n = leading_int(bare)
    half = F.when(n.isNotNull(), F.greatest(F.lit(1), F.floor(n / 2).cast("int")))
    return F.coalesce(leading_int(own), F.when(one_way, n).otherwise(half), of_class(LANES, cls))


def capacity_vph(lanes: Column, cls: Column) -> Column:
    return F.round(lanes * SATURATION_VPH * of_class(CAPACITY_FACTOR, cls), 6)


def freeflow_s(length_m: Column, speed: Column) -> Column:
    return length_m / (speed / 3.6)
