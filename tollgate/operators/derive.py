"""Directed edges from topology and road tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, osm
from ..functions.segment import format_segment_id
from .ranking import numbered


def kept_ways(ways: DataFrame, tags: DataFrame) -> DataFrame:
    """``ways`` that become edges, with tags, cls and length_m.

    Coordinates are rounded to 7 places. Sub-segments of other classes, self-loops
    and those without length are skipped. Tags have a row per way and small files,
    but are large once read: they are merged, never sent to the driver as a whole.
    """
    w = ways.withColumn("coords", F.transform("coords", lambda p: F.transform(p, lambda x: F.round(x, 7))))
    w = w.join(tags.hint("merge"), "osm_id", "left").withColumn("cls", osm.road_class(F.col("tags")["highway"]))
    w = w.where(F.col("cls").isNotNull() & (F.size("coords") >= 2) & (F.col("source") != F.col("target")))
    return w.withColumn("length_m", geo.polyline_m(F.col("coords"))).where("length_m > 0")


def derive_edges(ways: DataFrame, tags: DataFrame) -> DataFrame:
    """Edge attributes of ``ways`` (osm_id, gid, source, target, coords) and ``tags`` (osm_id, tags map).

    What isn't kept is skipped before it is numbered, so a way's numbers have no
    holes. Edge ids follow (osm_id, gid), forward before reverse. Offsets have a
    row per way and are merged as well.
    """
    w = kept_ways(ways, tags)
    w = w.withColumn("seq", F.row_number().over(Window.partitionBy("osm_id").orderBy("gid")) - 1)
    tag = lambda k: F.col("tags")[k]
    w = w.withColumn("dirs", osm.directions(tag("oneway"), tag("junction"), F.col("cls")))
    e = w.withColumn("one_way", F.size("dirs") == 1).withColumn("dir", F.explode("dirs"))
    forward = F.col("dir") == "F"
    own = F.when(forward, tag("lanes:forward")).otherwise(tag("lanes:backward"))
    e = e.withColumn("lanes_effective", osm.effective_lanes(own, tag("lanes"), F.col("one_way"), F.col("cls")))
    e = e.withColumn("maxspeed_kmh", F.coalesce(osm.speed_kmh(tag("maxspeed")), osm.of_class(osm.SPEED_KMH, F.col("cls"))))
    # Numbers within a way, and where each way begins.
    e = e.withColumn("in_way", F.row_number().over(Window.partitionBy("osm_id").orderBy("gid", "dir")))
    sizes = numbered(e.groupBy("osm_id").agg(F.count(F.lit(1)).alias("k")), "offset", "osm_id", weight="k")
    e = e.join(sizes.select("osm_id", "offset").hint("merge"), "osm_id")
    return e.select(
        format_segment_id(F.col("osm_id"), F.col("seq"), F.col("dir")).alias("segment_id"),
        (F.col("offset") + F.col("in_way") - 1).cast("int").alias("edge_id"),
        F.when(forward, F.col("source")).otherwise(F.col("target")).cast("int").alias("source_node"),
        F.when(forward, F.col("target")).otherwise(F.col("source")).cast("int").alias("target_node"),
        F.col("osm_id").cast("long").alias("osm_way_id"),
        F.col("cls").alias("highway_class"),
        "lanes_effective",
        "length_m",
        "maxspeed_kmh",
        osm.freeflow_s(F.col("length_m"), F.col("maxspeed_kmh")).alias("freeflow_time_s"),
        osm.capacity_vph(F.col("lanes_effective"), F.col("cls")).alias("capacity_vph"),
        F.when(forward, F.col("coords")).otherwise(F.reverse("coords")).alias("geometry"),
    )


def skip_report(ways: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: sub-segments skipped for their class, and for their form."""
    w = ways.withColumn("coords", F.transform("coords", lambda p: F.transform(p, lambda x: F.round(x, 7))))
    w = w.join(tags, "osm_id", "left")
    known = osm.road_class(F.col("tags")["highway"]).isNotNull()
    flat = (F.size("coords") < 2) | (F.col("source") == F.col("target")) | (geo.polyline_m(F.col("coords")) <= 0)
    return w.agg(F.count_if(~known).alias("skipped_class"), F.count_if(known & flat).alias("skipped_degenerate"))


def bounding_box(lines: DataFrame, coords: str = "geometry") -> DataFrame:
    """lon_min, lat_min, lon_max, lat_max over all coordinates of edges, or of the ways
    that become edges: each gives at least one, with the same coordinates."""
    p = lines.select(F.explode(coords).alias("p"))
    lon, lat = F.col("p")[0], F.col("p")[1]
    return p.agg(F.min(lon).alias("lon_min"), F.min(lat).alias("lat_min"), F.max(lon).alias("lon_max"), F.max(lat).alias("lat_max"))
