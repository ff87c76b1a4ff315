"""Contract checks of edge tables: everything that is wrong, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, osm
from ..functions.segment import parse_segment_id

# Fixed tolerances: length against chord, and a shared node's coordinates in degrees.
LENGTH_TOLERANCE, NODE_TOLERANCE = 1e-9, 1e-7


class InvalidEdges(ValueError):
    pass


def positive(x: Column) -> Column:
    """Finite and over zero; NaN, which sorts above infinity, is told apart."""
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def row_violation(bounds: tuple[float, float, float, float] | None = None, total: Column | None = None) -> Column:
    """The first rule that a row breaks, null if none. ``bounds``: lon_min, lon_max, lat_min, lat_max."""
    seg, geom = parse_segment_id(F.col("segment_id")), F.col("geometry")
    lon, lat = (lambda p: p[0]), (lambda p: p[1])
    ends = F.element_at(geom, 1), F.element_at(geom, -1)
    chord = geo.haversine_m(ends[0][1], ends[0][0], ends[1][1], ends[1][0])
    rules = [
        ("segment_id", seg.isNull()),
        ("segment_id names another way", seg["way"] != F.col("osm_way_id")),
        ("osm_way_id", F.coalesce(F.col("osm_way_id") < 1, F.lit(True))),
        ("highway_class", ~F.coalesce(F.col("highway_class").isin(*osm.CLASSES), F.lit(False))),
        ("lanes_effective", F.coalesce(F.col("lanes_effective") < 1, F.lit(True))),
        ("length_m", ~positive(F.col("length_m"))),
        ("maxspeed_kmh", ~positive(F.col("maxspeed_kmh"))),
        ("freeflow_time_s", ~positive(F.col("freeflow_time_s"))),
        ("capacity_vph", ~positive(F.col("capacity_vph"))),
        ("fewer than two coordinates", F.coalesce(F.size(geom) < 2, F.lit(True))),
        ("coordinate is not a pair", F.exists(geom, lambda p: F.size(p) != 2)),
        ("longitude", F.exists(geom, lambda p: (lon(p) < -180) | (lon(p) > 180))),
        ("latitude", F.exists(geom, lambda p: (lat(p) < -90) | (lat(p) > 90))),
    ]
    if bounds:
        rules.append(("outside the expected region", F.exists(geom, lambda p: (lon(p) < bounds[0]) | (lon(p) > bounds[1]) | (lat(p) < bounds[2]) | (lat(p) > bounds[3]))))
    rules.append(("shorter than its chord", F.col("length_m") < chord * (1 - LENGTH_TOLERANCE)))
    if total is not None:
        rules.append(("edge_id out of range", F.coalesce((F.col("edge_id") < 0) | (F.col("edge_id") >= total), F.lit(True))))
    rules += [("source_node", F.coalesce(F.col("source_node") < 0, F.lit(True))), ("target_node", F.coalesce(F.col("target_node") < 0, F.lit(True)))]
    out = F.when(rules[0][1], rules[0][0])
    for name, broken in rules[1:]:
        out = out.when(broken, name)
    return out


def violations(edges: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(row, violation) of every row that breaks a rule. ``edges`` carries its order in ``row``.

    After a row's own rules come those between rows, always against the first
    row: ids that repeat, and nodes whose coordinates disagree.
    """
    n = edges.agg(F.count(F.lit(1)).alias("total"))
    own = edges.join(F.broadcast(n)).withColumn("violation", row_violation(bounds, F.col("total")))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("row")) > 1
    own = own.withColumn("violation", F.coalesce("violation", F.when(first("edge_id"), "edge_id repeats").when(first("segment_id"), "segment_id repeats")))
    ends = own.where("violation is null").select("row", F.explode(F.array(F.struct(F.col("source_node").alias("ref"), F.lit(0).alias("end"), F.element_at("geometry", 1).alias("p")), F.struct(F.col("target_node").alias("ref"), F.lit(1).alias("end"), F.element_at("geometry", -1).alias("p")))).alias("e")).select("row", "e.*")
    seen = ends.withColumn("q", F.first("p").over(Window.partitionBy("ref").orderBy("row", "end")))
    moved = seen.where((F.abs(F.col("p")[0] - F.col("q")[0]) > NODE_TOLERANCE) | (F.abs(F.col("p")[1] - F.col("q")[1]) > NODE_TOLERANCE))
    return own.where("violation is not null").select("row", "violation").union(moved.select("row", F.lit("node stands elsewhere")).distinct())


def checked(edges: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``edges``, or an error that names the first row that breaks a rule: all or nothing."""
    bad = violations(edges, bounds).orderBy("row", "violation").limit(1).collect()
    if bad:
        raise InvalidEdges(f"row {bad[0]['row']}: {bad[0]['violation']}")
    return edges
