"""The road graph as DataFrames and, where a kernel needs it, as one broadcast."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..session import cut, drop_steps
from .kernels import Csr, Reach
from .ranking import numbered

#: Edges that a broadcast graph may have; about 60 bytes each.
MAX_EDGES = 5_000_000


@dataclass
class Network:
    """nodes(node_id, lat, lon); edges(edge_id, segment_id, src, dst, length_m, freeflow_s, capacity_vph)."""

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def arrays(self) -> tuple[Csr, np.ndarray, np.ndarray]:
        """The graph on the driver, after a check of its size; ids have to be dense."""
        n = self.edges.count()
        if n > MAX_EDGES:
            raise ValueError(f"{n} edges; a broadcast graph may have {MAX_EDGES}: cut the network into regions")
        e = self.edges.select("edge_id", "src", "dst", "freeflow_s", "capacity_vph", "length_m").orderBy("edge_id").toArrow()
        v = self.nodes.select("node_id", "lat", "lon").orderBy("node_id").toArrow()
        cols = {c: e[c].to_numpy() for c in e.column_names}
        if (cols["edge_id"] != np.arange(n)).any() or (v["node_id"].to_numpy() != np.arange(len(v))).any():
            raise ValueError("node and edge ids have to be dense from 0")
        if n and (min(cols["src"].min(), cols["dst"].min()) < 0 or max(cols["src"].max(), cols["dst"].max()) >= len(v)):
            raise ValueError("an edge ends at a node that isn't there")
        g = Csr.build(len(v), cols["src"], cols["dst"], cols["freeflow_s"], cols["capacity_vph"], cols["length_m"])
        return g, v["lat"].to_numpy(), v["lon"].to_numpy()

    @cached_property
    def broadcast(self):
        return self.edges.sparkSession.sparkContext.broadcast(self.arrays)

    def with_load(self, load: DataFrame) -> DataFrame:
        """Edges with load_vph; an edge without an observation has 0."""
        return self.edges.join(load.select("edge_id", "load_vph"), "edge_id", "left").withColumn("load_vph", F.coalesce("load_vph", F.lit(0.0)))


def out_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adjacency: the edges that leave each node, in the order of their ids."""
    return nodes.join(edges.withColumnRenamed("src", "node_id"), "node_id").select("node_id", "edge_id", "dst")


def reach_of(edges: DataFrame) -> Reach:
    """What the nodes of ``edges`` reach, after a check of their number."""
    n = edges.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges; a broadcast graph may have {MAX_EDGES}: cut the network into regions")
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow()
    return Reach(e["src"].to_numpy(), e["dst"].to_numpy())


def reachable_pairs(edges: DataFrame, itself: bool = False) -> DataFrame:
    """(src, dst), all ordered pairs with a path; with ``itself`` also each node with itself.

    One search over the graph of strongly connected components for each of
    them, side by side; pairs are put out as they are found and never joined.
    """
    spark, reach = edges.sparkSession, reach_of(edges)
    sent = spark.sparkContext.broadcast(reach)

    def run(batches):
        r = sent.value
        for batch in batches:
            for c in batch.column(0).to_pylist():
                to = r.ids[r.nodes_of(c)]
                for s in r.ids[r.members[c]].tolist():
                    ends = to if itself else to[to != s]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), s), pa.int32()), pa.array(ends, pa.int32())], names=["src", "dst"])

    return spark.range(reach.parts).mapInArrow(run, "src int, dst int")


def draw_pairs(edges: DataFrame, draws: DataFrame) -> tuple[DataFrame, int]:
    """``draws`` (idx, u) with src and dst, the pair at place floor(u * n) of all ``n``
    reachable pairs in ascending order, and ``n``; no pair but those drawn is made.

    How many nodes a component reaches is counted side by side; the driver holds
    one running sum per node, as many as the graph that was checked has.
    """
    spark, reach = edges.sparkSession, reach_of(edges)
    sent = spark.sparkContext.broadcast(reach)

    def count(batches):
        for batch in batches:
            c = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array([len(sent.value.nodes_of(x)) for x in c], pa.int64())], names=["part", "n"])

    sizes = np.zeros(reach.parts, dtype=np.int64)
    for r in spark.range(reach.parts).mapInArrow(count, "part long, n long").toLocalIterator():
        sizes[r["part"]] = r["n"]
    ends = np.cumsum(sizes[reach.comp] - 1)
    n = int(ends[-1]) if len(ends) else 0
    if n == 0:
        return draws.limit(0).select("*", F.lit(0).alias("src"), F.lit(0).alias("dst")), 0
    places = spark.sparkContext.broadcast(ends)

    def pick(batches):
        r, known = sent.value, {}
        for batch in batches:
            at = batch.column("pick").to_numpy(zero_copy_only=False)
            src = np.searchsorted(places.value, at, side="right")
            k = at - np.where(src > 0, places.value[src - 1], 0)
            dst = np.empty(len(at), dtype=np.int64)
            for i in np.argsort(r.comp[src], kind="stable"):
                c = int(r.comp[src[i]])
                if c not in known:
                    known = {c: r.nodes_of(c)}
                to = known[c]
                dst[i] = to[k[i] + (to[k[i]] >= src[i])]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(r.ids[src], pa.int32()), pa.array(r.ids[dst], pa.int32())], names=[*names, "src", "dst"])

    names = draws.columns
    schema = T.StructType([*draws.schema.fields, T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType())])
    return draws.withColumn("pick", F.least(F.floor(F.col("u") * n), F.lit(n - 1))).mapInArrow(pick, schema), n


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node id reached without regard to direction.

    Labels move to the least label around, then jump to their label's label.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("a", "b").distinct())
    label = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        seen = both.join(label.withColumnRenamed("node_id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(seen, label["node_id"] == seen["a"], "left").select("node_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("node_id").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component", "left").select("node_id", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        drop_steps(label)
        label = new.select("node_id", "component")
        if new.where("old <> component").isEmpty():
            drop_steps(both)
            return label


def component_report(labels: DataFrame, sample: int = 10) -> DataFrame:
    """One row: components, the largest (ties: least label) with its size and share of nodes, and the
    least ids outside it, ascending."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"), F.max_by("component", F.struct("size", -F.col("component"))).alias("largest"), F.max("size").alias("largest_size"))
    outside = labels.join(F.broadcast(largest), labels["component"] != largest["largest"]).select("node_id").orderBy("node_id").limit(sample).agg(F.array_sort(F.collect_list("node_id")).alias("outside"))
    return largest.join(outside).select("components", "largest", "largest_size", (F.col("largest_size") / F.col("nodes")).alias("fraction"), "outside")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def nearest_node(points: DataFrame, nodes: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """``points`` (point_id, lat, lon) with node_id and distance_m of the nearest node; ties: least id.

    A point looks into the nine cells of a grid around it, and is settled if it
    finds a node nearer than anything outside them could be. Only the rest goes
    on to a grid with cells four times as wide; the widest holds all nodes.
    Points by the date line are settled there.
    """
    n = cut(nodes.select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon")))
    rest, out = cut(points.select("point_id", "lat", "lon")), None
    while True:
        last = cell_deg >= 180
        around = F.sequence(F.lit(-1 if not last else -2), F.lit(1 if not last else 2))
        asked = rest.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
        asked = asked.withColumn("ci", _cell(F.col("lat"), cell_deg) + F.col("di")).withColumn("cj", _cell(F.col("lon"), cell_deg) + F.col("dj"))
        grid = n.withColumn("ci", _cell(F.col("nlat"), cell_deg)).withColumn("cj", _cell(F.col("nlon"), cell_deg))
        d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
        best = asked.join(grid, ["ci", "cj"]).withColumn("d", d).groupBy("point_id").agg(F.min(F.struct("d", "node_id")).alias("best"))
        # What lies outside the nine cells is at least one cell away; longitudes shrink with latitude.
        away = geo.EARTH_RADIUS_M * 0.017453292519943295 * cell_deg * F.cos(F.radians(F.least(F.abs("lat") + 2 * cell_deg, F.lit(90.0))))
        sure = F.col("best").isNotNull() & (F.lit(last) | ((F.col("best.d") <= away * 0.99) & (F.abs("lon") + 2 * cell_deg < 180)))
        found = cut(rest.join(best, "point_id", "left").withColumn("sure", sure))
        settled = found.where("sure").select("point_id", "lat", "lon", "best.node_id", F.col("best.d").alias("distance_m"))
        out = settled if out is None else out.union(settled)
        rest = found.where("not sure").select("point_id", "lat", "lon")
        if last or rest.isEmpty():
            return out
        cell_deg *= 4


def match_pings(pings: DataFrame, network: Network, cell_deg: float = 0.01, radius_m: float = 60.0, metres_per_degree: float = 0.5) -> DataFrame:
    """Pings (ping_id, lat, lon, heading_deg) with edge_id and distance_m: the nearest edge
    within ``radius_m``, each degree of heading apart costing ``metres_per_degree``.

    Edges stand in each grid cell that their bounding box and the radius touch,
    so that a ping has to look into its own cell alone. Ties: least edge id.
    """
    n = network.nodes.select("node_id", "lat", "lon")
    e = network.edges.select("edge_id", "src", "dst").join(n.toDF("src", "lat1", "lon1"), "src").join(n.toDF("dst", "lat2", "lon2"), "dst")
    pad = radius_m / (geo.EARTH_RADIUS_M * 0.017453292519943295)
    wide = pad / F.cos(F.radians(F.greatest(F.abs("lat1"), F.abs("lat2"))))
    cells = lambda a, b, p: F.sequence(_cell(F.least(a, b) - p, cell_deg), _cell(F.greatest(a, b) + p, cell_deg))
    e = e.withColumn("ci", F.explode(cells(F.col("lat1"), F.col("lat2"), F.lit(pad)))).withColumn("cj", F.explode(cells(F.col("lon1"), F.col("lon2"), wide)))
    p = pings.withColumn("ci", _cell(F.col("lat"), cell_deg)).withColumn("cj", _cell(F.col("lon"), cell_deg))
    near = p.join(e, ["ci", "cj"]).withColumn("distance_m", geo.point_to_segment_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).where(F.col("distance_m") <= radius_m)
    turn = F.pmod(F.col("heading_deg") - geo.bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), F.lit(360.0))
    apart = F.coalesce(F.least(turn, F.lit(360.0) - turn), F.lit(0.0))
    return near.withColumn("score", F.round(F.col("distance_m") + metres_per_degree * apart, 6)).groupBy("ping_id").agg(F.min(F.struct("score", "edge_id", "distance_m")).alias("best")).select("ping_id", "best.edge_id", "best.distance_m")


def compact(edges: DataFrame) -> DataFrame:
    """Edges whose sparse node refs become dense ids, in ascending order of the refs."""
    refs = edges.select(F.col("source_node").alias("ref")).union(edges.select("target_node")).distinct()
    ids = numbered(refs, "node_id", "ref").select("ref", "node_id")
    a, b = ids.toDF("source_node", "src"), ids.toDF("target_node", "dst")
    return edges.join(a, "source_node").join(b, "target_node")
