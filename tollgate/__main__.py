"""python -m tollgate route | benchmark: answers from an edge table in GeoJSON."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.assign import ROUTERS, NoRoute
from .operators.network import Network, compact
from .plans import api, report, sweep
from .sources.geojson import read_edges
from .sources.load import load_from
from .sources.odset import synthesize


def network_of(spark: SparkSession, path: str) -> Network:
    """The network of a checked edge table; nodes stand where their edges end."""
    e = compact(read_edges(spark, path)).cache()
    ends = e.select(F.col("src").alias("node_id"), F.element_at("geometry", 1).alias("p")).union(e.select("dst", F.element_at("geometry", -1)))
    nodes = ends.groupBy("node_id").agg(F.first("p").alias("p")).select(F.col("node_id").cast("int").alias("node_id"), F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))
    edges = e.select(F.col("edge_id").cast("int").alias("edge_id"), "segment_id", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "length_m", F.col("freeflow_time_s").alias("freeflow_s"), "capacity_vph")
    return Network(nodes, edges)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tollgate")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("route", help="one path between two places")
    r.add_argument("--from", dest="origin", type=api.place, required=True)
    r.add_argument("--to", dest="destination", type=api.place, required=True)
    r.add_argument("--algo", choices=("naive", "reactive"), default="naive")
    r.add_argument("--congestion", default="")
    r.add_argument("--jam")
    b = sub.add_parser("benchmark", help="all strategies at all levels")
    b.add_argument("--count", type=int, default=sweep.REQUESTS)
    b.add_argument("--seed", type=int, default=20260618)
    for x in (r, b):
        x.add_argument("--graph", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tollgate").getOrCreate()
    net = network_of(spark, a.graph)
    if a.command == "benchmark":
        cells = sweep.sweep(net, synthesize(net, a.count, sweep.DEMAND_VPH, a.seed).withColumnRenamed("id", "request_id"))
        print(report.markdown(cells, ROUTERS))
        return 0
    q = spark.createDataFrame([("request", 0, *a.origin, *a.destination, 1.0)], "request_id string, idx long, from_lat double, from_lon double, to_lat double, to_lon double, weight double")
    load = np.array([x["load_vph"] for x in load_from(net, a.congestion, a.jam).orderBy("edge_id").collect()])
    try:
        found = api.route(api.snap(q, net), net, a.algo, load).first()
    except NoRoute as e:
        print(e)
        return 1
    print(" -> ".join(found["segments"]))
    print(f"cost_s {found['cost_s']:.1f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
