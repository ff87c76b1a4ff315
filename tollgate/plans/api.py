"""The query surface: what a service would answer, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import Bpr
from ..operators.assign import ROUTERS, Price, assign
from ..operators.congestion import snapshot
from ..operators.frames import deltas, due_ticks, frame_json
from ..operators.network import Network, nearest_node
from . import sweep

DEFAULTS = {"algorithm": "all", "alpha": 0.15, "beta": 4.0, "capacity_scale": 1.0, "request_count": 1000, "seed": 0}


def parameters(**given) -> dict:
    """Benchmark parameters with defaults; 0 counts as not given. Raises on what can't be run."""
    out = {k: given.get(k) or d for k, d in DEFAULTS.items()}
    if unknown := set(given) - set(DEFAULTS):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if out["algorithm"] not in ("all", *ROUTERS):
        raise ValueError(f"algorithm must be all or one of {', '.join(ROUTERS)}")
    if out["alpha"] < 0 or out["beta"] < 0 or out["capacity_scale"] <= 0 or out["request_count"] < 0:
        raise ValueError("alpha and beta must not be negative, capacity_scale must be positive, request_count not negative")
    return out


def cache_key(**given) -> str:
    """One text for all ways to ask for the same run."""
    p = parameters(**given)
    return "|".join(f"{k}={p[k]:g}" if isinstance(p[k], float) else f"{k}={p[k]}" for k in DEFAULTS)


def place(text: str) -> tuple[float, float]:
    """Latitude and longitude from "lat,lon"."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError("a place is written as lat,lon")
    return float(parts[0]), float(parts[1])


def stream_parameters(**given) -> dict:
    """Replay parameters with defaults; raises on what is out of bounds."""
    out = {"start": "2026-06-22T08:00:00Z", "speed": 30.0, "tick_hz": 1.0, "seed": 0, "count": 1000, "capacity_scale": 1.0} | given
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", out["start"]):
        raise ValueError("start must be an instant such as 2026-06-22T08:00:00Z")
    if not 0 < out["speed"] <= 100_000 or not 0.5 <= out["tick_hz"] <= 2 or out["count"] < 0 or out["capacity_scale"] <= 0:
        raise ValueError("speed must be in (0, 100000], tick_hz in [0.5, 2], count not negative, capacity_scale positive")
    return out | {"count": out["count"] or 1000}


def snap(requests: DataFrame, network: Network) -> DataFrame:
    """Requests (request_id, from_lat, from_lon, to_lat, to_lon, ...) with src and dst; each distinct
    place is looked up once."""
    ends = requests.select(F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")).union(requests.select("to_lat", "to_lon")).distinct().withColumn("point_id", F.concat_ws(",", "lat", "lon"))
    at = nearest_node(ends, network.nodes).select("lat", "lon", "node_id")
    a, b = at.toDF("from_lat", "from_lon", "src"), at.toDF("to_lat", "to_lon", "dst")
    return requests.join(a, ["from_lat", "from_lon"]).join(b, ["to_lat", "to_lon"])


def route(requests: DataFrame, network: Network, algo: str = "naive", load=None, price: Price = Price()) -> DataFrame:
    """(request_id, algo, cost_s, segments) of requests with src and dst; algo is naive or reactive."""
    if algo not in ("naive", "reactive"):
        raise ValueError("algo must be naive or reactive")
    r = assign(algo, network, requests, price, load).routes
    steps = r.select("request_id", "cost_s", F.posexplode_outer("edges").alias("at", "edge_id")).join(network.edges.select("edge_id", "segment_id"), "edge_id", "left")
    path = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "segment_id")))), lambda x: x["segment_id"])
    return steps.groupBy("request_id").agg(F.first("cost_s").alias("cost_s"), path.alias("segments")).select("request_id", F.lit(algo).alias("algo"), "cost_s", "segments")


def compare(requests: DataFrame, network: Network, load=None, price: Price = Price()) -> DataFrame:
    """Both answers side by side; a request has both or the whole call fails."""
    a, b = (route(requests, network, x, load, price) for x in ("naive", "reactive"))
    return a.select("request_id", F.col("cost_s").alias("naive_s"), F.col("segments").alias("naive_segments")).join(b.select("request_id", F.col("cost_s").alias("reactive_s"), F.col("segments").alias("reactive_segments")), "request_id").withColumn("diverted", F.col("naive_segments") != F.col("reactive_segments"))


def request_counts(requests: DataFrame) -> DataFrame:
    """(endpoint, outcome, requests): how many calls ended how."""
    return requests.groupBy("endpoint", "outcome").agg(F.count(F.lit(1)).alias("requests"))


def congestion(network: Network, load: DataFrame) -> DataFrame:
    return snapshot(network.edges, load)


def stream_frames(network: Network, requests: DataFrame, speed: float = 30.0, tick_hz: float = 1.0, start: str = "2026-06-22T08:00:00Z", **options) -> DataFrame:
    """Snapshot and delta frames of all strategies as JSON, with each tick's metrics: total
    time under the tick's load, and the strategy's static price of anarchy.

    Times of routing aren't measured here, as equal runs are to give equal
    frames; they count as 0.
    """
    tick_s, price = options.get("tick_s", sweep.TICK_S), options.get("price", Price())
    ticks, _ = sweep.simulations(network, requests, **options)
    sent = due_ticks(ticks, tick_s, speed, tick_hz)
    states = sweep.tick_states(sent, network, price.scale).join(sent.select("algo", "tick", "frame"), ["algo", "tick"])
    cost = Bpr(price.alpha, price.beta, price.scale).cost(F.col("freeflow_s"), F.col("load_vph"), F.col("capacity_vph"))
    total = states.join(network.edges.select("edge_id", "freeflow_s", "capacity_vph"), "edge_id").groupBy("algo", "frame").agg(F.sum(F.col("load_vph") * cost).alias("realized_total_s"))
    poa = sweep.static_poa(network, requests, sweep.Level("live", price.scale, 1.0)).select(F.col("router").alias("algo"), F.col("static_poa").alias("poa"))
    told = sent.join(total, ["algo", "frame"]).join(poa, "algo").select("algo", "frame", "tick", "in_flight", "completed", "realized_total_s", "poa", F.lit(0).cast("long").alias("compute_ns"), F.lit(0).cast("long").alias("route_median_ns"))
    return frame_json(deltas(states), told, start, tick_s)
