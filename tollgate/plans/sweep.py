"""Comparing strategies over demand levels, and vehicle simulations of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.cost import Bpr
from ..functions.demand import departure_spread, factor_of_seconds, hash_uniform
from ..operators import kernels as K
from ..operators.assign import PATHS, ROUTERS, Price, assign, weighted
from ..operators.evaluate import evaluate, poa_by_level, tail
from ..operators.network import Network
from ..session import cut, drop_steps
from ..sources.odset import requests_at, synthesize


@dataclass(frozen=True)
class Level:
    name: str
    scale: float
    target_vc: float


# Capacity scales of the levels, demand and size of an origin–destination set, tick.
LEVELS = (Level("vc0.5", 2.0, 0.5), Level("vc0.8", 1.25, 0.8), Level("vc1.0", 1.0, 1.0), Level("vc1.2", 0.84, 1.2))
DEMAND_VPH, REQUESTS, TICK_S, MAX_TICKS, WINDOW_S = 5000.0, 1000, 30.0, 10_000, 3600.0


def cell(network: Network, requests: DataFrame, router: str, level: Level, price: Price | None = None, load=None) -> DataFrame:
    """One row: the metrics of a strategy at a level. All strategies see zero load before."""
    price = price or Price(scale=level.scale)
    a = assign(router, network, requests, price, load)
    m = evaluate(network, a.routes, a.flow_table(network), Bpr(price.alpha, price.beta, price.scale))
    return m.select(F.lit(router).alias("router"), F.lit(level.name).alias("demand_level"), F.lit(level.target_vc).alias("target_vc"), F.lit(level.scale).alias("capacity_scale"), *m.columns, F.lit(a.iterations).alias("iters"), F.lit(a.converged).alias("converged"), F.lit(float(a.gap)).alias("gap"))


def experienced(network: Network, requests: DataFrame, level: Level) -> dict[str, float]:
    """Mean and tail of the times that a level's vehicles experience, 0 without any.

    All requests are released as they depart; whoever is released answers to
    the load built up so far, whatever strategy the level's other numbers are of.
    """
    out = requests if "depart_s" in requests.columns else requests.withColumn("depart_s", F.lit(0.0))
    _, trips = simulations(network, out, ("reactive",), Price(scale=level.scale))
    mean = trips.agg(F.coalesce(F.avg("time_s"), F.lit(0.0)).alias("m")).first()["m"]
    return {"sim_mean_realized_s": mean, "sim_p95_realized_s": tail(trips, "time_s", 0.95)}


def sweep(network: Network, requests: DataFrame, levels=LEVELS, routers=ROUTERS, simulated: bool = True) -> DataFrame:
    """A row per level and strategy, with the price of anarchy against the level's optimum
    and, if ``simulated``, the times that vehicles experience at the level.

    The rows are metrics, a few dozen in all; each is collected when it is made,
    so that a loop's plan isn't run twice. Requests are made once and kept as a
    table until then.
    """
    rows, held = [], cut(requests)
    for lv in levels:
        seen = experienced(network, held, lv) if simulated else {}
        rows += [cell(network, held, r, lv).first().asDict() | seen for r in routers]
    drop_steps(held)
    made = network.edges.sparkSession.createDataFrame([Row(**r) for r in rows])
    return poa_by_level(made.withColumn("total_s", F.col("total_network_time_s"))).drop("total_s")


def run_single(network: Network, requests: DataFrame, router: str, level: Level = LEVELS[2]) -> DataFrame:
    """A strategy and the optimum it is held against."""
    return sweep(network, requests, (level,), tuple(dict.fromkeys((router, "systemoptimal"))), simulated=False)


def static_poa(network: Network, requests: DataFrame, level: Level = LEVELS[2]) -> DataFrame:
    """Each strategy's price of anarchy as the live view shows it: never below 1."""
    return sweep(network, requests, (level,), simulated=False).select("router", F.greatest(F.lit(1.0), F.col("poa")).alias("static_poa"))


def trips_at(network: Network, seed: int, start_s: float, count: int = REQUESTS, window_s: float = WINDOW_S) -> DataFrame:
    """Requests of a simulated hour: demand follows the clock, in size and in time."""
    od = synthesize(network, count, DEMAND_VPH * factor_of_seconds(start_s), seed)
    return requests_at(od, departure_spread(network.edges.sparkSession, start_s, window_s, count))


def simulations(network: Network, requests: DataFrame, routers=ROUTERS, price: Price = Price(), tick_s: float = TICK_S, max_ticks: int = MAX_TICKS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(ticks, trips) of one simulation per strategy.

    A simulation is one sequence of steps, so a strategy is one task and all
    strategies run side by side. Vehicles that one tick releases for one pair
    move alike: a task gets them as one cohort, and its time goes to each
    request, so neither a task nor the driver holds the requests. While it runs
    only ``reactive`` looks at the load; ``multipath`` draws as it does for a
    single request, always the same way for a pair; the others drive the
    free-flow path.
    """
    spark = network.edges.sparkSession
    asked = weighted(requests).select("idx", "src", "dst", "weight", released(F.col("depart_s"), tick_s).alias("release"))
    # Equal weights are counted and summed in their order, so that equal runs have equal sums.
    alike = cut(asked.groupBy("release", "src", "dst", "weight").agg(F.count(F.lit(1)).alias("n")))
    graph = network.broadcast
    u = spark.range(1).select(hash_uniform(seed, F.lit(0)).alias("u")).first()["u"]

    def route_by(name, g):
        memo: dict[tuple[int, int], list[int]] = {}
        free = price.of(g, np.zeros(g.edges))

        def path(s, d, w):
            dist, via = K.search(g, s, w, [d])
            if d not in dist:
                raise ValueError(f"no path from node {s} to node {d}")
            return K.path_to(g, via, s, d)

        def drawn(s, d):
            found = K.k_shortest(g, s, d, PATHS, free)
            shares, total, k = K.split([c for c, _ in found]), 0.0, 0
            for k, x in enumerate(shares):
                total += x
                if u < total:
                    break
            return found[k][1]

        def route(batch, load):
            w = price.of(g, load) if name == "reactive" else free
            now = {} if name == "reactive" else memo
            for s, d in batch:
                if (s, d) not in now:
                    now[s, d] = drawn(s, d) if name == "multipath" else path(s, d, w)
            return [now[s, d] for s, d in batch]

        return route

    schema = pa.schema([("kind", pa.string()), ("algo", pa.string()), ("tick", pa.int32()), ("in_flight", pa.int32()), ("completed", pa.int32()), ("load", pa.list_(pa.float64())), ("release", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("time_s", pa.float64())])

    def simulated(name, parts):
        g, held = graph.value[0], cohorts_of(parts)
        rows = []
        for t, f, c, load, ended, times in K.simulate(g, held, route_by(name, g), tick_s, max_ticks, price.alpha, price.beta, price.scale):
            rows.append({"kind": "tick", "algo": name, "tick": t, "in_flight": f, "completed": c, "load": load.tolist()})
            if len(rows) == 64:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
            if len(ended):
                own = {"kind": pa.array(["trip"] * len(ended)), "algo": pa.array([name] * len(ended)), "tick": pa.array(np.full(len(ended), t, dtype=np.int32)), "release": pa.array(held[0][ended]), "src": pa.array(held[1][ended].astype(np.int32)), "dst": pa.array(held[2][ended].astype(np.int32)), "time_s": pa.array(times)}
                yield pa.RecordBatch.from_arrays([own.get(x.name, pa.nulls(len(ended), x.type)) for x in schema], schema=schema)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches):
        name, parts = None, []
        for batch in batches:
            algo = np.array(batch.column(0).to_pylist())
            cuts = [0, *(np.flatnonzero(algo[1:] != algo[:-1]) + 1).tolist(), len(algo)] if len(algo) else []
            for a, b in zip(cuts, cuts[1:]):
                if algo[a] != name:
                    if name is not None:
                        yield from simulated(name, parts)
                    name, parts = str(algo[a]), []
                own = batch.slice(a, b - a)
                own = own.filter(own.column("release").is_valid())
                parts.append([own.column(c).to_numpy(zero_copy_only=False) for c in ("release", "src", "dst", "weight", "n")])
        if name is not None:
            yield from simulated(name, parts)

    names = spark.createDataFrame([(r,) for r in routers], "algo string")
    # Each strategy has a row without a cohort, so that it runs even if there is none.
    sent = names.select("algo", *(F.lit(None).cast(alike.schema[c].dataType).alias(c) for c in alike.columns)).unionByName(alike.crossJoin(F.broadcast(names)).select("algo", *alike.columns))
    sent = sent.repartition(len(routers), "algo").sortWithinPartitions("algo", F.col("release").asc_nulls_first(), "src", "dst", "weight")
    out = cut(sent.mapInArrow(run, "kind string, algo string, tick int, in_flight int, completed int, load array<double>, release long, src int, dst int, time_s double"))
    times = out.where("kind = 'trip'").groupBy("release", "src", "dst").agg(F.collect_list(F.struct("algo", "time_s")).alias("ends"))
    trips = asked.join(times.hint("merge"), ["release", "src", "dst"]).select("idx", F.explode("ends").alias("end")).select("end.algo", "idx", "end.time_s")
    return out.where("kind = 'tick'").select("algo", "tick", "in_flight", "completed", "load"), trips


def released(depart_s: Column, tick_s: float) -> Column:
    """The first tick that begins at ``depart_s`` or later; tick k begins at (k - 1) tick_s."""
    k = F.greatest(F.lit(0), F.ceil(depart_s / F.lit(float(tick_s)))).cast("long")
    begins = lambda n: n.cast("double") * F.lit(float(tick_s))
    return F.when(begins(k) < depart_s, k + 1).when((k > 0) & (begins(k - 1) >= depart_s), k - 1).otherwise(k) + 1


def cohorts_of(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Release tick, from, to, summed weight and number of each cohort, from rows (release, src, dst, weight, n) in order."""
    release, src, dst, weight, n = (np.concatenate(x) for x in zip(*parts))
    if not len(release):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64, np.int64))
    first = np.flatnonzero(np.concatenate([[True], (release[1:] != release[:-1]) | (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]))
    return release[first].astype(np.int64), src[first].astype(np.int64), dst[first].astype(np.int64), np.add.reduceat(weight.astype(float) * n, first), np.add.reduceat(n.astype(np.int64), first)


def tick_states(ticks: DataFrame, network: Network, scale: float = 1.0) -> DataFrame:
    """(algo, tick, edge_id, segment_id, load_vph, vc) of every edge at every tick."""
    long = ticks.select("algo", "tick", F.posexplode("load").alias("edge_id", "load_vph"))
    e = network.edges.select("edge_id", "segment_id", "capacity_vph")
    vc = F.when(F.col("capacity_vph") > 0, F.col("load_vph") / (F.col("capacity_vph") * scale)).otherwise(F.lit(0.0))
    return long.join(e, "edge_id").select("algo", "tick", "edge_id", "segment_id", "load_vph", vc.alias("vc"))
