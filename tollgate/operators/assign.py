"""Assignment strategies: requests in, routes, edge flows and convergence out.

Requests are summed by origin and destination first, so whatever their number,
a strategy searches each distinct pair once and each distinct origin in one
search. Searches run in the executors on a broadcast graph; flows come back as
one sum over the tasks. Loops keep one flow per edge on the driver, which is as large as
the graph that was checked before it was broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demand import hash_uniform
from ..session import cut, drop_steps
from . import kernels as K
from . import layers as L
from .network import Network
from .ranking import numbered

ROUTERS = ("naive", "reactive", "incremental", "msa", "systemoptimal", "multipath")
# Batches of the incremental strategy, paths of the split one, gap and iterations of loops.
BATCHES, PATHS, GAP, ITERATIONS = 4, 3, 1e-4, 100
#: Tasks whose flows the driver sums by itself.
FEW_PARTS = 32


class NoRoute(ValueError):
    """Some request can't be routed; a batch is routed as a whole or not at all."""


@dataclass(frozen=True)
class Price:
    alpha: float = 0.15
    beta: float = 4.0
    scale: float = 1.0

    def __post_init__(self):
        if self.scale <= 0:
            raise ValueError("the capacity scale has to be positive")

    def of(self, g: K.Csr, flow: np.ndarray, marginal: bool = False) -> np.ndarray:
        return K.bpr_cost(g, flow, self.alpha, self.beta, self.scale, marginal)


@dataclass
class Assignment:
    """routes(request_id, idx, edges, cost_s), flows by edge id, and how it ended.

    After a loop the flows are those of the last step, while the routes are the
    last search's; they need not add up to each other.
    """

    routes: DataFrame
    flows: np.ndarray
    gap: float = 0.0
    iterations: int = 1
    converged: bool = True
    paths: DataFrame | None = None

    def flow_table(self, network: Network) -> DataFrame:
        """(edge_id, load_vph) of every edge, zeros included."""
        spark = network.edges.sparkSession
        return spark.createDataFrame(pa.table({"edge_id": pa.array(range(len(self.flows)), pa.int32()), "load_vph": self.flows}))


def weighted(requests: DataFrame) -> DataFrame:
    """Requests (request_id, idx, src, dst, weight); a weight that isn't positive counts as 1."""
    return requests.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0)))


def pair_demand(requests: DataFrame) -> DataFrame:
    """(src, dst, weight), summed over requests with partial sums before the exchange."""
    return weighted(requests).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pair_paths(pairs: DataFrame, network: Network, cost: np.ndarray, accelerated: bool = False) -> DataFrame:
    """Distinct (src, dst) with cost_s and edges; null without a path. Same node: no edges, cost 0.

    Rows are gathered by origin, one search settles all of an origin's
    destinations. ``accelerated`` searches each pair towards its goal instead.
    """
    graph, weight = network.broadcast, network.edges.sparkSession.sparkContext.broadcast(cost)

    def run(batches):
        g, lat, lon = graph.value
        w = weight.value.tolist()
        for batch in batches:
            src, dst = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            cost, edges = [], []
            for s in np.unique(src).tolist():
                ends = dst[src == s].tolist()
                if not accelerated:
                    dist, via = K.search(g, s, w, ends)
                for d in ends:
                    if accelerated:
                        dist, via = K.search(g, s, w, [d], K.goal_bound(g, lat, lon, d))
                    c = dist.get(d, K.INF)
                    cost.append((s, d, None if c == K.INF else c))
                    edges.append(None if c == K.INF else K.path_to(g, via, s, d))
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cost], pa.int32()), pa.array([c[1] for c in cost], pa.int32()), pa.array([c[2] for c in cost], pa.float64()), pa.array(edges, pa.list_(pa.int32()))], names=["src", "dst", "cost_s", "edges"])

    own = pairs.select("src", "dst").distinct().repartition("src").sortWithinPartitions("src", "dst")
    return own.mapInArrow(run, "src int, dst int, cost_s double, edges array<int>")


def least_costs(requests: DataFrame, network: Network, cost: np.ndarray) -> DataFrame:
    """``requests`` (request_id, src, dst) with cost_s, null without a path; no path is made."""
    graph, weight = network.broadcast, network.edges.sparkSession.sparkContext.broadcast(cost)

    def blocks(batches, size):
        """Rows sorted by origin, gathered until they have enough origins and cut between two."""
        held, seen, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            src = batch.column("src").to_numpy(zero_copy_only=False)
            seen += int((src[1:] != src[:-1]).sum()) + (src[0] != last)
            last = src[-1]
            if seen > size and src[0] != last:
                at = int(np.searchsorted(src, last))
                yield [*held, batch.slice(0, at)]
                held, seen, batch = [], 1, batch.slice(at)
            held.append(batch)
        if held:
            yield held

    def run(batches):
        g, w = graph.value[0], weight.value
        for block in blocks(batches, K.many_at_once(g)):
            rows = pa.Table.from_batches(block).combine_chunks()
            src, dst = (rows[c].to_numpy() for c in ("src", "dst"))
            out = np.empty(len(src))
            for at, col, dist, _ in K.trees(g, src, w, tree=False):
                out[at] = dist[dst[at], col]
            yield from pa.table({"request_id": rows["request_id"], "cost_s": pa.array(out, mask=out == K.INF)}).to_batches()

    tasks = 4 * network.edges.sparkSession.sparkContext.defaultParallelism
    own = requests.select("request_id", F.col("src").cast("int"), F.col("dst").cast("int")).repartitionByRange(tasks, "src").sortWithinPartitions("src")
    return own.mapInArrow(run, "request_id string, cost_s double")


def all_or_nothing(demand: by_origin | dealt, network: Network, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Edge flows when all of ``demand`` takes its shortest path, and the sum of weight times cost.

    A task searches its origins, many at once, and adds up its own flows; the
    tasks' arrays, as long as the checked graph has edges, are summed in a tree.
    Where very many origins meet a long graph, matrices of its layers take the
    place of searches, unless the cost leaves many paths alike.
    """
    by_layer = isinstance(demand, dealt) and demand.pays and L.settles(cost)
    if isinstance(demand, dealt):
        demand = demand.by_crossing if by_layer else demand.by_origin
    graph, weight = network.broadcast, network.edges.sparkSession.sparkContext.broadcast(cost)

    def run(parts):
        g, w = graph.value[0], weight.value
        flow, spent, lost = np.zeros(g.edges), 0.0, 0
        held = list(parts)
        if held and by_layer:
            flow, spent, lost = L.loads(L.layers_of(g), w, *(np.concatenate(x) for x in zip(*held)))
        elif held:
            src, dst, many = (np.concatenate(x) for x in zip(*held))
            for rows, col, dist, via in K.trees(g, src, w):
                at, x, cost = dst[rows], many[rows], dist[dst[rows], col]
                lost += int((cost == K.INF).sum())
                spent += float(x[cost < K.INF] @ cost[cost < K.INF])
                on = np.flatnonzero((at != src[rows]) & (cost < K.INF))
                at, col, x, start = at[on], col[on], x[on], src[rows][on]
                # All paths go back by one edge at a time.
                while len(at):
                    e = via[at, col]
                    np.add.at(flow, e, x)
                    at = g.source_of[e]
                    on = at != start
                    at, col, x, start = at[on], col[on], x[on], start[on]
        yield np.append(flow, [spent, lost])

    made = demand.rdd.mapPartitions(run)
    # Few arrays meet on the driver at once, many in a tree before they get there.
    total = made.fold(np.zeros(network.arrays[0].edges + 2), np.add) if made.getNumPartitions() <= FEW_PARTS else made.treeReduce(np.add)
    weight.destroy()
    if total[-1] > 0:
        raise NoRoute("some demand has no path")
    return total[:-2], float(total[-2])


class by_origin:
    """Demand dealt out by origin once, as arrays that stay with the executors for many
    searches; gone when the block ends. What an executor loses is made again."""

    order = ("src", "dst")

    def __init__(self, demand: DataFrame):
        self.rdd = self.packed(demand.select(F.col("src").cast("int"), F.col("dst").cast("int"), F.col("weight").cast("double")))

    def packed(self, own: DataFrame):
        names, kinds = own.columns, [np.float64 if kind == "double" else np.int32 for _, kind in own.dtypes]

        def arrays(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns], names=names)

        # Origins with near ids are searched at once, over as many tasks as can run.
        own = own.repartitionByRange(own.sparkSession.sparkContext.defaultParallelism, *self.order).sortWithinPartitions(*self.order)
        packed = own.mapInArrow(arrays, ", ".join(f"{c} binary" for c in names))
        return packed.rdd.map(lambda r: tuple(np.frombuffer(x, kind) for x, kind in zip(r, kinds))).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> "by_origin":
        return self

    def __exit__(self, *_) -> None:
        self.rdd.unpersist()


class by_crossing(by_origin):
    """Demand dealt out by the layer that its paths cross, which is its fourth array."""

    order = ("crossing", "src", "dst")

    def __init__(self, demand: DataFrame, network: Network):
        graph = network.broadcast

        def crossed(batches):
            layers = L.layers_of(graph.value[0])
            for batch in batches:
                src, dst = (layers.layer[batch.column(k).to_numpy(zero_copy_only=False)] for k in range(2))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(L.crossing(layers.count, src, dst).astype(np.int32))], names=["src", "dst", "weight", "crossing"])

        own = demand.select(F.col("src").cast("int"), F.col("dst").cast("int"), F.col("weight").cast("double"))
        self.rdd = self.packed(own.mapInArrow(crossed, "src int, dst int, weight double, crossing int"))


class dealt:
    """Demand of a loop, dealt out either way when a step asks for it; on graphs too small for
    matrices only by origin."""

    def __init__(self, demand: DataFrame, network: Network):
        self.network, self.held, self.pays = network, None, False
        g = network.arrays[0]
        if g.nodes**2 >= L.LARGE:
            demand = self.held = cut(demand)
            self.pays = L.pays(g, demand.select("src").distinct().count())
        self.demand = demand

    @cached_property
    def by_origin(self) -> "by_origin":
        return by_origin(self.demand)

    @cached_property
    def by_crossing(self) -> "by_crossing":
        return by_crossing(self.demand, self.network)

    def __enter__(self) -> "dealt":
        return self

    def __exit__(self, *_) -> None:
        for name in ("by_origin", "by_crossing"):
            if name in self.__dict__:
                self.__dict__[name].rdd.unpersist()
        if self.held is not None:
            drop_steps(self.held)


def _routes(requests: DataFrame, paths: DataFrame) -> DataFrame:
    return requests.join(paths, ["src", "dst"]).select("request_id", "idx", "edges", "cost_s")


def _all_or_nothing(network: Network, requests: DataFrame, price: Price, load: np.ndarray | None) -> Assignment:
    g = network.arrays[0]
    cost = price.of(g, np.zeros(g.edges) if load is None else load)
    with by_origin(pair_demand(requests)) as demand:
        flow, _ = all_or_nothing(demand, network, cost)
    return Assignment(_routes(requests, pair_paths(requests, network, cost)), flow)


def naive(network: Network, requests: DataFrame, price: Price = Price(), load: np.ndarray | None = None) -> Assignment:
    """All on the free-flow shortest path, whatever the load."""
    return _all_or_nothing(network, requests, price, None)


def reactive(network: Network, requests: DataFrame, price: Price = Price(), load: np.ndarray | None = None) -> Assignment:
    """All on the shortest path under one frozen load; without load the same as naive."""
    return _all_or_nothing(network, requests, price, load)


def relative_gap(spent: float, least: float) -> float:
    return 0.0 if least <= 0 else abs(spent - least) / least


def incremental(network: Network, requests: DataFrame, price: Price = Price(), load=None, batches: int = BATCHES) -> Assignment:
    """Equal runs of requests in the order of their index (the first takes the remainder),
    each priced on what is loaded so far. Indexes may be sparse."""
    g = network.arrays[0]
    placed = numbered(requests, "batch_place", "idx", "request_id")
    n = placed.count()
    flow, routes = np.zeros(g.edges), None
    size, first = divmod(n, batches)
    at = 0
    for b in range(batches):
        end = at + size + (first if b == 0 else 0)
        part = placed.where((F.col("batch_place") >= at) & (F.col("batch_place") < end)).drop("batch_place")
        cost = price.of(g, flow)
        with by_origin(pair_demand(part)) as demand:
            flow = flow + all_or_nothing(demand, network, cost)[0]
        routed = _routes(part, pair_paths(part, network, cost))
        routes = routed if routes is None else routes.union(routed)
        at = end
    cost = price.of(g, flow)
    with by_origin(pair_demand(placed)) as demand:
        least = all_or_nothing(demand, network, cost)[1]
    gap = relative_gap(float(flow @ cost), least)
    return Assignment(routes, flow, gap, batches, True)


def _averages(network: Network, requests: DataFrame, price: Price, marginal: bool, limit: int, tolerance: float) -> Assignment:
    """Successive averages: step 1/k towards the all-or-nothing load; the gap is that of
    the flow before the step, under the cost it was routed on."""
    g = network.arrays[0]
    flow, gap, k = np.zeros(g.edges), 0.0, 0
    with dealt(pair_demand(requests), network) as demand:
        for k in range(1, limit + 1):
            cost = price.of(g, flow, marginal)
            target, least = all_or_nothing(demand, network, cost)
            gap = relative_gap(float(flow @ cost), least)
            flow = flow + (target - flow) / k
            if gap < tolerance:
                break
    return Assignment(_routes(requests, pair_paths(requests, network, cost)), flow, gap, k, gap < tolerance)


def msa(network: Network, requests: DataFrame, price: Price = Price(), load=None, limit: int = ITERATIONS, tolerance: float = GAP) -> Assignment:
    """User equilibrium."""
    return _averages(network, requests, price, False, limit, tolerance)


def systemoptimal(network: Network, requests: DataFrame, price: Price = Price(), load=None, limit: int = ITERATIONS, tolerance: float = GAP) -> Assignment:
    """Least total time: the same loop on marginal cost, for routing and gap alike."""
    return _averages(network, requests, price, True, limit, tolerance)


def k_paths(pairs: DataFrame, network: Network, cost: np.ndarray, k: int = PATHS) -> DataFrame:
    """Distinct (src, dst) with paths array<struct<cost_s,edges>>, at most ``k`` loopless ones by cost, and
    intended array<double>, their shares."""
    graph, weight = network.broadcast, network.edges.sparkSession.sparkContext.broadcast(cost)
    kind = pa.list_(pa.struct([("cost_s", pa.float64()), ("edges", pa.list_(pa.int32()))]))

    def run(batches):
        g = graph.value[0]
        for batch in batches:
            found = [K.k_shortest(g, s, d, k, weight.value) for s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"cost_s": c, "edges": p} for c, p in f] for f in found], kind), pa.array([K.split([c for c, _ in f]) for f in found], pa.list_(pa.float64()))], names=["src", "dst", "paths", "intended"])

    return pairs.select(F.col("src").cast("int"), F.col("dst").cast("int")).distinct().repartition("src", "dst").mapInArrow(run, "src int, dst int, paths array<struct<cost_s:double,edges:array<int>>>, intended array<double>")


def draw(intended, u):
    """Column: the first place whose running share exceeds ``u``."""
    running = F.aggregate(intended, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(u >= a["sum"] + x, 1).otherwise(0)).alias("n")), lambda a: a["n"])
    return F.least(running, F.size(intended) - 1)


def multipath(network: Network, requests: DataFrame, price: Price = Price(), load=None, k: int = PATHS, seed: int = 1) -> Assignment:
    """Each request draws one of its pair's ``k`` shortest paths, by inverse free-flow cost; the
    draw depends on seed and index alone. ``paths`` of the result tells where each draw came from."""
    g = network.arrays[0]
    paths = cut(k_paths(requests, network, price.of(g, np.zeros(g.edges)), k))
    bad = paths.where(F.size("paths") == 0).limit(1).collect()
    if bad:
        raise NoRoute(f"no path from node {bad[0]['src']} to node {bad[0]['dst']}")
    chosen = weighted(requests).join(paths, ["src", "dst"]).withColumn("choice", draw(F.col("intended"), hash_uniform(seed, F.col("idx")))).withColumn("path", F.get("paths", F.col("choice")))
    flow = np.zeros(g.edges)
    for r in chosen.select("weight", F.explode("path.edges").alias("edge_id")).groupBy("edge_id").agg(F.sum("weight").alias("flow")).collect():
        flow[r["edge_id"]] = r["flow"]
    split = chosen.groupBy("src", "dst", "choice").agg(F.count(F.lit(1)).alias("n"))
    split = split.groupBy("src", "dst").agg(F.map_from_entries(F.collect_list(F.struct("choice", "n"))).alias("n"), F.sum("n").alias("total"))
    share = F.transform("intended", lambda _, i: F.coalesce(F.col("n")[i], F.lit(0)) / F.col("total"))
    return Assignment(chosen.select("request_id", "idx", "path.edges", "path.cost_s"), flow, paths=paths.join(split, ["src", "dst"]).select("src", "dst", "paths", "intended", share.alias("realized"), "total"))


STRATEGIES: dict[str, Callable[..., Assignment]] = {"naive": naive, "reactive": reactive, "incremental": incremental, "msa": msa, "systemoptimal": systemoptimal, "multipath": multipath}


def assign(name: str, network: Network, requests: DataFrame, price: Price = Price(), load: np.ndarray | None = None) -> Assignment:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {', '.join(ROUTERS)}")
    return STRATEGIES[name](network, requests, price, load)
