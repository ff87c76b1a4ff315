"""Graph, assignment, evaluation and simulation on small networks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.operators import assign, evaluate, kernels as K, layers as L, network
from tollgate.plans import api, sweep
from tollgate.plans.catalogue import PIGOU_EDGES, TOY_EDGES, TOY_NODES, small_network, toy

ADVERSARIAL = (("7100001:0:F", 0, 1, 300.0, 36.0, 900.0), ("7100002:0:F", 1, 2, 500.0, 36.0, 2520.0), ("7100002:0:R", 2, 1, 500.0, 36.0, 2520.0), ("7100003:0:F", 2, 3, 600.0, 36.0, 2880.0), ("7100004:0:F", 4, 5, 400.0, 36.0, 1080.0))


@pytest.fixture(scope="module")
def toy_net(spark):
    return toy(spark)


@pytest.fixture(scope="module")
def cut_net(spark):
    return small_network(spark, TOY_NODES, ADVERSARIAL)


@pytest.fixture(scope="module")
def pigou(spark):
    return small_network(spark, TOY_NODES[:2], PIGOU_EDGES)


def requests(spark, pairs, weight=100.0):
    return spark.createDataFrame([(str(i), i, s, d, weight) for i, (s, d) in enumerate(pairs)], "request_id string, idx long, src int, dst int, weight double")


def test_canonical_route(spark, toy_net):
    r = api.route(requests(spark, [(0, 2), (3, 3)]), toy_net).orderBy("request_id").collect()
    assert r[0]["segments"] == ["905512:0:F", "905512:1:F"] and r[0]["cost_s"] == pytest.approx(32.4)
    assert r[1]["segments"] == [] and r[1]["cost_s"] == 0


def test_jam_diverts(spark, toy_net):
    load = np.zeros(7)
    load[1] = 50000.0
    r = api.compare(requests(spark, [(0, 2)]), toy_net, load).first()
    assert r["diverted"] and r["reactive_segments"] == ["9000001:0:F"]
    assert not api.compare(requests(spark, [(0, 2)]), toy_net).first()["diverted"]


def test_reachable_pairs(toy_net, cut_net):
    assert network.reachable_pairs(toy_net.edges).count() == 16
    pairs = {tuple(r) for r in network.reachable_pairs(cut_net.edges).collect()}
    assert (0, 3) in pairs and (3, 0) not in pairs and (0, 4) not in pairs


def test_components(cut_net):
    labels = network.weak_components(cut_net.nodes, cut_net.edges)
    assert {(r["node_id"], r["component"]) for r in labels.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4)}
    r = network.component_report(labels).first()
    assert (r["components"], r["largest"], r["largest_size"], r["outside"]) == (2, 0, 4, [4, 5]) and r["fraction"] == pytest.approx(4 / 6)


def test_components_of_a_long_chain(spark):
    n = spark.range(400).select(F.col("id").cast("int").alias("node_id"))
    e = n.where("node_id < 399").select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    assert network.weak_components(n, e).where("component <> 0").count() == 0


def test_a_batch_is_routed_whole_or_not_at_all(spark, cut_net):
    for name in assign.ROUTERS:
        with pytest.raises(assign.NoRoute):
            assign.assign(name, cut_net, requests(spark, [(0, 3), (3, 0)])).flow_table(cut_net).collect()
    with pytest.raises(ValueError):
        assign.assign("best", cut_net, requests(spark, [(0, 3)]))


def test_bad_graphs_are_refused(spark):
    with pytest.raises(ValueError):
        small_network(spark, TOY_NODES[:2], TOY_EDGES).arrays


def test_goal_directed_search_finds_the_same(spark, toy_net):
    p = network.reachable_pairs(toy_net.edges)
    w = toy_net.arrays[0].freeflow
    a, b = ({(r["src"], r["dst"]): r["cost_s"] for r in assign.pair_paths(p, toy_net, w, x).collect()} for x in (False, True))
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(541.44)


def test_many_origins_at_once_are_searched_as_each_alone():
    r = random.Random(5)
    for _ in range(30):
        n = r.randint(2, 30)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 90))]
        w = np.array([float(r.randint(1, 5)) for _ in edges])
        g = K.Csr.build(n, [a for a, _ in edges], [b for _, b in edges], w, np.ones(len(w)), np.ones(len(w)))
        alone = [K.search(g, s, w) for s in range(n)]
        for _, _, dist, via in K.trees(g, np.arange(n), w):
            for s, (d, last) in enumerate(alone):
                assert {v: dist[v, s] for v in range(n) if dist[v, s] < K.INF} == d and {v: via[v, s] for v in range(n) if via[v, s] >= 0} == last
        assert K.search_many(g, np.arange(n), w * 0.0) is None


def test_layers_carry_what_searches_carry():
    rng = np.random.default_rng(7)
    k = np.arange(240)
    steps = [(1, k % 8 < 7), (-1, k % 8 > 0), (8, k < 232), (-8, k >= 8)]
    lattice = np.concatenate([k[ok] for _, ok in steps]), np.concatenate([k[ok] + step for step, ok in steps])
    holes = rng.random(len(lattice[0])) > 0.3
    # A lattice, one with holes that cut pairs off, and edges at random, also doubled and from a node to itself.
    for n, src, dst in ((240, *lattice), (240, lattice[0][holes], lattice[1][holes]), (60, rng.integers(0, 60, 150), rng.integers(0, 60, 150))):
        g = K.Csr.build(n, src, dst, *np.ones((3, len(src))))
        cost = rng.random(g.edges) ** 4 * 1e6 + 1
        a, b, many = rng.integers(0, n, 3000), rng.integers(0, n, 3000), rng.integers(1, 4, 3000).astype(float)
        layers = L.layers_of(g)
        over = L.crossing(layers.count, layers.layer[a], layers.layer[b])
        at = np.argsort(over, kind="stable")
        flow, spent, lost = L.loads(layers, cost, a[at], b[at], many[at], over[at])
        want, total, gone = np.zeros(g.edges), 0.0, 0
        for s in range(n):
            dist, via = K.search(g, s, cost)
            for r in np.flatnonzero(a == s).tolist():
                gone += b[r] not in dist
                if b[r] in dist:
                    total += many[r] * dist[b[r]]
                    np.add.at(want, K.path_to(g, via, s, int(b[r])), many[r])
        assert (flow == want).all() and lost == gone and spent == pytest.approx(total, rel=1e-12)


def test_loops_on_long_graphs_search_only_where_paths_are_alike(spark, monkeypatch):
    places = [(41.0 + k // 3 * 0.01, -8.0 + k % 3 * 0.01) for k in range(90)]
    pairs = [(k, k + step) for k in range(90) for step, ok in ((1, k % 3 < 2), (-1, k % 3 > 0), (3, k < 87), (-3, k >= 3)) if ok]
    for like in (True, False):
        net = small_network(spark, places, [(f"{e}:0:F", s, d, 500.0, 36.0 if like else 30.0 + e % 97 / 7 + e / 1000, 1800.0) for e, (s, d) in enumerate(pairs)])
        q = requests(spark, [(s, (s * 7 + k * 11) % 90) for s in range(90) for k in range(5)])
        monkeypatch.setattr(L, "LARGE", 10**9)
        want = assign.msa(net, q, limit=4)
        monkeypatch.setattr(L, "LARGE", 0)
        with assign.dealt(assign.pair_demand(q), net) as demand:
            assert demand.pays
            least = assign.all_or_nothing(demand, net, net.arrays[0].freeflow)[1]
            # Costs that are all alike leave paths to the searches' rule.
            assert ("by_origin" in demand.__dict__) == like and ("by_crossing" in demand.__dict__) != like
        with assign.by_origin(assign.pair_demand(q)) as demand:
            assert least == pytest.approx(assign.all_or_nothing(demand, net, net.arrays[0].freeflow)[1], rel=1e-12)
        got = assign.msa(net, q, limit=4)
        assert got.iterations == want.iterations
        if not like:
            assert got.flows == pytest.approx(want.flows, rel=1e-9) and got.gap == pytest.approx(want.gap, rel=1e-9)


def test_costs_of_requests_need_no_paths(spark, toy_net, cut_net):
    q = requests(spark, [(s, d) for s in range(6) for d in range(6)] * 2)
    for n in (toy_net, cut_net):
        w = n.arrays[0].freeflow
        want = {(r["src"], r["dst"]): r["cost_s"] for r in assign.pair_paths(q, n, w).collect()}
        got = assign.least_costs(q, n, w).join(q, "request_id").collect()
        assert len(got) == 72 and all(r["cost_s"] == want[r["src"], r["dst"]] for r in got)


def test_k_paths_match_enumeration():
    r = random.Random(4)
    for _ in range(20):
        n = 6
        edges = [(a, b) for a in range(n) for b in range(n) if a != b and r.random() < 0.5]
        w = np.array([r.randint(1, 40) + r.random() for _ in edges])
        g = K.Csr.build(n, [a for a, _ in edges], [b for _, b in edges], w, np.ones(len(w)), np.ones(len(w)))
        every = []

        def walk(path, at, seen):
            if at == n - 1:
                every.append((sum(w[e] for e in path), path))
                return
            for e, (a, b) in enumerate(edges):
                if a == at and b not in seen:
                    walk([*path, e], b, seen | {b})

        walk([], 0, {0})
        got = K.k_shortest(g, 0, n - 1, 5, w)
        assert [p for _, p in got] == [p for _, p in sorted(every)[:5]]


def test_split_rule():
    assert K.split([10.0, 30.0]) == pytest.approx([0.75, 0.25]) and K.split([0.0, 0.0]) == [0.5, 0.5] and K.split([0.0, 5.0]) == [0.0, 1.0] and K.split([]) == []


def test_pigou(spark, pigou):
    r = {x["router"]: x for x in sweep.run_single(pigou, requests(spark, [(0, 1)] * 9, 200.0), "naive").collect()}
    assert r["naive"]["total_network_time_s"] == pytest.approx(220320) and r["systemoptimal"]["total_network_time_s"] == pytest.approx(101760, rel=1e-3)
    assert r["naive"]["poa"] == pytest.approx(2.165, abs=0.01) and r["naive"]["max_vc"] == pytest.approx(2.0)


def test_equilibrium_properties(spark, pigou):
    q = requests(spark, [(0, 1)] * 9, 200.0)
    best, free = assign.systemoptimal(pigou, q, limit=30), assign.msa(pigou, q, limit=30)
    g = pigou.arrays[0]
    total = lambda a: float(a.flows @ assign.Price().of(g, a.flows))
    assert total(best) <= total(free) + 1e-6 and best.flows.sum() == pytest.approx(1800) and free.iterations >= 2
    first = assign.msa(pigou, q, limit=1)
    assert first.gap == 1.0 and not first.converged


def test_incremental_takes_four_batches(spark, pigou):
    a = assign.incremental(pigou, requests(spark, [(0, 1)] * 9, 300.0))
    assert a.iterations == 4 and a.converged and a.routes.count() == 9 and a.flows.sum() == pytest.approx(2700) and a.flows.min() > 0


def test_sparse_indexes_are_all_routed(spark, pigou):
    """Batches go by the order of indexes, not by their values."""
    q = requests(spark, [(0, 1)] * 10, 300.0).withColumn("idx", F.col("idx") * 1000 + 500)
    a = assign.incremental(pigou, q)
    dense = assign.incremental(pigou, requests(spark, [(0, 1)] * 10, 300.0))
    assert a.routes.count() == 10 and a.flows.sum() == pytest.approx(3000) and a.flows == pytest.approx(dense.flows)


def test_tail_is_the_nearest_rank(spark):
    df = spark.createDataFrame([(float(k % 37),) for k in range(1000)] + [(None,)], "x double")
    have = sorted(float(k % 37) for k in range(1000))
    assert [evaluate.tail(df, "x", p) for p in (0.0, 0.5, 0.95, 1.0)] == [have[0], have[499], have[949], have[-1]]
    assert evaluate.tail(df.limit(0), "x", 0.95) == 0.0


def test_multipath_draws_by_seed_and_index(spark, toy_net):
    q = requests(spark, [(0, 2)] * 200)
    a, b = (assign.multipath(toy_net, q.repartition(n)) for n in (1, 5))
    assert (a.flows == b.flows).all()
    p = a.paths.first()
    assert p["intended"] == pytest.approx([108 / 140.4, 32.4 / 140.4]) and p["realized"] == pytest.approx(p["intended"], abs=0.12) and sum(p["realized"]) == pytest.approx(1)


def test_weights_default_to_one(spark, toy_net):
    a = assign.naive(toy_net, requests(spark, [(0, 2)] * 3, -5.0))
    assert a.flows[1] == 3.0


def test_evaluation_vector(spark):
    n = small_network(spark, TOY_NODES[:3], (("1:0:F", 0, 1, 1.0, 10.0, 100.0), ("2:0:F", 1, 2, 1.0, 20.0, 200.0)))
    routes = spark.createDataFrame([("a", [0]), ("b", [0, 1]), ("c", [1])], "request_id string, edges array<int>")
    load = spark.createDataFrame([(0, 100.0), (1, 200.0)], "edge_id int, load_vph double")
    r = evaluate.evaluate(n, routes, load).first()
    assert tuple(r) == pytest.approx((23.0, 34.5, 5750.0, 0.0, 1.0))
    none = evaluate.evaluate(n, routes.limit(0), load.limit(0)).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_gini_and_tail(spark):
    assert evaluate.gini(spark.createDataFrame([(0.0,), (1.0,)], "x double"), "x").first()[0] == pytest.approx(0.5)
    assert spark.range(1, 21).select(evaluate.nearest_rank("id", 0.95)).first()[0] == 19
    assert evaluate.median_of_ns(spark.createDataFrame([(3,), (4,)], "v long"), "v").first()[0] == 3


@pytest.mark.parametrize("a, b, poa", [(220320.0, 101760.0, 2.1651), (5000.0, 0.0, 1.0), (0.0, 5000.0, 1.0)])
def test_price_of_anarchy(spark, a, b, poa):
    assert spark.range(1).select(evaluate.price_of_anarchy(F.lit(a), F.lit(b))).first()[0] == pytest.approx(poa, abs=1e-4)


def test_nearest_node_matches_brute_force(spark):
    r = random.Random(2)
    nodes = [(i, r.uniform(-80, 80), r.uniform(-179, 179)) for i in range(60)] + [(60, 41.14, -8.63), (61, 41.1401, -8.63)]
    points = [(i, r.uniform(-85, 85), r.uniform(-180, 180)) for i in range(40)] + [(40, 41.14, -8.6301)]
    got = {x["point_id"]: x["node_id"] for x in network.nearest_node(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(nodes, "node_id int, lat double, lon double")).collect()}
    for p, lat, lon in points:
        d = [float(K.haversine(lat, lon, a, b)) for _, a, b in nodes]
        assert d[got[p]] == pytest.approx(min(d), rel=1e-9), p


# --- simulation ---


def run(spark, net, reqs, **kw):
    ticks, trips = sweep.simulations(net, spark.createDataFrame(reqs, "idx long, src int, dst int, depart_s double, weight double"), **kw)
    return ticks.orderBy("algo", "tick").collect(), {(r["algo"], r["idx"]): r["time_s"] for r in trips.collect()}


def test_free_flow_trip(spark, toy_net):
    ticks, trips = run(spark, toy_net, [(0, 0, 2, 0.0, 1.0)], routers=("naive",), tick_s=10.0)
    assert trips["naive", 0] == pytest.approx(32.4, abs=1e-3) and [t["tick"] for t in ticks] == [1, 2, 3, 4]
    assert [t["in_flight"] for t in ticks] == [1, 1, 1, 0] and sum(ticks[0]["load"]) == 1.0


def test_order_of_requests_does_not_matter(spark, toy_net):
    reqs = [(i, 0, 2 + i % 3, float(i * 7 % 40), 300.0) for i in range(30)]
    a, b = run(spark, toy_net, reqs), run(spark, toy_net, reqs[::-1])
    assert a[1] == b[1] and [t["load"] for t in a[0]] == [t["load"] for t in b[0]]
    assert {k[0] for k in a[1]} == set(assign.ROUTERS)


def test_congestion_makes_trips_longer(spark, toy_net):
    alone = run(spark, toy_net, [(0, 0, 5, 0.0, 1.0)], routers=("naive",))[1]["naive", 0]
    crowd = run(spark, toy_net, [(i, 0, 5, float(i), 400.0) for i in range(60)], routers=("naive",))[1]
    assert max(crowd.values()) > 1.05 * alone


def test_any_number_of_trips_is_simulated(spark, toy_net):
    many = spark.range(5_000_001).selectExpr("id as idx", "0 as src", "2 as dst", "double(id % 3) as depart_s", "1e-9D as weight")
    ticks, trips = sweep.simulations(toy_net, many, routers=("naive",), tick_s=10.0)
    assert [(t["in_flight"], t["completed"]) for t in ticks.orderBy("tick").collect()][-2:] == [(3333334, 1666667), (0, 5000001)]
    got = trips.groupBy("algo").agg(F.count("idx").alias("n"), F.min("time_s").alias("a"), F.max("time_s").alias("b")).first()
    assert got["n"] == 5_000_001 and got["a"] == pytest.approx(32.4, abs=1e-3) and got["b"] == pytest.approx(32.4, abs=1e-3)


def test_vehicles_leave_at_the_first_tick_that_begins_no_earlier(spark):
    d = spark.createDataFrame([(0.0,), (1e-9,), (30.0,), (30.1,), (-5.0,), (0.3,), (0.1 * 3,)], "d double")
    assert [r[0] for r in d.select(sweep.released(F.col("d"), 30.0)).collect()] == [1, 2, 2, 3, 1, 2, 2]
    assert [r[0] for r in d.select(sweep.released(F.col("d"), 0.1)).collect()] == [next(k for k in range(1, 400) if (k - 1) * 0.1 >= r[0]) for r in d.collect()]


def test_empty_batch_has_one_tick(spark, toy_net):
    assert len(run(spark, toy_net, [], routers=("naive",))[0]) == 1


def test_sweep_relations(spark, toy_net):
    q = requests(spark, [(0, 2), (0, 5), (1, 4), (2, 5), (4, 3)] * 8, 125.0)
    rows = {(r["router"], r["demand_level"]): r for r in sweep.sweep(toy_net, q, sweep.LEVELS[:2]).collect()}
    for lv in sweep.LEVELS[:2]:
        naive = rows["naive", lv.name]
        for name in ("reactive", "incremental", "msa", "systemoptimal"):
            assert rows[name, lv.name]["total_network_time_s"] == pytest.approx(naive["total_network_time_s"])
        assert 0 < naive["sim_mean_realized_s"] <= naive["sim_p95_realized_s"]
        assert rows["multipath", lv.name]["poa"] > 1 and naive["poa"] == pytest.approx(1)
    a, b = rows["naive", "vc0.5"], rows["naive", "vc0.8"]
    assert a["max_vc"] * a["capacity_scale"] == pytest.approx(b["max_vc"] * b["capacity_scale"])


def test_sweep_makes_its_requests_once(spark, toy_net):
    q, seen = requests(spark, [(0, 2), (0, 5), (1, 4)], 125.0), spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = sweep.sweep(toy_net, q.mapInArrow(made, q.schema), sweep.LEVELS[:2], ("naive", "incremental")).collect()
    assert len(rows) == 4 and seen.value == 3


def test_live_poa_is_floored(spark, toy_net):
    assert all(r["static_poa"] >= 1 for r in sweep.static_poa(toy_net, requests(spark, [(0, 2)] * 4)).collect())
