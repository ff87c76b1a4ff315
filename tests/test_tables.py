"""Sources, contracts, streaming and frames."""

import json
import os
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tollgate.operators import congestion, derive, frames, network, validate
from tollgate.operators.ranking import numbered
from tollgate.plans import api, report, sweep
from tollgate.plans.catalogue import small_network, toy
from tollgate.__main__ import main
from tollgate.sources import files, geojson, load, messages, odset
from tollgate.streaming import windows


def feature(k, **change):
    p = {"segment_id": f"{k + 1}:0:F", "edge_id": k, "source_node": 10 * k, "target_node": 10 * k + 10, "osm_way_id": k + 1, "highway_class": "primary", "lanes_effective": 2, "length_m": 240.0, "maxspeed_kmh": 60.0, "freeflow_time_s": 14.4, "capacity_vph": 2880.0}
    g = {"type": "LineString", "coordinates": change.pop("coordinates", [[-8.6 + 0.001 * k, 41.1], [-8.6 + 0.001 * (k + 1), 41.1]])}
    return {"type": "Feature", "geometry": g, "properties": {**p, **change}}


def write(path, features, **envelope):
    doc = {"type": "FeatureCollection", "schema_version": 1, "features": features, **envelope}
    path.write_text(json.dumps({k: v for k, v in doc.items() if v is not ...}))
    return str(path)


def test_export_round_trip(spark, tmp_path):
    e = geojson.read_edges(spark, write(tmp_path / "a.json", [feature(k) for k in range(4)]))
    assert e.count() == 4
    geojson.write_edges(e, str(tmp_path / "b.json"))
    assert sorted(map(str, geojson.read_edges(spark, str(tmp_path / "b.json")).collect())) == sorted(map(str, e.collect()))
    d = network.compact(e).orderBy("edge_id").collect()
    assert [(r["src"], r["dst"]) for r in d] == [(0, 1), (1, 2), (2, 3), (3, 4)]


BAD = [
    ("version 2", {"schema_version": 2}, {}),
    ("no version", {"schema_version": ...}, {}),
    ("text version", {"schema_version": "1"}, {}),
    ("number with a point", {"schema_version": 1.0}, {}),
    ("version of a feature only", {"schema_version": ...}, {"schema_version": 1}),
    ("other type", {"type": "Thing"}, {}),
    ("other way", {}, {"osm_way_id": 99}),
    ("edge id gap", {}, {"edge_id": 7}),
    ("edge id repeats", {}, {"edge_id": 0}),
    ("segment repeats", {}, {"segment_id": "1:0:F", "osm_way_id": 1}),
    ("class", {}, {"highway_class": "living_street"}),
    ("node elsewhere", {}, {"source_node": 0}),
    ("axes", {}, {"coordinates": [[41.1, -8.599], [41.1, -8.598]]}),
    ("length", {}, {"length_m": 0.0}),
    ("speed", {}, {"maxspeed_kmh": -1.0}),
    ("way 0", {}, {"segment_id": "0:0:F", "osm_way_id": 0}),
    ("lower case", {}, {"segment_id": "2:0:f"}),
    ("chord", {}, {"length_m": 10.0}),
    ("one point", {}, {"coordinates": [[-8.6, 41.1]]}),
    ("three values", {}, {"coordinates": [[-8.6, 41.1, 1.0], [-8.6, 41.1]]}),
    ("longitude", {}, {"coordinates": [[-188.6, 41.1], [-8.6, 41.1]]}),
    ("negative node", {}, {"target_node": -1}),
    ("lanes", {}, {"lanes_effective": 0}),
    ("null field", {}, {"capacity_vph": None}),
]


@pytest.mark.parametrize("name, envelope, change", BAD, ids=[b[0] for b in BAD])
def test_bad_exports_are_refused_whole(spark, tmp_path, name, envelope, change):
    path = write(tmp_path / "x.json", [feature(0), feature(1, **change), feature(2)], **envelope)
    with pytest.raises(validate.InvalidEdges):
        geojson.read_edges(spark, path, bounds=(-9.0, -8.0, 41.0, 42.0)).collect()


def test_too_large_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geojson, "MAX_BYTES", 10)
    with pytest.raises(validate.InvalidEdges):
        geojson.read_edges(spark, write(tmp_path / "x.json", [feature(0)]))


def test_parquet_with_wkb(spark, tmp_path):
    e = geojson.read_edges(spark, write(tmp_path / "a.json", [feature(k) for k in range(3)]))
    files.write_edge_parquet(e, str(tmp_path / "e.parquet"))
    back = files.read_edge_parquet(spark, str(tmp_path / "e.parquet"))
    assert [r["geometry"] for r in back.orderBy("edge_id").collect()] == [r["geometry"] for r in e.orderBy("edge_id").collect()]
    assert all(pq.read_schema(p).metadata[b"schema_version"] == b"1" for p in (tmp_path / "e.parquet").glob("*.parquet"))
    (tmp_path / "e.parquet" / "part-left-behind.parquet").write_bytes(b"half")
    files.write_edge_parquet(e, str(tmp_path / "e.parquet"))
    assert not (tmp_path / "e.parquet" / "part-left-behind.parquet").exists()
    e.drop("geometry").toPandas().to_parquet(tmp_path / "bad.parquet")
    with pytest.raises(validate.InvalidEdges):
        files.read_edge_parquet(spark, str(tmp_path / "bad.parquet"))


def test_road_tags_from_xml(spark, tmp_path):
    (tmp_path / "x.osm").write_text('<osm><way id="7"><nd ref="1"/><tag k="highway" v="primary"/><tag k="lanes" v="4"/></way><way id="8"></way></osm>')
    got = {r["osm_id"]: r["tags"] for r in files.read_road_tags(spark, str(tmp_path / "x.osm")).collect()}
    assert got == {7: {"highway": "primary", "lanes": "4"}, 8: {}}


def test_derivation(spark):
    ways = [(8, 3, 1, 2, [[0.0, 0.0], [0.01, 0.0]]), (8, 1, 1, 1, [[0.0, 0.0], [0.01, 0.0]]), (8, 2, 5, 6, [[0.0, 0.1], [0.01, 0.1], [0.01, 0.2]]), (5, 9, 2, 3, [[0.0, 0.0], [0.0, 0.01]]), (9, 1, 1, 4, [[0.0, 0.0], [0.0, 0.01]])]
    tags = [(8, {"highway": "secondary", "lanes": "6"}), (5, {"highway": "motorway_link", "maxspeed": "50 mph"}), (9, {"highway": "footway"})]
    w, t = spark.createDataFrame(ways, "osm_id long, gid long, source long, target long, coords array<array<double>>"), spark.createDataFrame(tags, "osm_id long, tags map<string,string>")
    rows = derive.derive_edges(w, t).orderBy("edge_id").collect()
    assert [r["segment_id"] for r in rows] == ["5:0:F", "8:0:F", "8:0:R", "8:1:F", "8:1:R"]
    assert rows[0]["maxspeed_kmh"] == pytest.approx(80.4672) and rows[0]["capacity_vph"] == 5400.0
    assert rows[1]["lanes_effective"] == 3 and rows[1]["capacity_vph"] == 3780.0 and rows[2]["geometry"] == rows[1]["geometry"][::-1] and rows[1]["length_m"] == rows[2]["length_m"]
    s = derive.skip_report(w, t).first()
    assert (s["skipped_class"], s["skipped_degenerate"]) == (1, 1)


def test_tags_and_offsets_of_ways_are_not_broadcast(spark):
    ways = spark.range(50).selectExpr("id as osm_id", "id as gid", "id as source", "id + 1 as target", "array(array(0.0D, 0.0D), array(0.01D, 0.0D)) as coords")
    tags = spark.range(50).selectExpr("id as osm_id", "map('highway', 'primary') as tags")
    e = derive.derive_edges(ways, tags)
    plan = e._jdf.queryExecution().sparkPlan().toString()
    # The only broadcast is that of where each range of ways begins.
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1
    assert e.count() == 100


def test_box_of_kept_ways_needs_no_numbers(spark):
    ways = [(8, 3, 1, 2, [[0.0, 0.0], [0.01, 0.0]]), (8, 1, 1, 1, [[9.0, 0.0], [0.01, 0.0]]), (5, 9, 2, 3, [[0.0, 0.0], [0.0, -0.01]]), (9, 1, 1, 4, [[0.0, 0.0], [0.0, 7.0]])]
    tags = [(8, {"highway": "secondary"}), (5, {"highway": "motorway_link"}), (9, {"highway": "footway"})]
    w, t = spark.createDataFrame(ways, "osm_id long, gid long, source long, target long, coords array<array<double>>"), spark.createDataFrame(tags, "osm_id long, tags map<string,string>")
    box = derive.bounding_box(derive.kept_ways(w, t), "coords")
    assert box.collect() == derive.bounding_box(derive.derive_edges(w, t)).collect() == [(0.0, -0.01, 0.01, 0.0)]


# --- messages ---


def message(seg, start, emit, n, final=False, **change):
    m = {"schema_version": 1, "segment_id": seg, "window_start": f"2026-06-08T{start}:00Z", "window_end": "2026-06-08T08:06:00Z", "vehicle_count": n, "avg_speed_kmh": 30.0, "sample_pings": 9, "is_final": final, "emit_time": f"2026-06-08T{emit}Z", "producer": "p"}
    return json.dumps({k: v for k, v in {**m, **change}.items() if v is not ...})


MESSAGES = [message("27583001:0:F", "08:00", "08:05:03", 31), message("27583001:0:F", "08:00", "08:06:04", 37), message("27583001:0:F", "08:00", "08:07:05", 39, True), message("27583001:0:F", "08:01", "08:06:03", 35), message("48800123:0:R", "08:00", "08:07:06", 12, True), message("48800123:0:F", "08:00", "08:07:06", 18, True), message("123456789:2:F", "08:00", "08:05:03", 42)]


def test_latest_messages_become_load(spark, tmp_path):
    (tmp_path / "m.json").write_text("\n".join(MESSAGES))
    m = messages.read_messages(spark, str(tmp_path / "m.json"))
    n = toy(spark)
    assert {r["edge_id"]: r["load_vph"] for r in congestion.loads(m, n.edges).collect()} == {3: 420.0, 5: 144.0, 4: 216.0}
    assert [r["segment_id"] for r in congestion.unknown_segments(m, n.edges).collect()] == ["123456789:2:F"]
    snap = api.congestion(n, congestion.loads(m, n.edges)).collect()
    assert [r["segment_id"] for r in snap] == ["27583001:0:F", "48800123:0:F", "48800123:0:R"]
    back = messages.decode(messages.encode(m).select("value"))
    assert back.where("error is not null").count() == 0 and back.count() == 7


def test_first_of_equal_messages_stays(spark):
    rows = [(0, "s", 1, 1, 10), (1, "s", 1, 1, 20)]
    df = spark.createDataFrame(rows, "row long, segment_id string, window_start int, emit_time int, vehicle_count int")
    assert congestion.keep_latest(df).first()["vehicle_count"] == 10


@pytest.mark.parametrize("change, error", [({"extra": 1}, "unknown field"), ({"producer": ...}, "missing field"), ({"schema_version": 2}, "schema_version"), ({"vehicle_count": -1}, "vehicle_count"), ({"vehicle_count": "x"}, "vehicle_count"), ({"avg_speed_kmh": 0}, "avg_speed_kmh"), ({"sample_pings": -1}, "sample_pings"), ({"window_start": "2026-06-08 08:00:00"}, "window_start"), ({"emit_time": "2026-06-31T08:00:00Z"}, "emit_time")])
def test_bad_messages(spark, change, error):
    got = messages.decode(spark.createDataFrame([(message("1:0:F", "08:00", "08:05:03", 1, **change),)], "value string")).first()
    assert got["error"] is not None and (got["error"] == error or error == "vehicle_count")


def test_not_json(spark, tmp_path):
    (tmp_path / "m.json").write_text("{oops\n")
    with pytest.raises(messages.InvalidMessage):
        messages.read_messages(spark, str(tmp_path / "m.json"))


def test_injection_and_noise(spark):
    load = spark.createDataFrame([(0, 100.0), (1, 0.0)], "edge_id int, load_vph double")
    jam = spark.createDataFrame([(0, -500.0), (2, 50.0)], "edge_id int, load_vph double")
    assert {r["edge_id"]: r["load_vph"] for r in congestion.inject(load, jam).collect()} == {0: 0.0, 1: 0.0, 2: 50.0}
    a, b = ({r["edge_id"]: r["load_vph"] for r in congestion.perturb(load, 3, 2).collect()} for _ in range(2))
    assert a == b and a[1] == 0.0 and 81 <= a[0] <= 121 and a[0] != 100.0


def test_sources_of_load(spark, tmp_path):
    n = toy(spark)
    table = lambda df: {r["edge_id"]: r["load_vph"] for r in df.collect()}
    assert set(table(load.load_from(n)).values()) == {0.0}
    assert table(load.load_from(n, jam="905512:0:F"))[1] == 50000.0
    noisy = table(load.load_from(n, "sim", "905512:0:F"))
    assert 45000 <= noisy[1] <= 55000 and noisy[1] != 50000 and noisy[0] == 0
    (tmp_path / "m.json").write_text(message("905512:0:F", "08:00", "08:05:03", 5000))
    assert table(load.load_from(n, str(tmp_path / "m.json")))[1] == 60000.0
    for bad in ({"source": str(tmp_path / "m.json"), "jam": "905512:0:F"}, {"jam": "1:1:F"}):
        with pytest.raises(ValueError):
            load.load_from(n, **bad)


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "g.json", [feature(k) for k in range(3)])
    assert main(["route", "--graph", path, "--from", "41.1,-8.6", "--to", "41.1,-8.598", "--algo", "reactive", "--jam", "1:0:F"]) == 0
    assert capsys.readouterr().out.startswith("1:0:F -> 2:0:F\ncost_s ")
    assert main(["route", "--graph", path, "--from", "41.1,-8.598", "--to", "41.1,-8.6"]) == 1


# --- origin-destination sets ---


def test_od_set(spark):
    n = toy(spark)
    a = odset.synthesize(n, 50, 5000.0, 1)
    rows = a.orderBy("idx").collect()
    assert len(rows) == 50 and rows[0]["id"] == "od-0000" and all(r["weight"] == 100.0 and r["src"] != r["dst"] for r in rows)
    assert rows == odset.synthesize(n, 50, 5000.0, 1).orderBy("idx").collect()
    assert odset.synthesize(n, 0, 5000.0, 1).count() == 0
    doc = json.loads(odset.to_json(a, n.nodes, 1, "vc1.0", 1.0, 5000.0).first()["body"])
    assert doc["demand_level"] == "vc1.0" and len(doc["requests"]) == 50 and doc["requests"][3]["id"] == "od-0003"
    at = {r["node_id"]: {"lat": r["lat"], "lon": r["lon"]} for r in n.nodes.collect()}
    assert all((d["from"], d["to"], d["label"]) == (at[r["src"]], at[r["dst"]], f"n{r['src']}->n{r['dst']}") for d, r in zip(doc["requests"], rows))
    assert sum(r["requests"] for r in odset.label_counts(a).collect()) == 50


def test_draws_are_those_of_the_numbered_pool(spark):
    """Also where the graph has several components, and one-way links between them."""
    r = random.Random(2)
    links = [(a, b) for a in range(0, 40) for b in r.sample(range(40), 2) if a != b and (a < 20) == (b < 20) or (a < 5 and b > 30)]
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "edge_id int, src int, dst int")
    to = {}
    for a, b in links:
        to.setdefault(a, set()).add(b)
    pool = []
    for s in sorted({x for link in links for x in link}):
        seen, front = {s}, [s]
        while front:
            for w in to.get(front.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    front.append(w)
        pool += [(s, d) for d in sorted(seen - {s})]
    assert sorted(map(tuple, network.reachable_pairs(e).collect())) == pool
    u = [0.0, 0.25, 0.5, 0.999999] + [r.random() for _ in range(60)]
    drawn, n = network.draw_pairs(e, spark.createDataFrame(list(enumerate(u)), "idx long, u double"))
    assert n == len(pool) and all((x["src"], x["dst"]) == pool[int(x["u"] * n)] for x in drawn.collect())


def test_a_large_pool_is_drawn_from_in_seconds(spark):
    """2500 nodes, six million pairs."""
    side, step = 50, [(0, 1), (1, 0), (0, -1), (-1, 0)]
    links = [(a * side + b, (a + i) * side + b + j) for a in range(side) for b in range(side) for i, j in step if 0 <= a + i < side and 0 <= b + j < side]
    n = small_network(spark, [(41.0 + k * 1e-4, -8.0) for k in range(side * side)], [(f"{k + 1}:0:F", *x, 100.0, 10.0, 900.0) for k, x in enumerate(links)])
    began = time.time()
    assert odset.synthesize(n, 1000, 5000.0, 1).distinct().count() == 1000
    assert time.time() - began < 20


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3 + 1).alias("w"))
    rows = sorted(map(tuple, numbered(numbered(df, "n", "k"), "s", "k", weight="w").select("k", "n", "w", "s").collect()))
    assert [r[1] for r in rows] == list(range(1000)) and all(b[3] == a[3] + a[2] for a, b in zip(rows, rows[1:])) and rows[0][3] == 0
    assert numbered(df.limit(0), "n", "k").count() == 0


def test_od_text(spark, tmp_path):
    rows = [("a", 41.1, -8.6, 41.2, -8.5, 0.0, 1.5), ("b", 0.1 + 0.2, 1e-7, 1.0, 2.0, 3600.0, 1 / 3)]
    df = spark.createDataFrame(rows, odset.SCHEMA)
    odset.write_tsv(df, str(tmp_path / "od"))
    assert sorted(map(tuple, odset.read_tsv(spark, str(tmp_path / "od")).collect())) == sorted(rows)
    lines = lambda *x: spark.createDataFrame([(t,) for t in x], "value string")
    assert odset.from_lines(lines("", "a\t1\t2\t3\t4\t5\t6", "  ")).count() == 1
    for bad in ("a\t1\t2", "a\t1\t2\t3\t4\t5\tx", "a\t1\t2\t3\t4\t5\t6\t7"):
        with pytest.raises(ValueError):
            odset.from_lines(lines(bad))
    with pytest.raises(ValueError):
        odset.to_lines(spark.createDataFrame([("a\tb", *rows[0][1:])], odset.SCHEMA))


# --- matching, frames, reports, parameters ---


def test_heading_tells_directions_apart(spark):
    n = small_network(spark, ((41.14, -8.63), (41.14, -8.62)), (("1:0:F", 0, 1, 900.0, 30.0, 900.0), ("1:0:R", 1, 0, 900.0, 30.0, 900.0)))
    p = spark.createDataFrame([(1, 41.1401, -8.625, 90.0), (2, 41.1401, -8.625, 265.0), (3, 41.16, -8.625, 0.0)], "ping_id int, lat double, lon double, heading_deg double")
    assert {r["ping_id"]: r["edge_id"] for r in network.match_pings(p, n).collect()} == {1: 0, 2: 1}


def test_frames_fold_to_the_last_state(spark):
    n = toy(spark)
    q = spark.createDataFrame([(i, 0, 5, float(i), 300.0) for i in range(20)], "idx long, src int, dst int, depart_s double, weight double")
    ticks, _ = sweep.simulations(n, q, routers=("naive",))
    states = sweep.tick_states(ticks, n).withColumnRenamed("tick", "frame")
    d = frames.deltas(states)
    full = states.groupBy("segment_id").agg(F.max_by("vc", "frame").alias("vc"))
    last = frames.fold(d).join(full, "segment_id").withColumn("want", F.least(F.lit(23), F.floor(F.col("vc") / 0.1 + 1e-9)))
    assert last.count() == 7 and last.where("bucket <> want").count() == 0
    sent = frames.due_ticks(ticks, 30.0, 30.0, 1.0).withColumn("poa", F.lit(1.0)).withColumn("realized_total_s", F.lit(2.0)).withColumn("compute_ns", F.lit(1_500_000)).withColumn("route_median_ns", F.lit(7))
    changed = frames.deltas(states.withColumn("frame", F.col("frame") - 1))
    bodies = [(r["type"], json.loads(r["body"])) for r in frames.frame_json(changed, sent, "2026-06-22T08:00:00Z", 30.0).orderBy("frame").collect()]
    assert [t for t, _ in bodies] == ["snapshot"] + ["delta"] * (len(bodies) - 1) and len(bodies) == ticks.count()
    first, second = bodies[0][1], bodies[1][1]
    assert len(first["segments"]) == 7 and first["tick"] == 1 and first["sim_time"] == "2026-06-22T08:00:00Z" and "changed" in second and second["sim_time"] == "2026-06-22T08:00:30Z"
    assert first["metrics"] == {"compute_ms": 1.5, "route_median_ns": 7, "realized_total_s": 2.0, "poa": 1.0, "in_flight": 1, "completed": 0}


def test_coalesced_ticks(spark):
    t = spark.createDataFrame([("a", k) for k in range(1, 8)], "algo string, tick int")
    got = {r["frame"]: r["tick"] for r in frames.due_ticks(t, 30.0, 90.0, 1.0).collect()}
    assert got == {0: 1, 1: 4, 2: 7}


def test_report(spark):
    cells = spark.createDataFrame([("naive", "vc1.0", 1.0, 1.0, 1.5, 10.0, 20.0, 100.0, 1.0, 33.85, 77.76, 0.25, 1, True, 0.0), ("incremental", "vc1.0", 1.0, 1.0, 1.5, 10.0, 20.0, 80.0, 0.8, 33.85, 77.76, 0.25, 4, True, 0.0), ("systemoptimal", "vc1.0", 1.0, 1.0, 1.5, 10.0, 20.0, 50.0, 1.0, 33.85, 77.76, 0.25, 9, True, 0.0)], "router string, demand_level string, target_vc double, capacity_scale double, max_vc double, mean_realized_s double, p95_realized_s double, total_network_time_s double, poa double, sim_mean_realized_s double, sim_p95_realized_s double, gini_vc double, iters int, converged boolean, gap double")
    text = report.markdown(cells, ("naive",))
    assert [x for x in text.splitlines() if x.startswith("| naive")][0] == "| naive | vc1.0 | 1.00 | 1.00 | 1.5000 | 10.00 | 20.00 | 100.00 | 1.0000 | 33.85 | 77.76 | 0.2500 | 1 | true | 0.0 |"
    assert text.splitlines()[0].count("|") == 16
    doc = json.loads(report.report_json(cells, 7, 1000, 5000.0).first()["body"])
    assert (doc["seed"], doc["od_count"], doc["total_demand_vph"]) == (7, 1000, 5000.0) and [c["router"] for c in doc["cells"]] == ["incremental", "naive", "systemoptimal"]
    assert doc["poa_by_level"] == [{"demand_level": "vc1.0", "poa": 1.0}]
    assert doc["headline_improvement"] == {"demand_level": "vc1.0", "router": "systemoptimal", "improvement_pct": 50.0}
    assert report.replace_region("a\n<!-- t:begin -->\nold\n<!-- t:end -->\nb", "t", "new") == "a\n<!-- t:begin -->\nnew\n<!-- t:end -->\nb"
    with pytest.raises(ValueError):
        report.replace_region("nothing", "t", "new")


def test_parameters():
    assert api.parameters(alpha=0)["alpha"] == 0.15 and api.cache_key(seed=3) == api.cache_key(seed=3, request_count=1000)
    for bad in ({"algorithm": "best"}, {"alpha": -1}, {"capacity_scale": -1.0}, {"nope": 1}):
        with pytest.raises(ValueError):
            api.parameters(**bad)


def test_stream_parameters():
    assert api.stream_parameters(count=0)["count"] == 1000 and api.place(" 1.5, -2") == (1.5, -2.0)
    for bad in ({"start": "now"}, {"speed": 0}, {"tick_hz": 5}, {"capacity_scale": 0}):
        with pytest.raises(ValueError):
            api.stream_parameters(**bad)
    with pytest.raises(ValueError):
        api.place("1")


def test_places_are_snapped(spark):
    q = spark.createDataFrame([("a", 40.73736, -73.975, 40.7399, -73.9699)], "request_id string, from_lat double, from_lon double, to_lat double, to_lon double")
    r = api.snap(q, toy(spark)).first()
    assert (r["src"], r["dst"]) == (0, 2)


# --- streams ---

PINGS = [("t1", "2026-06-08 08:00:30", "s", 30.0), ("t2", "2026-06-08 08:01:10", "s", 40.0), ("t1", "2026-06-08 08:01:20", "s", 50.0), ("t3", "2026-06-08 08:09:59", "z", 20.0)]


def csv(path, rows):
    path.write_text("taxi_id,ts,segment_id,speed_kmh\n" + "\n".join(",".join(map(str, r)) for r in rows))


def test_stream_equals_its_batch_twin(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    csv(src / "1.csv", PINGS[:3])
    csv(src / "2.csv", PINGS[3:] + [("t9", "2026-06-08 12:00:00", "end", 1.0)])
    got = []
    q = windows.start(windows.replay(spark, str(src)), True, lambda df, b: got.extend(df.collect()), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    batch = spark.createDataFrame(PINGS, "taxi_id string, ts string, segment_id string, speed_kmh double").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["segment_id"], r["window_start"], r["vehicle_count"], r["sample_pings"]) for r in congestion.sliding_windows(batch).collect()}
    assert {(r["segment_id"], r["window_start"], r["vehicle_count"], r["sample_pings"]) for r in got} == want
    assert all(r["is_final"] and r["producer"] == "stream" for r in got)


def test_provisional_messages_and_latest_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    csv(src / "1.csv", PINGS)
    path = str(tmp_path / "latest")
    q = windows.start(windows.replay(spark, str(src)), False, windows.latest_loads(spark, path), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    rows = {r["segment_id"]: r for r in spark.read.parquet(f"{path}/v=0").collect()}
    assert set(rows) == {"s", "z"} and not rows["s"]["is_final"] and str(rows["s"]["window_start"]) == "2026-06-08 08:01:00" and rows["s"]["vehicle_count"] == 2


def test_one_job_gives_both_kinds_and_counts_late_pings(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    late = ("t7", "2026-06-08 08:00:40", "s", 10.0)
    for k, rows in enumerate([PINGS[:3], PINGS[3:], [late, ("t9", "2026-06-08 12:00:00", "end", 1.0)], [("t9", "2026-06-08 12:10:00", "end", 1.0)]]):
        csv(src / f"{k}.csv", rows)
        os.utime(src / f"{k}.csv", (k + 1, k + 1))
    got, dropped = [], []
    q = windows.start_both(windows.replay(spark, str(src)), lambda df, b: got.extend(df.collect()), str(tmp_path / "ck"), available_now=True, dropped=dropped)
    q.awaitTermination(240)
    assert q.exception() is None
    batch = spark.createDataFrame(PINGS, "taxi_id string, ts string, segment_id string, speed_kmh double").withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda r: (r["segment_id"], r["window_start"], r["vehicle_count"], r["avg_speed_kmh"], r["sample_pings"])
    final = [key(r) for r in got if r["is_final"] and r["segment_id"] != "end"]
    assert sorted(final) == sorted(key(r) for r in congestion.sliding_windows(batch).collect()) and len(final) == len(set(final))
    assert {key(r)[:2] for r in got if not r["is_final"] and r["segment_id"] != "end"} == {x[:2] for x in final}
    assert sum(dropped) == 1 and {r["producer"] for r in got} == {"stream"}


def test_late_pings_are_told_apart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    csv(src / "1.csv", [("t", "2026-06-08 08:10:00", "s", 1.0)])
    csv(src / "2.csv", [("t", "2026-06-08 08:06:30", "s", 1.0), ("t", "2026-06-08 08:09:00", "s", 1.0)])
    os.utime(src / "1.csv", (1, 1))
    pings = windows.replay(spark, str(src)).withColumn("source_key", F.lit("k"))
    q = windows.drop_late(pings).writeStream.format("memory").queryName("late_pings").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["ts"]): r["late"] for r in spark.table("late_pings").collect()}
    assert got == {"2026-06-08 08:10:00": False, "2026-06-08 08:06:30": True, "2026-06-08 08:09:00": False}
