"""Scalar layer: hand vectors."""

import math

import pytest
from pyspark.sql import functions as F

from tollgate.functions import demand, display, geo, osm, segment
from tollgate.functions.cost import Bpr, Linear
from tollgate.plans.catalogue import RAMP


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


@pytest.mark.parametrize("v, cap, cost, marginal", [(0, 1000, 10, 10), (1000, 1000, 11.5, 17.5), (2000, 1000, 34, 130), (500, 0, 10, 10), (-500, 1000, 10, 10)])
def test_bpr(spark, v, cap, cost, marginal):
    a = [F.lit(10.0), F.lit(float(v)), F.lit(float(cap))]
    assert one(spark, Bpr().cost(*a), Bpr().marginal(*a)) == pytest.approx((cost, marginal))


def test_cost_options(spark):
    a = [F.lit(10.0), F.lit(500.0), F.lit(1000.0)]
    assert one(spark, Bpr(beta=0).cost(*a), Bpr(alpha=1, beta=0.5).cost(*a), Linear().cost(*a), Bpr(scale=0.5).cost(*a)) == pytest.approx((11.5, 10 * (1 + math.sqrt(0.5)), 10.75, 11.5))
    for kind in (Bpr, Linear):
        with pytest.raises(ValueError):
            kind(scale=0)


BAD_IDS = ["", "123456789", "123456789:0", "123456789:0:F:extra", "123456789:0:F:", "123456789::F", ":0:F", "123456789:0:", "abc:0:F", "123456789:x:F", "-5:0:F", "123456789:-1:F", "+5:0:F", "1:0:X", "1:0:f", "1:0:FR", "1:0:Forward", " 1:0:F", "1:0:F ", "0x1F:0:F", "123456789:0F", "0:0:F", "007:0:F", "1:00:F", "9223372036854775808:0:F", "1:0:F\n"]


def test_segment_ids(spark):
    bad = spark.createDataFrame([(x,) for x in BAD_IDS], "t string").select(segment.parse_segment_id(F.col("t")).alias("p"))
    assert bad.where("p is not null").count() == 0
    good = [(9223372036854775807, 65535, "R"), (1, 0, "F")]
    df = spark.createDataFrame(good, "w long, s long, d string").withColumn("t", segment.format_segment_id(F.col("w"), F.col("s"), F.col("d"))).withColumn("p", segment.parse_segment_id(F.col("t")))
    assert [(r["p"]["way"], r["p"]["seq"], r["p"]["dir"]) for r in df.collect()] == good


def test_instants(spark):
    texts = ["2026-06-08T08:00:00Z", "2026-06-08T08:00:00+00:00", "2026-06-31T08:00:00Z", "2026-06-08T08:00:00.0Z", "2026-06-08T24:00:00Z", "2026-6-8T08:00:00Z", None]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(segment.parse_instant(F.col("x")).cast("string").alias("t")).collect()]
    assert got == ["2026-06-08 08:00:00"] + [None] * 6


def test_buckets(spark):
    values = [-1.0, float("nan"), 0.0, 0.05, 0.1, 0.15, 0.2, 2.29, 2.3, 5.0, 1000.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(display.vc_bucket(F.col("v"))).collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2, 22, 23, 23, 23]
    assert one(spark, display.bucket_rgb(F.lit(0), RAMP), display.bucket_rgb(F.lit(99), RAMP)) == (list(RAMP[0]), list(RAMP[-1]))


def test_labels(spark):
    assert one(spark, display.metric_text(F.lit(1.006)), display.metric_text(F.lit(None).cast("double")), display.clock_label(F.lit(-30)), display.clock_label(F.lit(1445))) == ("1.01", "—", "23:30", "00:05")


def test_diurnal(spark):
    at = lambda s: demand.diurnal_factor(F.lit(s).cast("timestamp"))
    eight, five, three, noon, other = one(spark, at("2024-01-01 08:00:00"), at("2024-01-01 17:30:00"), at("2024-01-01 03:00:00"), at("2024-01-01 12:30:00"), at("2030-07-07 08:00:00"))
    assert eight == five == other == 1.0 and three == pytest.approx(0.18, abs=0.02) and eight > noon > three
    assert demand.factor_of_seconds(8 * 3600) == 1.0


def test_departures(spark):
    rows = [r["depart_s"] for r in demand.departure_spread(spark, 7 * 3600, 3600.0, 500).orderBy("idx").collect()]
    assert rows == sorted(rows) and 0 < rows[0] and rows[-1] < 3600
    # Demand grows towards eight, so more depart late.
    assert sum(x > 1800 for x in rows) > 250
    assert demand.departure_spread(spark, 0, 3600.0, 0).count() == 0
    assert {r["depart_s"] for r in demand.departure_spread(spark, 0, 0, 5).collect()} == {0.0}


@pytest.mark.parametrize("text, lanes", [("2", 2), ("2;3", 2), ("1.5", 1), ("0", None), ("x", None), (" 4", 4), (None, None)])
def test_lanes(spark, text, lanes):
    assert one(spark, osm.leading_int(F.lit(text).cast("string")))[0] == lanes


@pytest.mark.parametrize("text, kmh", [("50", 50), ("30 mph", 48.28032), ("none", None), ("walk", None), ("ro:urban", None), ("0", None), ("80.5", 80.5), ("1.2.3", None), (None, None)])
def test_speeds(spark, text, kmh):
    got = one(spark, osm.speed_kmh(F.lit(text).cast("string")))[0]
    assert got == (pytest.approx(kmh) if kmh else None)


@pytest.mark.parametrize("oneway, junction, cls, dirs", [("yes", None, "primary", "F"), ("-1", None, "primary", "R"), ("no", None, "motorway", "FR"), (None, None, "motorway", "F"), (None, "roundabout", "service", "F"), (None, None, "service", "FR"), (" TRUE", None, "service", "F")])
def test_directions(spark, oneway, junction, cls, dirs):
    c = lambda x: F.lit(x).cast("string")
    assert "".join(one(spark, osm.directions(c(oneway), c(junction), c(cls)))[0]) == dirs


def test_effective_lanes(spark):
    c = lambda x: F.lit(x).cast("string")
    f = lambda own, bare, one_way: osm.effective_lanes(c(own), c(bare), F.lit(one_way), c("trunk"))
    assert one(spark, f("4", "2", False), f(None, "6", False), f(None, "1", False), f(None, "5", True), f(None, None, False)) == (4, 3, 1, 5, 2)


def test_geometry(spark):
    line = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0))))
    length, east, near = one(spark, geo.polyline_m(line), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.point_to_segment_m(F.lit(0.001), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert length == pytest.approx(111194.93 + 111177.99, abs=1) and east == pytest.approx(90) and near == pytest.approx(111.19, abs=0.1)


def test_instants_for_people(spark):
    start, parts, bad, label, other = one(spark, display.start_instant(F.lit("2026-06-22"), F.lit(1500)), display.start_parts(F.lit("2026-06-22T08:05:09Z")), display.start_parts(F.lit("soon")), display.instant_label(F.lit("2026-06-22T08:00:00Z")), display.instant_label(F.lit("soon")))
    assert start == "2026-06-22T01:00:00Z" and tuple(parts) == ("2026-06-22", 485) and tuple(bad) == ("", 0)
    assert label == "Jun 22, 2026 · 08:00 UTC" and other == "soon"
    tag = display.etag(F.lit("x"))
    assert one(spark, display.etag_matches(tag, tag), display.etag_matches(F.concat(F.lit('"a", W/'), tag), tag), display.etag_matches(F.lit("*"), tag), display.etag_matches(F.lit('"a"'), tag)) == (True, True, True, False)
