"""Origin–destination sets: synthesis, tab-separated text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.demand import hash_uniform
from ..operators.network import Network, draw_pairs

SCHEMA = "id string, from_lat double, from_lon double, to_lat double, to_lon double, depart_at double, weight double"


def synthesize(network: Network, count: int, total_vph: float, seed: int) -> DataFrame:
    """(idx, id, src, dst, weight): ``count`` uniform draws from all reachable pairs, weights even.

    Pairs are numbered in ascending order; a draw is a function of seed and
    index. Without pairs or with a count of 0 or less the set is empty. The
    pairs themselves are counted, not made.
    """
    spark, count = network.edges.sparkSession, max(0, count)
    draws = spark.range(count).select(F.col("id").alias("idx")).withColumn("u", hash_uniform(seed, F.col("idx")))
    drawn, _ = draw_pairs(network.edges, draws)
    return drawn.select("idx", F.format_string("od-%04d", F.col("idx")).alias("id"), "src", "dst", F.lit(total_vph / count if count else 0.0).alias("weight"))


def labelled(od: DataFrame) -> DataFrame:
    """``od`` with the label of each pair of nodes."""
    return od.withColumn("label", F.format_string("n%d->n%d", "src", "dst"))


def label_counts(od: DataFrame) -> DataFrame:
    """(label, requests) in the order of the labels."""
    return labelled(od).groupBy("label").agg(F.count(F.lit(1)).alias("requests")).orderBy("label")


def requests_at(od: DataFrame, departures: DataFrame | None = None) -> DataFrame:
    """Routing requests of an OD set: all at once, or at ``departures`` (idx, depart_s)."""
    out = od.withColumnRenamed("id", "request_id")
    return out.withColumn("depart_s", F.lit(0.0)) if departures is None else out.join(departures, "idx")


def to_lines(requests: DataFrame) -> DataFrame:
    """One tab-separated line per request (columns of SCHEMA), numbers in their shortest form."""
    bad = requests.where(F.col("id").rlike(r"[\t\n\r]")).limit(1).count()
    if bad:
        raise ValueError("an id holds a tab or a line end")
    return requests.select(F.concat_ws("\t", "id", *(F.col(c.split()[0]).cast("string") for c in SCHEMA.split(", ")[1:])).alias("value"))


def write_tsv(requests: DataFrame, path: str) -> None:
    to_lines(requests).write.text(path)


def from_lines(lines: DataFrame) -> DataFrame:
    """Requests from lines of exactly seven fields; blank lines are passed over, others are an error."""
    parts = F.split("value", "\t", -1)
    rows = lines.where(F.trim("value") != "").withColumn("p", parts)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    num = [F.get("p", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names) if k]
    out = rows.select(F.get("p", F.lit(0)).alias("id"), *num, F.size("p").alias("n"), "value")
    bad = out.where("n <> 7" + "".join(f" or {n} is null" for n in names[1:])).limit(1).collect()
    if bad:
        raise ValueError(f"not a request: {bad[0]['value']!r}")
    return out.select(*names)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))


def to_json(od: DataFrame, nodes: DataFrame, seed: int, level: str, target_vc: float, total_vph: float) -> DataFrame:
    """One row with the set as a JSON document: places by coordinates, not by node ids, which
    a later numbering may change; a document is one value and holds a set as a whole."""
    n = nodes.select("node_id", F.struct("lat", "lon").alias("place"))
    placed = labelled(od).join(n.toDF("src", "from"), "src").join(n.toDF("dst", "to"), "dst")
    one = F.struct("idx", F.struct("id", "from", "to", F.col("weight").alias("weight_vph"), "label").alias("r"))
    reqs = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"])
    return placed.agg(reqs.alias("requests")).select(F.to_json(F.struct(F.lit(seed).alias("seed"), F.lit(level).alias("demand_level"), F.lit(target_vc).alias("target_vc"), F.lit(total_vph).alias("total_demand_vph"), "requests")).alias("body"))
