"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each input partition go to each target block is drawn first:
given the partitions' row counts and the blocks' sizes, the counts of a uniform
random permutation follow a multivariate hypergeometric law. Each task draws
its own row of that matrix by walking down a binary tree over the partitions;
a tree node's generator is seeded by the node, so all tasks agree without the
matrix ever existing anywhere. A task then permutes the labels of its rows
(local permutation), rows are exchanged by block, and are put in random order
within their block (second permutation).

A shard is cut into blocks of at most ``block_rows`` rows. A block is the unit
of the exchange, so a task's share is bounded whatever a shard's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, table, with_columns

#: numpy's sampler takes populations below this.
NUMPY_LIMIT = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw; for populations beyond numpy's limit by inversion around the mode."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    sd = (n * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - n) / (good + bad - 1))) ** 0.5
    reach = int(40 * sd) + 64
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    # log of p(k + 1) / p(k)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    c = np.cumsum(p)
    return lo + int(np.searchsorted(c, rng.random() * c[-1], side="right"))


def multivariate(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without replacement fall to each of ``sizes``."""
    total = int(sizes.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    if len(sizes) == 1:
        return np.array([n], dtype=np.int64)
    mid = len(sizes) // 2
    left = int(sizes[:mid].sum())
    k = _hypergeometric(rng, left, total - left, n)
    return np.concatenate([multivariate(rng, sizes[:mid], k), multivariate(rng, sizes[mid:], n - k)])


def matrix_row(part: int, ends: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix; ``ends``: 0 and the running sums of the partitions' rows."""
    lo, hi, room = 0, len(ends) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = multivariate(np.random.default_rng([seed, lo, hi]), room, int(ends[mid] - ends[lo]))
        room, lo, hi = (left, lo, mid) if part < mid else (room - left, mid, hi)
    return room


def block_sizes(rows: int, n_shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its size, its shard and the slot it starts at. Shards differ by one row at most."""
    sizes, shard, start = [], [], []
    for s in range(n_shards):
        size = rows // n_shards + (s < rows % n_shards)
        at = np.arange(0, size, block_rows, dtype=np.int64)
        sizes.append(np.minimum(block_rows, size - at))
        shard.append(np.full(len(at), s, dtype=np.int32))
        start.append(at)
    return np.concatenate(sizes), np.concatenate(shard), np.concatenate(start)


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 20240229, block_rows: int = 1 << 17) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long: a uniform random permutation of
    its rows cut into ``n_shards`` runs whose sizes differ by one at most.

    Rows are permuted as rows: repeated, null and tied ones are all kept, each
    with a slot of its own. An empty table gives an empty one; with fewer rows
    than shards some shards stay empty. Columns named shard or slot in ``df``
    are replaced. The input is checkpointed first, so that counts and draws see
    the same partitions even where an executor is lost in between.
    """
    df = checkpointed(df.drop("shard", "slot"))
    spark = df.sparkSession
    key, order = fresh(df, "shuffle_key", "shuffle_order")
    counts = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = max(counts, default=0) + 1
    ends = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(parts)])]).astype(np.int64)
    sizes, shard, start = block_sizes(int(ends[-1]), n_shards, block_rows)
    plan = spark.sparkContext.broadcast((ends, sizes, shard, start))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField(key, T.LongType()), T.StructField(order, T.LongType())])

    def deal(batches):
        ends, sizes, shard, start = plan.value
        part, at, labels = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if labels is None:
                rng = np.random.default_rng([seed, len(ends), part])
                labels = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(part, ends, sizes, seed)))
            mine = labels[at : at + batch.num_rows]
            place = np.arange(at, at + batch.num_rows, dtype=np.int64) + (part << 40)
            at += batch.num_rows
            yield with_columns(batch, ["shard", "slot", key, order], [pa.array(shard[mine], pa.int32()), pa.array(start[mine], pa.int64()), pa.array(rng.integers(0, 1 << 62, batch.num_rows), pa.int64()), pa.array(place, pa.int64())])

    dealt = df.mapInArrow(deal, schema)
    within = Window.partitionBy("shard", "slot").orderBy(key, order)
    return dealt.withColumn(key, F.row_number().over(within)).select(*df.columns, "shard", (F.col("slot") + F.col(key) - 1).alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``; null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Derived from what the shards hold: whole texts are dealt and ordered.
    size = (F.octet_length("text").cast("long") + 16).alias("size")
    return shuffle_into_shards(docs, 40).select("doc_id", size, F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
