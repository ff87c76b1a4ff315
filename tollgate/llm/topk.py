"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are cut into segments, each with an index of its values. If a code is
within distance d of a query, some segment of it is within that segment's share
of d; so once every segment s has been probed up to radius r_s, all codes nearer
than the sum of (r_s + 1) are known. Radii grow segment by segment, for each
query only until the k-th verified distance is covered. A code that several
segments find is taken by the first alone, which can be told from the codes.

A bounded sample of the codes gives every query an upper bound of its k-th
distance to begin with, so that joins put out none but codes within the bound.
Equal codes are one class with its smallest ids. Segments have at most 22 bits,
so which values a segment's index holds fits a bitmap of 512 kB: a probe step
lists the values at its radius by masks or, where those are more, among the
values held, and sends out none that the index lacks.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored, table
#: Codes in the sample for first bounds; values that a task looks up at once; candidates
#: that cost as much as a probe, which is sent and sorted.
SAMPLE, LOOKUPS, PROBE = 2000, 1 << 20, 32
BITS = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; as unsigned, because numpy counts those of a negative number's absolute value."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)).astype(np.int32)


def sign_code(embedding: Column) -> Column:
    """A 64-bit code: bit i, from the highest, is 1 if dimension i is positive (missing: 0)."""
    bits = F.transform(F.sequence(F.lit(1), F.lit(BITS)), lambda i: F.when(F.get(embedding, i - 1) > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def classes_of(codes: DataFrame, keep: int) -> DataFrame:
    """Distinct codes with n and their ``keep`` smallest ids; ranked in salted groups first."""
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = Window.partitionBy("code", "salt").orderBy("id")
    some = salted.withColumn("at", F.row_number().over(near)).where(F.col("at") <= keep)
    least = some.withColumn("at", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("at") <= keep)
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(counts, "code")


def segments_for(n: int, distance: float) -> int:
    """Segments, of 22 bits at most, whose probes and candidates cost least for a query whose
    answers are within ``distance`` of it, if ``n`` codes spread evenly over the values."""

    def cost(m: int) -> float:
        w = BITS / m
        values = sum(comb(round(w), r) for r in range(int(distance) // m + 1))
        return m * values * (PROBE + n / 2**w)

    return min(range(3, 9), key=cost)


def held_values(index: DataFrame, width: list[int]) -> list[np.ndarray]:
    """For each segment a bitmap of the values its index holds."""
    words = index.groupBy("seg", F.shiftright("value", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(value & 63 AS int))")).alias("bits")).toArrow()
    seg, word, bits = (words[c].to_numpy() for c in ("seg", "word", "bits"))
    out = []
    for s, w in enumerate(width):
        held = np.zeros(max(1, (1 << w) // 64), dtype=np.int64)
        held[word[seg == s]] = bits[seg == s]
        out.append(held)
    return out


def at_radius(own: np.ndarray, width: int, radius: int, held: np.ndarray):
    """Pairs (row of ``own``, value) of the held values that differ from a row's in ``radius`` bits, in runs."""
    if radius > width:
        return
    stored = np.flatnonzero(np.unpackbits(held.view(np.uint8), bitorder="little"))
    every = np.arange(1 << width)
    masks = every[np.bitwise_count(every) == radius]
    by_mask = len(masks) <= len(stored)
    step = max(1, LOOKUPS // max(1, min(len(masks), len(stored))))
    for a in range(0, len(own), step):
        some = own[a : a + step, None]
        if by_mask:
            value = some ^ masks
            row, at = np.nonzero(held[value >> 6] >> (value & 63) & 1)
            yield row + a, value[row, at]
        else:
            row, at = np.nonzero(np.bitwise_count(some ^ stored) == radius)
            yield row + a, stored[at]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each row (query_id, code) of ``queries``: its ``k`` nearest rows of ``codes``
    (id, code) as rank int (from 1), id and distance int.

    Ties go to the smaller id; a row isn't its own neighbour. Rows with a null
    id or code are passed over. With ``k`` rows or fewer all others are
    returned; an empty table gives an empty one. Repeated queries get a result
    each. Other columns are not looked at.
    """
    codes = codes.where("id is not null and code is not null").select("id", "code")
    queries = queries.where("query_id is not null and code is not null").select("query_id", "code")
    spark = codes.sparkSession
    want = k + 1
    classes = checkpointed(classes_of(codes, want).withColumn("least", F.get("ids", F.lit(0))))
    n = classes.count()
    if n == 0:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0).alias("distance")).limit(0)
    sample = classes.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).select("code", "n").toArrow()
    held = spark.sparkContext.broadcast((sample["code"].to_numpy(), sample["n"].to_numpy()))

    def bound(batches):
        code, count = held.value
        for batch in batches:
            q = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for a in range(0, len(q), 256):
                d = distances(q[a : a + 256, None], code[None, :])
                hist = np.stack([np.bincount(row, weights=count, minlength=BITS + 1) for row in d])
                enough = hist.cumsum(axis=1) >= want
                out.append(np.where(enough.any(axis=1), enough.argmax(axis=1), BITS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).astype(np.int32))], names=["q", "bound"])

    pending = checkpointed(queries.select(F.col("code").alias("q")).distinct().mapInArrow(bound, "q long, bound int"))
    m = segments_for(n, pending.agg(F.avg("bound")).first()[0] or 0)
    cuts = np.linspace(0, BITS, m + 1).astype(int)
    width = [int(b - a) for a, b in zip(cuts, cuts[1:])]
    shift = [int(BITS - b) for b in cuts[1:]]
    part = lambda code, s: F.shiftrightunsigned(code, shift[s]).bitwiseAND(F.lit((1 << width[s]) - 1))
    index = checkpointed(classes.select("code", "n", "least", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), part(F.col("code"), s).alias("value")) for s in range(m)))).alias("p")).select("p.seg", "p.value", "code", "n", "least"))
    bitmaps = spark.sparkContext.broadcast(held_values(index, width))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for radius in range(max(width) + 1):
        if pending.isEmpty():
            break
        covered = m * radius - 1

        def probes(batches, radius=radius, covered=covered):
            for batch in batches:
                q, limit = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
                for s in range(m):
                    who = np.flatnonzero(limit > covered + s)
                    own = (q[who].view(np.uint64) >> np.uint64(shift[s])).view(np.int64) & ((1 << width[s]) - 1)
                    for row, value in at_radius(own, width[s], radius, bitmaps.value[s]):
                        yield pa.RecordBatch.from_arrays([pa.array(q[who[row]]), pa.array(limit[who[row]], pa.int32()), pa.array(np.full(len(row), s), pa.int32()), pa.array(value)], names=["q", "bound", "seg", "value"])

        asked = pending.repartition(tasks, "q").mapInArrow(probes, "q long, bound int, seg int, value long")
        differ = F.col("q").bitwiseXOR(F.col("code"))
        apart = F.bit_count(differ)
        first = F.lit(True)
        for s in range(m):
            # An earlier segment has been probed up to this radius, a later one below it.
            first = first & ((F.col("i.seg") == s) | (F.bit_count(part(differ, s)) > F.when(F.col("i.seg") > s, radius).otherwise(radius - 1)))
        # Probes are many times what they are made from, so their estimated size must not invite a broadcast.
        new = index.alias("i").join(asked.hint("merge").alias("a"), (F.col("i.seg") == F.col("a.seg")) & (F.col("i.value") == F.col("a.value")) & (apart <= F.col("bound")) & first)
        new = stored(new.select("q", "code", apart.cast("int").alias("distance"), "n", "least"), "topk")[0]
        found = new if found is None else found.union(new)
        by_distance = Window.partitionBy("q").orderBy("distance")
        counted = found.groupBy("q", "distance").agg(F.sum("n").alias("n")).withColumn("so_far", F.sum("n").over(by_distance))
        tighter = counted.where(F.col("so_far") >= want).groupBy("q").agg(F.min("distance").alias("seen"))
        grown = pending.join(tighter, "q", "left").select("q", F.least("bound", F.coalesce("seen", "bound")).alias("bound"))
        pending = stored(grown.where(F.col("bound") > m * (radius + 1) - 1), "topk")[0]
    if found is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0).alias("distance")).limit(0)
    # Every class has a row, so no more classes than wanted rows can matter.
    found = found.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("distance", "least"))).where(F.col("at") <= want).select("q", "code", "distance")
    listed = found.join(classes.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("id"))
    best = listed.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("at") <= want)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    out = queries.join(lists, queries["code"] == lists["q"]).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", F.col("x.distance").cast("int").alias("distance"))


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 20."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("embedding").isNotNull(), sign_code(F.col("embedding"))).alias("code"))
    queries = codes.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "code")
    return top_k(codes, queries, 10).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP7_SQL = """
WITH c AS (SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance FROM c q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
