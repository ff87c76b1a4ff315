"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process (tests,
    a laptop) a local temporary folder is made and set as the checkpoint
    folder; on a cluster a missing setting raises.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if where:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(where)
        return qualified(spark, where)
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tollgate"))
        known = sc._jsc.sc().getCheckpointDir()
    return qualified(spark, known.get())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Hadoop resolves it and Arrow reads it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + out[5:] if out.startswith("file:/") and not out.startswith("file://") else out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, as Hadoop lists them; none where it doesn't exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """``df`` as a table written in the shared folder, and its path.

    For loops: a checkpointed frame keeps the size that was estimated for its
    plan, and joined with itself round by round that estimate becomes a number
    of more digits than can be handled; a table has the size of its files.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fitting_ids(keys: DataFrame, limits: dict[int, int], chars: int) -> DataFrame:
    """Of ``keys`` (id, chars, kind) the ids of a sample for fitting: of each kind as many
    as ``limits`` has for it, of smallest hash, taken turn by turn while they
    fit in ``chars`` characters together.

    One that doesn't fit is passed over and those behind it are still looked
    at; where none of a kind fits, its shortest is taken all the same. Only
    these rows of ids and lengths come to the driver. An id of several rows
    counts with the longest.
    """
    some = checkpointed(keys.groupBy("id").agg(F.max("chars").alias("chars"), F.max("kind").alias("kind")).withColumn("hash", F.xxhash64("id")))
    kinds = {kind: [(r["chars"] or 0, r["id"]) for r in some.where(F.col("kind") == kind).orderBy("hash", "id").limit(n).collect()] for kind, n in limits.items()}
    turns = sorted((at, kind, size, key) for kind, of in kinds.items() for at, (size, key) in enumerate(of))
    chosen, left = [], chars
    for _, kind, size, key in turns:
        if size <= left:
            chosen.append((key, kind))
            left -= size
    chosen += [(min(of)[1], kind) for kind, of in kinds.items() if of and kind not in {k for _, k in chosen}]
    return keys.sparkSession.createDataFrame([(key,) for key, _ in chosen], keys.select("id").schema)


def array_sums(df: DataFrame, work, size: int, chunk: int = 1 << 13) -> np.ndarray:
    """The sum over tasks of the arrays of ``size`` numbers that ``work(batches)`` makes
    of a task's record batches. Arrays are summed in chunks, side by side; the
    driver gets their sum alone.
    """
    schema = "chunk int, sums binary"

    def run(batches):
        total = np.zeros(-(-size // chunk) * chunk)
        total[:size] = work(batches)
        rows = total.reshape(-1, chunk)
        live = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([rows[k].tobytes() for k in live], pa.binary())], names=["chunk", "sums"])

    def add(batches):
        sums = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "sums"])

    out = np.zeros((-(-size // chunk), chunk))
    for r in df.mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(r["sums"])
    return out.ravel()[:size]


def slices(batches, rows: int = 256):
    """Record batches cut into runs of few rows, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list) -> pa.RecordBatch:
    """``batch`` with columns appended."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
