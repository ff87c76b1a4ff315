"""Session matters: the shared checkpoint folder and paths that Hadoop resolves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is set and driver and executors are
    one process is a temporary one made; on a cluster a missing setting raises."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="tollgate")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, as a table written in the folder of spark.checkpoint.dir.

    A written table has the size of its files. A checkpoint would keep the size
    estimated for its plan, which loops of joins multiply round by round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_steps(*old: DataFrame) -> None:
    """Delete the tables of ``cut`` frames that nothing reads any more."""
    for df in old:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Hadoop resolves it and Arrow reads it."""
    fs, p = _path(spark, path)
    out = fs.makeQualified(p).toString()
    return "file://" + out[5:] if out.startswith("file:/") and not out.startswith("file://") else out


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none where it doesn't exist."""
    fs, p = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
