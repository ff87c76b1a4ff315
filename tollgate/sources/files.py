"""Road extracts and edge tables in files."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import InvalidEdges
from ..session import drop_path, is_folder, names_in, qualified


def read_road_tags(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, tags map<string,string>) of every way in an XML extract."""
    tag = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("tag", tag)])
    ways = spark.read.format("xml").option("rowTag", "way").schema(schema).load(path)
    entries = F.transform(F.coalesce("tag", F.array().cast(tag)), lambda t: F.struct(t["_k"], t["_v"]))
    return ways.select(F.col("_id").alias("osm_id"), F.map_from_entries(entries).alias("tags"))


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, gid, source, target, coords) from Parquet, coordinates rounded to seven places.

    Rows without ends or shape are left out, and shapes other than lines where
    a column geom_type tells. Numbering by (osm_id, gid) is up to the
    derivation, which orders each way's rows by it.
    """
    t = spark.read.parquet(path).where("source is not null and target is not null and coords is not null")
    if "geom_type" in t.columns:
        t = t.where("geom_type = 'LineString'").drop("geom_type")
    return t.withColumn("coords", F.transform("coords", lambda p: F.transform(p, lambda x: F.round(x, 7))))


def wkb_of(coords: DataFrame, column: str, to: str) -> DataFrame:
    """A line's little-endian WKB from an array of [lon, lat] arrays."""
    kind = T.StructType([*coords.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches):
        for b in batches:
            out = [None if c is None else struct.pack("<BII", 1, 2, len(c)) + b"".join(struct.pack("<dd", *p) for p in c) for c in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, to])

    return coords.mapInArrow(run, kind)


def coords_of(table: DataFrame, column: str, to: str) -> DataFrame:
    """An array of [lon, lat] arrays from a line's WKB of either byte order."""
    kind = T.StructType([*table.schema.fields, T.StructField(to, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def points(w):
        if w is None:
            return None
        order = "<" if w[0] == 1 else ">"
        shape, n = struct.unpack_from(order + "II", w, 1)
        if shape != 2:
            raise InvalidEdges(f"WKB shape {shape}, not a line")
        flat = struct.unpack_from(f"{order}{2 * n}d", w, 9)
        return [list(p) for p in zip(flat[::2], flat[1::2])]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([points(w) for w in b.column(column).to_pylist()], pa.list_(pa.list_(pa.float64())))], names=[*b.schema.names, to])

    return table.mapInArrow(run, kind)


def write_edge_parquet(edges: DataFrame, path: str) -> None:
    """A folder of Parquet files with WKB geometry and schema_version "1" in each footer.

    Tasks write their own files, by ranges of edge ids, with Arrow's file system
    of the path's scheme; a file that no finished task names is deleted at the
    end, so a repeated or doubled task leaves nothing.
    """
    t = wkb_of(edges, "geometry", "wkb").drop("geometry").withColumnRenamed("wkb", "geometry").repartitionByRange("edge_id").sortWithinPartitions("edge_id")
    where = qualified(edges.sparkSession, path)

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(where)
        name, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = pq.ParquetWriter(f"{root}/{name}", batch.schema.with_metadata({**(batch.schema.metadata or {}), b"schema_version": b"1"}), filesystem=fs)
            out.write_batch(batch.replace_schema_metadata({**(batch.schema.metadata or {}), b"schema_version": b"1"}))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    named = {r["name"] for r in t.mapInArrow(write, "name string").collect()}
    for extra in set(names_in(edges.sparkSession, where)) - named:
        drop_path(edges.sparkSession, f"{where}/{extra}")


def read_edge_parquet(spark: SparkSession, path: str) -> DataFrame:
    """An edge table from such a file or folder; any other version in a footer is refused."""
    where = qualified(spark, path)
    files = [f"{where}/{n}" for n in names_in(spark, where) if not n.startswith(("_", "."))] if is_folder(spark, where) else [where]

    def versions(batches):
        for batch in batches:
            found = []
            for f in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(f)
                found.append((pq.read_schema(at, filesystem=fs).metadata or {}).get(b"schema_version"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else v.decode("utf-8", "replace") for v in found], pa.string())], names=["file", "version"])

    odd = spark.createDataFrame([(f,) for f in files], "file string").mapInArrow(versions, "file string, version string").where("version is null or version <> '1'").limit(1).collect()
    if odd:
        raise InvalidEdges(f"schema_version {odd[0]['version']!r} in the footer of {odd[0]['file']}")
    return coords_of(spark.read.parquet(path), "geometry", "coords").drop("geometry").withColumnRenamed("coords", "geometry")
