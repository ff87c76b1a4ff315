"""Edge tables as GeoJSON: read with all checks or not at all, and written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import InvalidEdges, checked

#: Bytes that are read, at most, and characters that are written at once.
MAX_BYTES, CHUNK = 512 << 20, 1 << 20
PROPERTIES = T.StructType(
    [T.StructField(n, t) for n, t in (("segment_id", T.StringType()), ("edge_id", T.LongType()), ("source_node", T.LongType()), ("target_node", T.LongType()), ("osm_way_id", T.LongType()), ("highway_class", T.StringType()), ("lanes_effective", T.IntegerType()), ("length_m", T.DoubleType()), ("maxspeed_kmh", T.DoubleType()), ("freeflow_time_s", T.DoubleType()), ("capacity_vph", T.DoubleType()))]
)
FEATURE = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", PROPERTIES), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))]))])


def read_edges(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A checked edge table, with ``row`` as in the file.

    The envelope has to be a FeatureCollection whose schema_version is the JSON
    number 1 (not a string, not 1.0), and no larger than 512 MiB; a larger one
    is refused, not cut.
    """
    size = spark.read.format("binaryFile").load(path).select(F.sum("length").alias("n")).first()["n"] or 0
    if size > MAX_BYTES:
        raise InvalidEdges(f"{size} bytes; at most {MAX_BYTES} are read")
    # Of the envelope alone: a whole number is read as such, a string or 1.0 as null.
    head = spark.read.schema("type string, schema_version long").option("multiLine", True).json(path).limit(1000).collect()
    for h in head:
        if h["type"] != "FeatureCollection" or h["schema_version"] != 1:
            raise InvalidEdges(f"envelope: type {h['type']!r}, schema_version {h['schema_version']!r}")
    body = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(FEATURE))])).option("multiLine", True).json(path)
    f = body.select(F.posexplode("features").alias("row", "f"))
    odd = f.where("f.type <> 'Feature' or f.geometry.type <> 'LineString' or f is null").limit(1).collect()
    if odd:
        raise InvalidEdges(f"row {odd[0]['row']}: not a LineString feature")
    return checked(f.select("row", "f.properties.*", F.col("f.geometry.coordinates").alias("geometry")), bounds)


def feature_json(edges: DataFrame) -> DataFrame:
    """(edge_id, feature): each edge as a GeoJSON feature."""
    props = F.struct(*[n for n in PROPERTIES.names])
    return edges.select("edge_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("geometry").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("feature"))


def write_edges(edges: DataFrame, path: str) -> None:
    """One GeoJSON file in any file system that Hadoop reaches; features are streamed to it
    in the order of their ids, one partition at a time."""
    sc = edges.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    held = ['{"type": "FeatureCollection", "schema_version": 1, "features": [']
    size = 0
    for k, r in enumerate(feature_json(edges).orderBy("edge_id").toLocalIterator()):
        held.append((",\n" if k else "\n") + r["feature"])
        size += len(held[-1])
        if size > CHUNK:
            out.write(bytearray("".join(held).encode("utf-8")))
            held, size = [], 0
    out.write(bytearray("".join([*held, "\n]}\n"]).encode("utf-8")))
    out.close()


def graph_geojson(edges: DataFrame) -> DataFrame:
    """Geometry alone: (segment_id, feature) by segment, without anything that changes."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("geometry").alias("coordinates")).alias("geometry"), F.struct("segment_id").alias("properties"))
    return edges.select("segment_id", F.to_json(f).alias("feature")).orderBy("segment_id")


def version_token(text: str) -> str:
    """The schema_version of an envelope as it stands."""
    return json.dumps(json.loads(text).get("schema_version"))
