"""From raw documents to token ids: toxicity, near copies, benchmark passages,
personal data, encoding.

Each stage takes the documents that its predecessor kept, as a Parquet table,
and works on all of them. All but the last return the columns of documents,
columns of any other name included; the last adds ids, n_tokens and round_trip
in place of columns so named. Null and empty texts pass as texts without words
(as copies of each other only one stays), repeated rows are exact copies, an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import decontaminate, pieces, pii, simhash, toxicity
from tollgate.llm.common import drop_path, shared_path, table
from tollgate.ship import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def beside_others(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the columns it knows; what else there is rides along in one struct, so that no name clashes."""
    rest = [c for c in docs.columns if c not in COLUMNS]
    out = work(docs.select(*COLUMNS, *([F.struct(*rest).alias("others")] if rest else [])))
    return out.select(*(F.col("others")[c].alias(c) if c in rest else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches their language's threshold go."""
    ship(spark)
    model = toxicity.fit(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return beside_others(docs, lambda d: toxicity.score(d, model).where(~F.col("toxic")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    ship(spark)
    return simhash.drop_near_duplicates(docs, similarity=0.8, words=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    ship(spark)
    bench = table(spark, sf_dir, "benchmark")
    return beside_others(docs, lambda d: decontaminate.remove_contamination(d, bench).withColumn("n_chars", F.length("text").cast("long")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship(spark)
    field = pii.fit(docs.select(*COLUMNS))
    return beside_others(docs, lambda d: pii.redact(d, field).withColumn("n_chars", F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and whether decoding them gives the text back."""
    ship(spark)
    names = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip", "decoded")]
    out = pieces.encode_texts(docs.select(*names), pieces.default_model(), decode=True)
    same = F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ") == F.col("decoded")
    return out.select(*names, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("pieces", encode),
]

#: SQL expresses neither the classifier nor the field; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
