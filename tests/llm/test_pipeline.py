"""The pipeline's stages and the registered queries on the smallest tables."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from tollgate.llm import decontaminate, pieces
from tollgate.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage keeps."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_pass_documents_on(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(set(s.columns) == set(first.columns) for s in stages[:-1])
    counts = [first.count(), *(s.count() for s in stages)]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]


def test_copies_are_gone(stages):
    texts = [r["text"] for r in stages[1].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_no_benchmark_passage_is_left(spark, stages):
    left = decontaminate.match_items(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.where("n_hit > 0").count() == 0


def test_addresses_are_masked(stages):
    assert stages[3].where(r"text rlike '[a-z0-9.]+@[a-z0-9]+[.][a-z]+'").count() == 0


def test_ids_are_those_of_the_library(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rows = stages[4].collect()
    assert rows and all(r["round_trip"] and r["ids"] == sp.encode(r["text"]) + [sp.eos_id()] for r in rows)


def test_run_applies_all_stages(spark, stages):
    ids = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in stages[-1].select("doc_id").collect())


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert set(q.queries()) <= names and set(q.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert {n.split("_")[0] for n in q.queries()} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
