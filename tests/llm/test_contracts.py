"""Each registered corpus query on a small fixture with awkward rows, its columns against brute force;
and every stage of the pipeline on the same rows."""

import base64
import hashlib
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tollgate.llm import decontaminate, pieces, pii, secrets, simhash
from tollgate.llm import queries as q

from .test_operators import LONG, PII, SCHEMA, SECRETS, brute_components, brute_fingerprint, brute_hits, brute_pii, brute_secrets, brute_top_k, planted, words_of

KINDS = ("email", "ip", "card", "phone")


def texts():
    r = random.Random(12)
    item = words_of(77, 30)
    base = words_of(1, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    out = [None, "", LONG, " ".join(base), " ".join(base), " ".join(near), "é漢🙂 \t\n\x0b x y", "a b", words_of(5, 40) + ". " + item + "! " + words_of(6, 40), item]
    out += [t for t, _, _ in planted(30)] + SECRETS
    for k in range(40):
        bad = k % 4 == 0
        w = [r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice("abcdefg") for _ in range(r.randint(8, 40))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["vilest", "vilify", "vilely"])
        out.append(" ".join(w))
    return out, item


@pytest.fixture(scope="module")
def rows():
    every, _ = texts()
    out = [(i, t, ("en", "de", None)[i % 3], ("s", None)[i % 2], None if t is None else len(t)) for i, t in enumerate(every)]
    return out + [out[7], (len(out), "a b", "en", "s", 3)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    _, item = texts()
    spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit("clash")).withColumn("ids", F.lit("clash")).withColumn("row_place", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, item), (8, words_of(3, 4)), (9, None), (None, words_of(4, 12))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1 - int(t is not None and "vil" in t), int(t is not None and "vil" in t)) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"u{i}", h) for i, h in enumerate(["<p>a</p>", "<p>é漢</p>", "<p>a</p>", None, "", "x\r\n\r\ny" * 1000])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    r = random.Random(3)
    vectors = [(i, [r.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(300)] + [(300, None), (301, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def run(spark, sf, name):
    return q.queries()[name](spark, sf).collect()


def test_op1(spark, sf, rows):
    got = run(spark, sf, "op1_sharding")
    raw = [(t or "").encode() for _, t, *_ in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((x[0], len(b) + 16, crc32(b)) for x, b in zip(rows, raw))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    held = Counter(r["shard"] for r in got)
    assert set(held) == set(range(40)) and max(held.values()) - min(held.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in held.items())


def test_op2(spark, sf, rows):
    got = run(spark, sf, "op2_simhash")
    code = {x[0]: brute_fingerprint(x[1], 3) for x in rows}
    roots = brute_components(sorted(set(code.values())), 2)
    least = {}
    for i, c in code.items():
        least[roots[c]] = min(i, least.get(roots[c], i))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((x[0], f"{code[x[0]]:016x}", least[roots[code[x[0]]]]) for x in rows)


@pytest.mark.parametrize("name", ["op3_toxicity", "op10_quality"])
def test_scores(spark, sf, rows, name):
    got = run(spark, sf, name)
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    for r in got:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    if name == "op3_toxicity":
        of = {x[0]: x[1] for x in rows}
        by_text = {}
        for r in got:
            by_text.setdefault(of[r["doc_id"]] or "", set()).add(r["score"])
        assert all(len(s) == 1 for s in by_text.values())


def test_op4(spark, sf):
    got = {r["page_id"]: r for r in run(spark, sf, "op4_warc")}
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for i, raw in pages.items():
        first = min(j for j, x in pages.items() if x == raw)
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_op5(spark, sf, rows):
    got = run(spark, sf, "op5_pii")
    of, added = {x[0]: x[1] or "" for x in rows}, 0
    assert len(PII) == 4 and Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    for r in got:
        base = brute_pii(of[r["doc_id"]])
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in base) for i in range(4)] and r["base_sha256"] == digest(said)
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(said) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0])))
        added += len(set(spans) - set(said))
    assert added > 0


def test_op6(spark, sf, rows):
    got = run(spark, sf, "op6_secrets")
    of = {x[0]: x[1] or "" for x in rows}
    kinds = [r.kind for r in secrets.BASE]
    for r in got:
        every = brute_secrets(of[r["doc_id"]])
        base = [x for x in every if x[2] in kinds]
        say = lambda xs: [f"{k}:{s}:{e}" for s, _, k, e in xs]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[2] == k for x in base) for k in kinds]
        assert r["base_sha256"] == digest(say(base)) and r["spans"] == ",".join(say(every))


def test_op7(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    code = {i: sum(1 << 63 - k for k, x in enumerate(v) if x > 0) for i, v in vectors.items() if v is not None}
    rows = sorted(code.items())
    got = {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in run(spark, sf, "op7_topk")}
    assert got == brute_top_k(rows, [x for x in rows if x[0] % 20 == 0], 10)


def test_op8(spark, sf, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    of = {x[0]: x[1] or "" for x in rows}
    for r in run(spark, sf, "op8_pieces"):
        ids = sp.encode(of[r["doc_id"]]) + [sp.eos_id()]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op9(spark, sf, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    of = {x[0]: x[1] for x in rows}
    for r in run(spark, sf, "op9_decontaminate"):
        n, hit, names = brute_hits(of[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), digest(names), hit > 0)


# --- the pipeline's stages ---


def jaccard_groups(docs):
    """Groups of rows that pairs at 0.8 over 5-word shingles connect, by brute force."""
    sets = [frozenset(simhash.shingles(r["text"], 5)) for r in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What goes into each stage, and what comes out of it."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        out[name] = (docs.collect(), spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
    return out


def test_stages_keep_columns_of_any_name(spark, sf, stages):
    first = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, (_, after) in stages.items():
        want = first if name != "pieces" else [c for c in first if c != "ids"] + ["ids", "n_tokens", "round_trip"]
        assert list(after[0].asDict()) == want and all(r["toxic"] == "clash" and r["row_place"] == 1 for r in after)


def test_near_copies_against_brute_force(stages):
    before, after = stages["near_duplicates"]
    groups = {}
    for r, g in zip(before, jaccard_groups(before)):
        groups.setdefault(g, []).append(r)
    least = [min(x["doc_id"] for x in g) for g in groups.values()]
    assert sorted(r["doc_id"] for r in after) == sorted(least) and len(after) < len(before)


def test_benchmark_against_brute_force(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = stages["decontamination"]
    kept = {r["doc_id"]: r for r in after}
    for r in before:
        n, hit, _ = brute_hits(r["text"], items, 10)
        assert (r["doc_id"] in kept) == (hit <= 0.5 * n)
        if r["doc_id"] in kept:
            left = kept[r["doc_id"]]["text"]
            assert (left == r["text"]) == (hit == 0) and len(decontaminate.words(left)) == n - hit


def test_masks_against_brute_force(stages):
    before, after = stages["personal_data"]
    kept = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before)
    for r in before:
        base = brute_pii(r["text"] or "")
        if not base and kept[r["doc_id"]] != r["text"]:
            raise AssertionError(r)
        for s, _, e in base:
            assert r["text"][s:e] not in kept[r["doc_id"]]
        assert not pii.base_spans(kept[r["doc_id"]] or "")


def test_ids_against_the_library(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    before, after = stages["pieces"]
    assert len(after) == len(before)
    for r in after:
        assert r["ids"] == sp.encode(r["text"] or "") + [sp.eos_id()] and r["n_tokens"] == len(r["ids"])


def test_stages_of_nothing(spark, sf):
    """An empty table through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_links_do_not_depend_on_other_rows(spark, sf, tmp_path):
    """Near copies are the same with many unrelated rows beside them."""
    first = spark.read.parquet(f"{sf}/documents.parquet")
    alone = {r["doc_id"] for r in simhash.drop_near_duplicates(first).collect()}
    more = spark.createDataFrame([(100_000 + k, words_of(5000 + k, 30), "en", "s", 0) for k in range(1500)], SCHEMA)
    beside = simhash.drop_near_duplicates(first.select(*corpus_pipeline.COLUMNS).union(more)).where("doc_id < 100000")
    assert {r["doc_id"] for r in beside.collect()} == alone
