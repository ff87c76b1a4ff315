"""Quality by co-training of a text view and a metadata view.

Two logistic classifiers see different sides of a document: its hashed words,
and what is known about it without reading the words (source, language, length
and layout). Both are first fitted on labelled rows. Then, over some rounds,
each view marks the documents without a label that it is surest of, over the
whole table and in shares that grow by round, and the other view goes on
learning from these marks and from all labelled rows: each step's gradient is
summed over all tasks. Last, each view's logit is calibrated on labelled rows
kept aside, and the calibrated views together score all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array_sums, drop_path, fitting_ids, slices, stored, table, with_columns
from .toxicity import is_held_out, sigmoid

#: Labelled documents of either label that the views begin with, and their distinct hashed words together, at most.
LABELLED, SAMPLE_IDS = {0: 2000, 1: 4000}, 20_000_000
#: Words and metadata hash to so many places.
BUCKETS, META = 1 << 16, 1 << 8
#: Rounds, steps of a round, and the share of unlabelled documents that a view marks in the last round.
ROUNDS, STEPS, SURE = 4, 5, 0.5
#: Logits are counted in so many bins from -SPAN to SPAN.
BINS, SPAN = 4096, 32.0


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (split at white space, with punctuation), and of each the logarithm
    of its count plus one, in sixteenths."""
    places: dict[int, int] = {}
    for w, n in Counter(text.encode("utf-8", "surrogatepass").lower().split() if text else ()).items():
        at = crc32(w) % BUCKETS
        places[at] = places.get(at, 0) + n
    ids = np.array(sorted(places), dtype=np.uint16)
    return ids, np.minimum(255, np.rint(16 * np.log1p([places[i] for i in ids.tolist()]))).astype(np.uint8)


def meta_features(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Places of a dense vector: hashed source and language, binned length and layout."""
    text = text or ""
    lines = text.count("\n") + 1
    marks = sum(text.count(c) for c in "|%$&*#<>{}") / max(1, len(text))
    spaces = text.count(" ") / max(1, len(text))
    names = [f"s:{source}", f"l:{lang}", f"n:{int(n_chars or 0).bit_length()}", f"b:{min(40, lines)}", f"w:{int(np.log2(len(text) / lines + 1))}", f"m:{min(20, int(marks * 200))}", f"p:{int(spaces * 50)}"]
    return np.array([crc32(x.encode()) % META for x in names], dtype=np.uint8)


@dataclass
class Matrix:
    """Sparse rows: row numbers, columns and values."""

    n: int
    at: np.ndarray
    col: np.ndarray
    val: np.ndarray


def text_matrix(ids: list[bytes], logs: list[bytes]) -> Matrix:
    """Rows of length 1 from hashed words and their logarithms."""
    at = np.repeat(np.arange(len(ids)), [len(x) // 2 for x in ids])
    val = np.frombuffer(b"".join(logs), dtype=np.uint8).astype(np.float64)
    size = np.sqrt(np.bincount(at, val * val, len(ids)))
    return Matrix(len(ids), at, np.frombuffer(b"".join(ids), dtype=np.uint16).astype(np.int64), val / size[at])


def meta_matrix(meta: list[bytes]) -> Matrix:
    at = np.repeat(np.arange(len(meta)), [len(x) for x in meta])
    return Matrix(len(meta), at, np.frombuffer(b"".join(meta), dtype=np.uint8).astype(np.int64), np.ones(len(at)))


class Logistic:
    """Weights and their Adagrad sums; the intercept is the last."""

    def __init__(self, width: int):
        self.w, self.sums = np.zeros(width + 1), np.full(width + 1, 1e-12)

    def logits(self, x: Matrix) -> np.ndarray:
        return np.bincount(x.at, x.val * self.w[x.col], x.n) + self.w[-1]

    def gradient(self, x: Matrix, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        g = (sigmoid(self.logits(x)) - y) * weight
        return np.append(np.bincount(x.col, x.val * g[x.at], len(self.w) - 1), g.sum())

    def step(self, gradient: np.ndarray, rate: float = 0.5, decay: float = 1e-5) -> None:
        g = gradient + decay * np.append(self.w[:-1], 0.0)
        self.sums += g * g
        self.w -= rate * g / np.sqrt(self.sums)


def balanced(y: np.ndarray, share: float = 1.0) -> np.ndarray:
    """Weights that give either label half of ``share``, or the only one all of it."""
    return halves(np.array([(y == k).sum() for k in (0, 1)]), share)[y.astype(int)]


def fit_logistic(x: Matrix, width: int, y: np.ndarray, steps: int = 150) -> Logistic:
    """Balanced logistic regression by Adagrad over the whole set."""
    out, weight = Logistic(width), balanced(y)
    for _ in range(steps if len(y) else 0):
        out.step(out.gradient(x, y, weight))
    return out


def fit_platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic calibration of columns ``x``, with an intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Views:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Mean of the calibrated views' log odds."""
        return sigmoid((t * self.text_scale[0] + self.text_scale[1] + m * self.meta_scale[0] + self.meta_scale[1]) / 2)


def logits(w: np.ndarray, x: Matrix) -> np.ndarray:
    out = Logistic(0)
    out.w = w
    return out.logits(x)


def cuts_of(counts: np.ndarray, low: float, high: float) -> tuple[int, int]:
    """Bins before the first and from the second on hold at most ``low`` and ``high`` of the counted documents."""
    below = np.concatenate([[0], np.cumsum(counts)])
    return int(np.searchsorted(below, low, side="right")) - 1, int(np.searchsorted(below, below[-1] - high, side="left"))


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.clip((z + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)


def matrices(batches):
    """(labels with -1 for none, text matrix, metadata matrix) of each run of feature rows."""
    for batch in slices(batches, 4096):
        ids, logs, meta = (batch.column(c).to_pylist() for c in ("ids", "logs", "meta"))
        yield batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), (text_matrix(ids, logs), meta_matrix(meta))


def co_train(rows: DataFrame, views: list[Logistic], counts: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> None:
    """Let ``views`` (text, metadata) learn from all ``rows`` (y int: -1 without a label, ids, logs, meta).

    ``counts``: labelled rows of label 0 and 1. Labelled rows and marked ones
    have half of the weight each, and either label half of that.
    """
    sc, share = rows.sparkSession.sparkContext, counts[1] / max(1, counts.sum())
    widths = [len(v.w) for v in views]
    for r in range(rounds):
        start = sc.broadcast([v.w for v in views])

        def count(batches, start=start):
            out = np.zeros((2, BINS))
            for y, both in matrices(batches):
                for v, x in enumerate(both):
                    out[v] += np.bincount(bins_of(logits(start.value[v], x)[y < 0]), minlength=BINS)
            return out.ravel()

        seen = array_sums(rows, count, 2 * BINS).reshape(2, BINS)
        sure = SURE * (r + 1) / rounds * seen.sum(axis=1)
        edges = [cuts_of(seen[v], sure[v] * (1 - share), sure[v] * share) for v in range(2)]
        marked = [[seen[v][: e[0]].sum(), seen[v][e[1] :].sum()] for v, e in enumerate(edges)]
        weight = [[halves(counts, 0.5 if sum(marked[1 - v]) else 1.0), halves(np.array(marked[1 - v]), 0.5)] for v in range(2)]
        for _ in range(steps):
            now = sc.broadcast([v.w for v in views])

            def gradients(batches, start=start, now=now, edges=edges, weight=weight):
                out = [np.zeros(n) for n in widths]
                for y, both in matrices(batches):
                    began = [logits(start.value[v], x) for v, x in enumerate(both)]
                    for v, x in enumerate(both):
                        low, high = edges[1 - v]
                        other = bins_of(began[1 - v])
                        mark = np.where(other >= high, 1, np.where(other < low, 0, -1))
                        own = np.where(y >= 0, y, mark)
                        w = np.where(y >= 0, weight[v][0][np.maximum(y, 0)], np.where(mark >= 0, weight[v][1][np.maximum(mark, 0)], 0.0))
                        model = Logistic(0)
                        model.w = now.value[v]
                        out[v] += model.gradient(x, (own == 1).astype(float), w)
                return np.concatenate(out)

            g = array_sums(rows, gradients, sum(widths))
            views[0].step(g[: widths[0]])
            views[1].step(g[widths[0] :])
            now.destroy()
        start.destroy()


def halves(n: np.ndarray, share: float) -> np.ndarray:
    """What a row of label 0 and of label 1 weighs if ``n`` rows of either share ``share`` evenly."""
    return share / max(1, (n > 0).sum()) / np.maximum(n, 1)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of either view."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.BinaryType()) for n in ("ids", "logs", "meta"))])

    def run(batches):
        for batch in slices(batches):
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("text", "source", "lang", "n_chars"))))
            words = [text_features(r[0]) for r in rows]
            made = [[w[k].tobytes() for w in words] for k in range(2)] + [[meta_features(*r).tobytes() for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m, pa.binary()) for m in made)], names=["doc_id", "ids", "logs", "meta"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, limits: dict[int, int] = LABELLED, rounds: int = ROUNDS) -> Views:
    """Fit the views; labels of the held-out fifth are never read, their documents count
    as unlabelled.

    The first fit and the calibration take a bounded sample of labelled rows
    (a fifth of it is kept for calibration), co-training all rows. Repeated
    labels of a document count as the highest. Without labels every score is
    one half.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    kept = F.crc32(F.concat(F.lit("kept"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    rows, path = stored(featured(docs).join(known, "doc_id", "left").select("doc_id", "ids", "logs", "meta", "y", (F.col("y").isNotNull() & kept).alias("kept")), "quality")
    named = rows.where("y is not null")
    chosen = fitting_ids(named.select(F.col("doc_id").alias("id"), (F.length("ids") / 2).cast("long").alias("chars"), F.col("y").alias("kind")), limits, SAMPLE_IDS)
    got = named.join(F.broadcast(chosen), named["doc_id"] == chosen["id"]).groupBy("doc_id").agg(F.min(F.struct("ids", "logs", "meta", "y", "kept")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    y, aside = got["y"].to_numpy().astype(float), got["kept"].to_numpy().astype(bool)
    both = text_matrix(got["ids"].to_pylist(), got["logs"].to_pylist()), meta_matrix(got["meta"].to_pylist())
    begin = lambda x, part: Matrix(int(part.sum()), (np.cumsum(part) - 1)[x.at[part[x.at]]], x.col[part[x.at]], x.val[part[x.at]])
    views = [fit_logistic(begin(x, ~aside), width, y[~aside]) for x, width in zip(both, (BUCKETS, META))]
    counts = {r["y"]: r["n"] for r in named.where(~F.col("kept")).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if rounds and len(y):
        pool = rows.where(~F.col("kept")).select(F.coalesce("y", F.lit(-1)).alias("y"), "ids", "logs", "meta")
        co_train(pool, views, np.array([counts.get(0, 0), counts.get(1, 0)]), rounds)
    drop_path(docs.sparkSession, path)
    scales = [fit_platt(v.logits(x)[aside][:, None], y[aside]) if 0 < y[aside].sum() < aside.sum() else np.array([1.0, 0.0]) for v, x in zip(views, both)]
    return Views(*(v.w for v in views), *scales)


def score(docs: DataFrame, views: Views) -> DataFrame:
    """``docs`` with text_logit, meta_logit and score (0 to 1, higher: better).

    Nulls count as empty texts, unknown sources and length 0. Columns of these
    names are replaced.
    """
    made = ["text_logit", "meta_logit", "score"]
    docs = docs.drop(*made)
    sent = docs.sparkSession.sparkContext.broadcast(views)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in made)])

    def run(batches):
        v = sent.value
        for batch in slices(batches):
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("text", "source", "lang", "n_chars"))))
            words = [text_features(r[0]) for r in rows]
            t = logits(v.text, text_matrix([w[0].tobytes() for w in words], [w[1].tobytes() for w in words]))
            m = logits(v.meta, meta_matrix([meta_features(*r).tobytes() for r in rows]))
            yield with_columns(batch, made, [pa.array(t), pa.array(m), pa.array(v.score(t, m))])

    return docs.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score and whether it is kept (score of at least 0.5)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "text_logit", "meta_logit", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
