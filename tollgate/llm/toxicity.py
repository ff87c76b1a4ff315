"""Toxicity by a convolutional text classifier trained in numpy.

Words and their beginnings are hashed into an embedding table; filters of several widths run over
the whole text, each filter's largest response feeds a logistic output.
Training follows the gradient through the winning positions only. The score
depends on nothing but the text. A decision threshold for each language is
calibrated on labelled rows kept from training; it makes the extra column
``toxic`` and never touches the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitting_ids, slices, table, with_columns

#: Labelled documents of either label that a model is fitted on, and their characters together, at most.
SAMPLE, SAMPLE_CHARS = {0: 3000, 1: 1500}, 48_000_000
#: Windows scored at once.
WINDOWS = 1 << 16
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
#: A word's vector is the mean of those of its hashes: the word and its beginnings of so many characters.
PREFIXES = (3, 4, 5, 6, 7)
#: Distinct words whose responses a task keeps.
CACHE_WORDS = 100_000

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text, padded with empty ones to the widest filter."""
    ws = text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []
    return ws + [b""] * (max(WIDTHS) - len(ws))


def hashes(word: bytes) -> list[int]:
    """Places of a word in the embedding table; of padding 0 only."""
    if not word:
        return [0] * (1 + len(PREFIXES))
    w = word.decode("utf-8", "replace").lower()
    return [crc32(b"=" + w.encode()) % (BUCKETS - 1) + 1] + [crc32(w[:n].encode()) % (BUCKETS - 1) + 1 if len(w) >= n else 0 for n in PREFIXES]


@dataclass
class Model:
    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, places: np.ndarray) -> np.ndarray:
        return self.emb[places].mean(axis=1)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses to a run of word vectors, and where they are."""
        values, places = [], []
        for w, filters, bias in zip(WIDTHS, self.conv, self.bias):
            n = len(x) - w + 1
            r = sum(x[j : j + n] @ filters[j] for j in range(w))
            at = r.argmax(axis=0)
            places.append(at)
            values.append(r[at, np.arange(FILTERS)] + bias)
        return np.concatenate(values), places


class Scorer:
    """Scores whole texts; each distinct word's response to each filter is worked out once."""

    def __init__(self, model: Model):
        self.m = model
        self.filters = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in model.conv], axis=1)
        self.known: dict[bytes, int] = {}
        self.rows = np.empty((CACHE_WORDS, self.filters.shape[1]), dtype=np.float32)

    def learn(self, docs: list[list[bytes]]) -> None:
        new = [w for w in set().union(*docs) if w not in self.known]
        if len(self.known) + len(new) > len(self.rows):
            self.known, new = {}, list(set().union(*docs))
            if len(new) > len(self.rows):
                self.rows = np.empty((len(new), self.filters.shape[1]), dtype=np.float32)
        for a in range(0, len(new), 16_384):
            some, at = new[a : a + 16_384], len(self.known)
            self.known.update(zip(some, range(at, at + len(some))))
            self.rows[at : at + len(some)] = self.m.vectors(np.array([hashes(w) for w in some], dtype=np.int32)) @ self.filters

    def logit(self, ws: list[bytes]) -> float:
        ids = np.fromiter(map(self.known.__getitem__, ws), dtype=np.int32, count=len(ws))
        best, col = [], 0
        for w, bias in zip(WIDTHS, self.m.bias):
            n, top = len(ids) - w + 1, None
            for a in range(0, n, WINDOWS):
                b = min(n, a + WINDOWS)
                r = self.rows[ids[a:b], col : col + FILTERS]
                for j in range(1, w):
                    r += self.rows[ids[a + j : b + j], col + j * FILTERS : col + (j + 1) * FILTERS]
                top = r.max(axis=0) if top is None else np.maximum(top, r.max(axis=0))
            best.append(top + bias)
            col += w * FILTERS
        return float(np.maximum(np.concatenate(best), 0) @ self.m.out + self.m.out_bias)

    def scores(self, texts) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 64):
            docs = [words(t) for t in texts[at : at + 64]]
            self.learn(docs)
            out += [self.logit(d) for d in docs]
        return sigmoid(np.array(out))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = 6, rate: float = 0.1) -> Model:
    """Fit by Adagrad, one document at a time; ``docs``: the hashes of each one's words."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)
    m.emb[0] = 0
    of_emb, of_conv, of_bias, of_out, of_out_bias = np.full((BUCKETS, DIM), 1e-2, np.float32), [np.full_like(c, 1e-2) for c in m.conv], [np.full_like(b, 1e-2) for b in m.bias], np.full_like(m.out, 1e-2), 1e-2
    if len(docs) == 0:
        m.out[:] = 0
        return m
    weight = np.where(labels == 1, min(4.0, max(1.0, (labels == 0).sum() / max(1, (labels == 1).sum()) / 2)), 1.0)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            x = m.vectors(docs[i])
            z, places = m.pooled(x)
            h = np.maximum(z, 0)
            drop = (rng.random(len(h)) < 0.8) / np.float32(0.8)
            g = np.float32((sigmoid((h * drop) @ m.out + m.out_bias) - labels[i]) * weight[i])
            if abs(g) < 1e-3:
                continue
            gh = g * m.out * (z > 0) * drop
            go = g * h * drop + 1e-4 * m.out
            of_out += go * go
            m.out -= rate * go / np.sqrt(of_out)
            of_out_bias += float(g * g)
            m.out_bias -= rate * float(g) / of_out_bias**0.5
            for k, w in enumerate(WIDTHS):
                own = gh[k * FILTERS : (k + 1) * FILTERS]
                live = np.flatnonzero(own)
                if not len(live):
                    continue
                of_bias[k] += own * own
                m.bias[k] -= rate * own / np.sqrt(of_bias[k])
                for j in range(w):
                    at = places[k][live] + j
                    gc = own[live] * x[at].T
                    gx = own[live][:, None] * m.conv[k][j][:, live].T / docs[i].shape[1]
                    of_conv[k][j][:, live] += gc * gc
                    m.conv[k][j][:, live] -= rate * gc / np.sqrt(of_conv[k][j][:, live])
                    spots = docs[i][at]
                    for c in range(spots.shape[1]):
                        real = spots[:, c] > 0
                        np.add.at(of_emb, spots[real, c], gx[real] * gx[real])
                        np.subtract.at(m.emb, spots[real, c], rate * gx[real] / np.sqrt(of_emb[spots[real, c]]))
    return m


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = 8) -> dict[str, float]:
    """The threshold of best F1, at least 0.5, for each language; one with fewer than
    ``least`` rows of either label takes that of all languages (key ''), and
    where these are as few the threshold is 0.5."""

    def best(s, y):
        cuts = (np.sort(s)[1:] + np.sort(s)[:-1]) / 2
        cuts = np.unique(np.concatenate([[0.5], cuts[cuts > 0.5]]))
        f1 = [2 * ((s >= c) & (y == 1)).sum() / max(1, (s >= c).sum() + (y == 1).sum()) for c in cuts]
        top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        return float(cuts[top[len(top) // 2]])

    out = {"": best(scores, labels) if min((labels == 1).sum(), (labels == 0).sum()) >= least else 0.5}
    for lang in {x for x in langs if x is not None}:
        at = np.array([x == lang for x in langs])
        if min((labels[at] == 1).sum(), (labels[at] == 0).sum()) >= least:
            out[lang] = best(scores[at], labels[at])
    return out


def is_held_out(doc_id):
    """Column: whether crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int], chars: int) -> DataFrame:
    """``docs`` (doc_id, text and others) with their label y: at most ``limits`` of each
    label and ``chars`` characters together, outside the held-out fifth, those
    of smallest hash; texts that don't fit are passed over. Repeated labels of
    a document count as the highest, of repeated documents the smallest row.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(known, "doc_id")
    chosen = fitting_ids(sized.select(F.col("doc_id").alias("id"), "chars", F.col("y").alias("kind")), limits, chars)
    rest = [c for c in docs.columns if c != "doc_id"]
    named = docs.join(F.broadcast(chosen.withColumnRenamed("id", "doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return named.select("doc_id", "row.*").join(known, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, limits: dict[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of labelled documents, calibrate on a fifth of it.

    Without labelled documents every text has the same score, below one half.
    """
    rows = labelled_sample(docs.select("doc_id", "text", "lang"), labels, "toxic", limits, chars).select("doc_id", "text", "lang", "y").toArrow().sort_by("doc_id")
    texts, langs, y = rows["text"].to_pylist(), rows["lang"].to_pylist(), rows["y"].to_numpy().astype(np.int64)
    part = np.array([crc32(b"part" + str(i).encode()) % 5 == 0 for i in rows["doc_id"].to_pylist()], dtype=bool)
    # A word is a number at once, so that the driver holds each distinct one once.
    known: dict[bytes, int] = {}
    coded = [np.array([known.setdefault(w, len(known)) for w in words(t)], dtype=np.int32) for t, p in zip(texts, part) if not p]
    table_of = np.array([hashes(w) for w in known], dtype=np.int32).reshape(-1, 1 + len(PREFIXES))
    model = train([table_of[ids] for ids in coded], y[~part])
    model.thresholds = calibrate(Scorer(model).scores([t for t, p in zip(texts, part) if p]), y[part], [x for x, p in zip(langs, part) if p])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``score`` double and ``toxic`` boolean (score at or over the language's threshold).

    Null and empty texts are scored as texts without words. A language that
    wasn't calibrated, or null, takes the common threshold. Columns score and
    toxic of ``docs`` are replaced.
    """
    docs = docs.drop("score", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    langs = lang_col in docs.columns

    def run(batches):
        m = sent.value
        scorer = Scorer(m)
        for batch in slices(batches):
            s = scorer.scores(batch.column(text_col).to_pylist())
            cut = [m.thresholds.get(x or "", m.thresholds.get("", 0.5)) for x in (batch.column(lang_col).to_pylist() if langs else [""] * len(s))]
            yield with_columns(batch, ["score", "toxic"], [pa.array(s), pa.array(s >= np.array(cut))])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")
