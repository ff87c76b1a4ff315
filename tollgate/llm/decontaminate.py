"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words are
streamed through it; the state reached after a word tells the longest run
ending there that occurs in some item. Stretches whose neighbouring words
never stand side by side in an item can't hold a match and are skipped.

An automaton takes a bounded number of item words. Items of more words together
are dealt over several, an item longer than that in pieces which share all
windows at their seams; every text meets each automaton, and its hits are
united. So any benchmark is answered exactly.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, slices, table, with_columns

#: Item words of one automaton, about; it is sent to every executor.
PART_WORDS = 250_000

_KEEP = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class ItemAutomaton:
    """Suffix automaton of many word sequences, with what a scan needs of the items.

    Transitions are held as sorted keys (state and word) and their targets, all
    else as arrays too: about 100 bytes an item word.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        self.names = [name for name, _ in items]
        nxt, self.link, self.length = [{}], array("i", [-1]), array("i", [0])
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(nxt, last, c)
        states = sorted(range(1, len(nxt)), key=self.length.__getitem__)
        #: The shortest suffix state of at least a window, for states of a window or more.
        self.top = array("i", bytes(4 * len(nxt)))
        for v in states:
            if self.length[v] >= window:
                self.top[v] = v if self.length[self.link[v]] < window else self.top[self.link[v]]
        holders: dict[int, set[int]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(coded):
            v = 0
            for i, c in enumerate(seq, 1):
                v = nxt[v][c]
                if i >= window:
                    holders.setdefault(self.top[v], set()).add(k)
            if 0 < len(seq) < window:
                ends.setdefault(v, []).append((len(seq), k))
        #: Items that hold the last window of a match in a state, by its top state.
        self.holders = {v: tuple(sorted(ks)) for v, ks in holders.items()}
        #: Short items (words, item) that a match in a state ends with, if it is as long.
        self.short: dict[int, tuple] = {}
        for v in states if ends else ():
            own = (*ends.get(v, ()), *self.short.get(self.link[v], ()))
            if own:
                self.short[v] = own
        self.least = min([min(len(seq), window) for seq in coded if seq], default=0)
        self.size = max(1, len(self.vocab))
        moves = sorted((v * self.size + c, to) for v, out in enumerate(nxt) for c, to in out.items())
        self.keys, self.targets = array("q", [k for k, _ in moves]), array("i", [to for _, to in moves])
        self.pairs = np.array(sorted({a * self.size + b for seq in coded for a, b in zip(seq, seq[1:])}), dtype=np.int64)

    def _extend(self, nxt: list[dict[int, int]], last: int, c: int) -> int:
        link, length = self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(nxt, last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(nxt, p, q, c)
        return cur

    def _clone(self, nxt: list[dict[int, int]], p: int, q: int, c: int) -> int:
        link, length = self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def step(self, v: int, c: int) -> int:
        """The state behind word ``c`` in state ``v``, 0 where there is none."""
        key = v * self.size + c
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else 0

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words that may hold a match, as [start, end)."""
        if self.least == 0 or len(ids) < self.least:
            return []
        known = ids >= 0
        if self.least == 1:
            ok, extra = known, 0
        else:
            ok = known[1:] & known[:-1]
            at = np.flatnonzero(ok)
            keys = ids[at].astype(np.int64) * self.size + ids[at + 1]
            spot = np.searchsorted(self.pairs, keys)
            ok[at] = self.pairs[np.minimum(spot, len(self.pairs) - 1)] == keys if len(self.pairs) else False
            extra = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2] + extra
        long = b - a >= self.least
        return list(zip(a[long].tolist(), b[long].tolist()))

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of words that lie in occurring windows, as [start, end), and the items found."""
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), dtype=np.int32, count=len(ws))
        runs, found, step, link, length, window = [], set(), self.step, self.link, self.length, self.window

        def hit(start, end):
            # Ends grow, starts may fall back behind those of the runs before.
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, end))

        for a, b in self.stretches(ids):
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                to = step(v, c)
                while v and not to:
                    v = link[v]
                    n = length[v]
                    to = step(v, c)
                v, n = to, n + 1 if to else 0
                if n >= window:
                    hit(i - window, i)
                    found.update(self.holders.get(self.top[v], ()))
                for size, k in self.short.get(v, ()):
                    if n >= size:
                        hit(i - size, i)
                        found.add(k)
        return runs, found


def item_parts(benchmark: DataFrame, window: int, part_words: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The items' pieces (item string, piece string, part int) and the number of parts,
    each of about ``part_words`` words."""
    most = max(part_words, 2 * window)

    def run(batches):
        for batch in slices(batches):
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                for at in range(0, max(1, len(ws) - window + 1), most - window + 1) if ws else ():
                    piece = ws[at : at + most]
                    out.append({"item": name, "piece": b" ".join(piece).decode("utf-8", "surrogatepass"), "n": len(piece)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.string()), ("piece", pa.string()), ("n", pa.int64())]))

    pieces = checkpointed(benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "item string, piece string, n long"))
    parts = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // most))
    return pieces.select("item", "piece", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)).cast("int").alias("part")), parts


def automaton_of(pieces: DataFrame, window: int) -> ItemAutomaton:
    """The automaton of the pieces of one part."""
    rows = pieces.select("item", "piece").collect()
    return ItemAutomaton(sorted(((r[0], r[1].encode("utf-8", "surrogatepass").split(b" ")) for r in rows), key=lambda x: (x[0] or "", x[1])), window)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def as_spans(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in runs]


def part_hits(texts: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """Of ``texts`` (key, text) those that one part hits: key, items, and runs of hit words."""
    auto = texts.sparkSession.sparkContext.broadcast(automaton_of(pieces, window))

    def run(batches):
        a = auto.value
        for batch in slices(batches):
            keys, items, runs = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hit, found = a.scan(words(text))
                if hit:
                    keys.append(key)
                    items.append(sorted({a.names[k] for k in found} - {None}))
                    runs.append(as_spans(hit))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(items, pa.list_(pa.string())), pa.array(runs, _SPANS)], names=["key", "items", "runs"])

    return texts.mapInArrow(run, T.StructType([T.StructField("key", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", SPANS)]))


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with n_words long, n_hit long, item_ids array<string> (sorted) and
    hit_spans array<struct<start,end>>: runs of hit words as code points of the text.

    Null and empty texts have no words. Items without words match nothing; an
    item shorter than the window is one window. Items that share an id count
    once; the words of an item with null id are hit but no id is listed.
    Clashing columns of ``docs`` are replaced. An empty benchmark hits nothing.
    """
    made = ["n_words", "n_hit", "item_ids", "hit_spans"]
    docs = docs.drop(*made)
    pieces, parts = item_parts(benchmark, window, part_words)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPANS)])

    def finished(rest, texts, hits):
        """``rest`` with the columns made of each text's (number of words, items, runs)."""
        n_hit = [sum(b - a for a, b in runs) for _, _, runs in hits]
        spans = [char_spans(t, runs) if runs else [] for t, (_, _, runs) in zip(texts, hits)]
        return with_columns(rest, made, [pa.array([n for n, _, _ in hits], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([i for _, i, _ in hits], pa.list_(pa.string())), pa.array(spans, _SPANS)])

    if parts == 1:
        auto = docs.sparkSession.sparkContext.broadcast(automaton_of(pieces, window))

        def run(batches):
            a = auto.value
            for batch in slices(batches):
                texts, hits = batch.column(text_col).to_pylist(), []
                for t in texts:
                    ws = words(t)
                    runs, found = a.scan(ws)
                    hits.append((len(ws), sorted({a.names[k] for k in found} - {None}), runs))
                yield finished(batch, texts, hits)

        return docs.mapInArrow(run, schema)

    # Hits depend on the text alone, so equal texts share theirs.
    key, found = fresh(docs, "text_key", "text_hits")
    keyed = docs.withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256))
    texts = keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    every = reduce(DataFrame.union, [part_hits(texts, pieces.where(F.col("part") == k), window).withColumn("part", F.lit(k)) for k in range(parts)])
    once = every.groupBy("key", "part").agg(F.first("items").alias("items"), F.first("runs").alias("runs"))
    united = once.groupBy("key").agg(F.struct(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs")).alias(found))
    names = docs.columns
    met = keyed.join(united.withColumnRenamed("key", key), key, "left").select(*names, found)

    def unite(batches):
        for batch in slices(batches):
            texts, hits = batch.column(text_col).to_pylist(), []
            for t, x in zip(texts, batch.column(found).to_pylist()):
                runs = []
                for r in x["runs"] if x else ():
                    if runs and runs[-1][1] >= r["start"]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], r["end"]))
                    else:
                        runs.append((r["start"], r["end"]))
                hits.append((len(words(t)), x["items"] if x else [], runs))
            yield finished(batch.select(names), texts, hits)

    return met.mapInArrow(unite, schema)


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as spans of code points."""
    raw = text.encode("utf-8", "surrogatepass")
    keep = np.frombuffer(raw.translate(_KEEP), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    a, b = lead[edge[::2]], lead[edge[1::2]]
    return as_spans([(int(a[i]), int(b[j - 1])) for i, j in runs])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without what the benchmark holds: hit spans are cut out of the text,
    and documents of which hit words make more than ``max_coverage`` go altogether.

    Other documents stay as they are, null texts included.
    """
    cols = docs.columns
    hit = match_items(docs, benchmark, window)
    spans = F.col("hit_spans")
    before = F.concat(F.array(F.lit(0)), spans["end"])
    after = F.concat(spans["start"], F.array(F.length("text")))
    kept = F.array_join(F.zip_with(before, after, lambda s, e: F.substring(F.col("text"), s + 1, e - s)), "")
    text = F.when(F.size(spans) > 0, kept).otherwise(F.col("text"))
    return hit.where(F.col("n_hit") <= max_coverage * F.col("n_words")).withColumn("text", text).select(*cols)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Of every document: its words, hit words and the items whose windows occur in it."""
    hit = match_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hit.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows of benchmark words looked up among all runs of document words.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, grams.n, i, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
