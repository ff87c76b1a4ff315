"""Exact merge-type piece encoding by backtracking, and decoding.

A vocabulary of merge type encodes a text by joining, again and again, the
best-scored pair of neighbours whose join is a piece (the leftmost of equals).
A sequence of pieces is that encoding exactly if each pair of neighbours is:
if re-merging the two pieces' characters gives the two pieces back. So the
encoder takes the longest piece at each place (found by one Aho-Corasick pass),
falls back to shorter ones where the neighbours aren't compatible, steps back
where none is, and remembers failed positions in a bitfield so that none is
tried twice.

No piece has a space mark behind another character, and a character that is in
no piece never merges; the text is cut at these places and each word is encoded
once per task while it stays in a bounded cache.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, with_columns

MARK = "▁"
#: What normalisers fold, join or trim.
PROBE = "ﬁ Ａ é  x "
#: Words of more characters aren't cached; each of a cache's two generations holds so many words.
CACHE_CHARS, CACHE_WORDS = 40, 300_000
_WARM: dict[tuple, "Encoder"] = {}


def warm_encoder(v: "Vocabulary") -> "Encoder":
    """The encoder of a vocabulary, kept with its cache for later tasks of the same worker."""
    key = (len(v.ids), hash(frozenset(v.ids.items())), hash(frozenset(v.scores.items())), v.end_id)
    if key not in _WARM:
        _WARM.clear()
        _WARM[key] = Encoder(v)
    return _WARM[key]


@dataclass
class Vocabulary:
    """What encoder and decoder need of a model; small enough to be sent to each executor."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    pieces: list[bytes]
    is_byte: list[bool]
    end_id: int


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model of the sentencepiece library that has merge pieces and byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ids, scores, byte_ids, pieces, is_byte = {}, {}, [-1] * 256, [], []
    for i in range(n):
        p = sp.id_to_piece(i)
        is_byte.append(sp.is_byte(i))
        if sp.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            pieces.append(bytes([int(p[1:-1], 16)]))
        elif sp.is_control(i):
            pieces.append(b"")
        elif sp.is_unknown(i):
            pieces.append(" ⁇ ".encode())
        else:
            pieces.append(p.replace(MARK, " ").encode())
            if not sp.is_unused(i):
                ids[p], scores[p] = i, sp.get_score(i)
    # The encoder takes text as it stands behind one space mark; a model that would change it is refused.
    if sp.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
        raise ValueError("the model normalises texts or has no leading space mark")
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte fallback")
    if any(a != MARK and b == MARK for p in ids for a, b in zip(p, p[1:])):
        raise ValueError("a piece has a space mark behind another character; words can't be encoded apart")
    return Vocabulary(ids, scores, byte_ids, pieces, is_byte, sp.eos_id())


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.text_of = {i: p for p, i in v.ids.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.adjacent = {p[k : k + 2] for p in v.ids for k in range(len(p) - 1)}
        chars = {c for p in v.ids for c in p}
        self.merging = {c for c in chars if c in v.ids} | {c for p in v.ids if len(p) > 1 for c in p}
        self.automaton = ahocorasick.Automaton()
        usable = {p: i for p, i in v.ids.items() if self.remerge(p) == [p]}
        for p, i in usable.items():
            self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        #: The next shorter usable piece that a piece begins with.
        self.shorter = {i: next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), -1) for p, i in usable.items()}
        self.usable = usable
        self.size = {i: len(p) for p, i in usable.items()}
        breaks = "" if "\n" in self.merging else "\n"
        # Words keep plain spaces: that makes them smaller and quicker to look up.
        self.split = re.compile(f" *[^ {breaks}]+| +" + ("|\n" if breaks else "")).findall

    def remerge(self, text: str) -> list[str]:
        """The merges themselves, for short texts."""
        parts, scores = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether two pieces can stand side by side."""
        known = self.compatible.get((a, b))
        if known is None:
            p, q = self.text_of[a], self.text_of[b]
            known = self.compatible[a, b] = self.remerge(p + q) == [p, q]
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
        return known

    def _run(self, text: str) -> list[int]:
        """Encode a run of characters that all are pieces."""
        longest = [-1] * len(text)
        for end, (i, back) in self.automaton.iter(text):
            longest[end - back] = i
        out: list[int] = []
        failed = bytearray(len(text) // 8 + 1)
        at, piece, size, shorter, known, last = 0, longest[0], self.size, self.shorter, self.compatible, len(text)
        while True:
            end = at + size[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or (known.get((out[-1], piece)) or self.fits(out[-1], piece))):
                out.append(piece)
                at = end
                if at == last:
                    return out
                piece = longest[at]
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no encoding for {text[:80]!r}")
                piece = out.pop()
                at -= size[piece]

    def word(self, word: str) -> bytes:
        """Ids of a word as int32: cut around characters that are in no piece, and
        before a last character that no piece holds behind the one before it."""
        word = word.replace(" ", MARK)
        if len(word) > 2 and word[-2:] not in self.adjacent:
            return self._cached(word[:-1].replace(MARK, " ")) + self._cached(word[-1])
        whole = self.usable.get(word)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        if self.merging.issuperset(word):
            return array("i", self._run(word)).tobytes()
        out, start = [], 0
        for k, c in enumerate(word):
            if c not in self.merging:
                if start < k:
                    out += self._run(word[start:k])
                out += [self.v.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = k + 1
        if start < len(word):
            out += self._run(word[start:])
        return array("i", out).tobytes()

    def _cached(self, word: str) -> bytes:
        """Ids of a word, from the younger or the older generation of the cache if it has them."""
        ids = self.cache.get(word)
        if ids is None:
            ids = self.older.get(word) or self.word(word)
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.older, self.cache = self.cache, {}
                self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (null: empty) with the end id, as int32."""
        out: list[bytes] = []
        if text:
            ws = self.split(" " + text.replace(MARK, " "))
            out = list(map(self.cache.get, ws))
            at = -1
            while True:
                try:
                    at = out.index(None, at + 1)
                except ValueError:
                    break
                out[at] = self._cached(ws[at])
        out.append(np.int32(self.v.end_id).tobytes())
        return np.frombuffer(b"".join(out), dtype=np.int32)


class Decoder:
    def __init__(self, v: Vocabulary):
        self.pieces, self.is_byte = v.pieces, v.is_byte

    def decode(self, ids) -> str:
        """The text of ids: control ids vanish, one space of the first piece goes,
        and each byte that isn't part of a valid character becomes U+FFFD."""
        pieces = self.pieces
        raw = b"".join([pieces[i] for i in ids])
        first = next((i for i in ids if pieces[i]), None)
        cut = first is not None and not self.is_byte[first] and raw[:1] == b" "
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        return text[1:] if cut else text

    def _repaired(self, ids) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.pieces[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i >= 0:
                out.append(self.pieces[i].decode())
        return "".join(out)


def _encoded(encoder: Encoder, texts: list) -> tuple[list[np.ndarray], pa.Array]:
    ids = [encoder.encode(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` array<int>: the whole text encoded with an end id; with
    ``decode`` also ``decoded``, the ids decoded again in the same pass.

    Null and empty texts give the end id alone; a very long text is one row as
    any other. Columns ids and decoded of ``docs`` are replaced.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 1 + decode]
    names = [f.name for f in made]
    docs = docs.drop(*names)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches):
        encoder, decoder = warm_encoder(vocabulary.value), Decoder(vocabulary.value)
        for batch in slices(batches):
            ids, column = _encoded(encoder, batch.column(text_col).to_pylist())
            yield with_columns(batch, names, [column, pa.array([decoder.decode(x.tolist()) for x in ids], pa.string())][: 1 + decode])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made]))


def decode_ids(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` string, the text of its ids (null ids: empty)."""
    encoded = encoded.drop("decoded")
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches):
        decoder = Decoder(vocabulary.value)
        for batch in slices(batches):
            yield with_columns(batch, ["decoded"], [pa.array([decoder.decode(x or []) for x in batch.column(ids_col).to_pylist()], pa.string())])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    model = default_model()
    out = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decode=True).drop("text")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
