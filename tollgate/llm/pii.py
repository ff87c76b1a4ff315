"""Personal data by patterns and a skip-chain conditional random field.

The patterns give base spans. The field sees the tokens that could be personal
data and their neighbours: a token's own features, links between neighbouring
tokens, and skip links that join all tokens that are equal, hold the same
digits or end in the same seven with one hub, however many they are. A hub
that a base span's token belongs to is known to be of its kind; loopy
sum-product messages carry that to the other occurrences, where the pattern
alone doesn't hold. Runs of tokens that the field labels, at least one with
confidence, and that touch no base span become further spans.

The field is trained by pseudo-likelihood on the base spans and on masked
ones: a token of a base span is shown once more as it would stand in prose,
without the features of its pattern and its context, with its kind where its
hub is known and as nothing where there is no hub. So the node's features can't
explain it and the skip links have to. Tokens that aren't in a base span but
share a hub with one are left out of training, as nothing is known of them.
"""

from __future__ import annotations

import itertools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitting_ids, slices, table, with_columns

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents with base spans, and without, that the field is fitted on, and their
#: characters together, at most; the probability from which a token is labelled,
#: and that from which one is whose hub is known.
SAMPLE_DOCS, SAMPLE_CHARS, CONFIDENCE, REPEATED = 1500, 24_000_000, 0.95, 0.5
#: Log odds of what is known; far over what any number of occurrences can hold against it.
KNOWN = 1e6
#: Messages have settled when none moves by more; rounds after which steps shrink.
SETTLED, SWINGS = 1e-4, 200

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The lookbehind saves trying each digit of a long run; it changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x09-\x0D\x20]+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern's matches, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


# --- the field ------------------------------------------------------------------


@dataclass
class Lattice:
    """Nodes of a document: spans, features, and links (chain first, then skip).

    Features are places in NAMES, those of node i between ``cuts[i]`` and
    ``cuts[i + 1]``. After the spans' nodes come ``hubs`` nodes without
    features, one for each key that repeats; skip links join its occurrences
    with it. ``keyed``: nodes that have a key, repeated or not.
    """

    spans: list[tuple[int, int]]
    features: np.ndarray
    cuts: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    hubs: int
    keyed: np.ndarray


_STRIP = ".,;:!?()[]{}<>\"'|"
NAMES = (
    ["bias", "letters", "at", "plus", "parens", "mail", "ip", "card", "luhn"]
    + [f"d{k}" for k in range(21)]
    + [f"before:{s}" for s in ("none", "word", "num", "plus", "paren", "mail")]
    + [f"after:{s}" for s in ("none", "word", "num", "plus", "paren", "mail")]
)
_PLACE = {n: k for k, n in enumerate(NAMES)}


def shape(token: str) -> str:
    if "@" in token:
        return "mail"
    if token[:1] == "+" and token[1:2].isdigit():
        return "plus"
    if token[:1] == "(" and token[-1:] == ")" and token[1:-1].isdigit():
        return "paren"
    return "num" if _DIGIT.search(token) else "word"


#: What a token shows wherever it stands; the other features tell of patterns and context.
PLAIN = ("bias", "letters", *(f"d{k}" for k in range(21)))
PROSE = ("before:word", "after:word")


def token_features(tokens: list[str], k: int) -> list[int]:
    t = tokens[k]
    core = t.strip(_STRIP)
    digits = _NOT_DIGIT.sub("", t)
    on = ["bias", f"d{min(20, len(digits))}", "before:" + (shape(tokens[k - 1]) if k else "none"), "after:" + (shape(tokens[k + 1]) if k + 1 < len(tokens) else "none")]
    for name, yes in (("letters", any(c.isalpha() for c in t)), ("at", "@" in t), ("plus", t[:1] == "+"), ("parens", t[:1] == "(" and t[-1:] == ")"), ("mail", bool(emails(core))), ("ip", bool(_IP.fullmatch(core)) and all(map(small, core.split(".")))), ("card", 14 <= len(digits) <= 19), ("luhn", 14 <= len(digits) <= 19 and luhn(digits))):
        if yes:
            on.append(name)
    return [_PLACE[n] for n in on]


def keys_of(token: str) -> set[tuple[str, str]]:
    """By which a token is the same as, or similar to, another."""
    core, digits = token.strip(_STRIP).lower(), _NOT_DIGIT.sub("", token)
    out = {("text", core)} if len(core) >= 6 else set()
    if len(digits) >= 6:
        out.add(("digits", digits))
    if len(digits) >= 7:
        out.add(("end", digits[-7:]))
    return out


def lattice(text: str) -> Lattice | None:
    """Nodes are tokens with a digit or @, and their neighbours; None without any."""
    if "@" not in text and not _DIGIT.search(text):
        return None
    spans = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in spans]
    hot = [k for k, t in enumerate(tokens) if "@" in t or _DIGIT.search(t)]
    nodes = sorted({j for k in hot for j in (k - 1, k, k + 1) if 0 <= j < len(tokens)})
    place = {k: i for i, k in enumerate(nodes)}
    chain = [(i, i + 1) for i, k in enumerate(nodes[:-1]) if nodes[i + 1] == k + 1]
    seen: dict[tuple[str, str], array] = {}
    keyed = []
    for k in hot:
        keys = keys_of(tokens[k])
        if keys:
            keyed.append(place[k])
        for key in keys:
            seen.setdefault(key, array("q")).append(place[k])
    # Keys that the same tokens share have one hub.
    repeats = sorted({at.tobytes() for at in seen.values() if len(at) > 1})
    skip = [np.column_stack([at := np.frombuffer(raw, dtype=np.int64), np.full(len(at), len(nodes) + h)]) for h, raw in enumerate(repeats)]
    features, cuts = array("i"), array("q", [0])
    for k in nodes:
        features.extend(token_features(tokens, k))
        cuts.append(len(features))
    return Lattice([spans[k] for k in nodes], np.array(features, dtype=np.int64), np.array(cuts), np.array(chain, dtype=np.int64).reshape(-1, 2), np.concatenate([np.zeros((0, 2), dtype=np.int64), *skip]), len(repeats), np.array(keyed, dtype=np.int64))


def gold(lat: Lattice, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels from base spans: a token that one overlaps takes its kind (the first of several)."""
    out, at = np.zeros(len(lat.spans), dtype=np.int64), 0
    for i, (a, b) in enumerate(lat.spans):
        while at < len(base) and base[at][2] <= a:
            at += 1
        if at < len(base) and base[at][0] < b:
            out[i] = base[at][1] + 1
    return out


def hub_labels(lat: Lattice, labels: np.ndarray) -> np.ndarray:
    """Of each hub the kind that most of its occurrences with a kind have; 0 where none has one."""
    votes = np.zeros((lat.hubs, 5))
    np.add.at(votes, (lat.skip[:, 1] - len(lat.spans), labels[lat.skip[:, 0]]), 1.0)
    return np.where(votes[:, 1:].any(axis=1), votes[:, 1:].argmax(axis=1) + 1, 0)


@dataclass
class Field:
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, lat: Lattice, known: np.ndarray | None = None) -> np.ndarray:
        """``known``: labels by base spans, 0 where there is none."""
        out = np.zeros((len(lat.spans) + lat.hubs, 5))
        at = np.repeat(np.arange(len(lat.spans)), np.diff(lat.cuts))
        for c in range(5):
            out[: len(lat.spans), c] = np.bincount(at, self.node[lat.features, c], len(lat.spans))
        if known is not None:
            of_hub = hub_labels(lat, known)
            every = np.concatenate([known, of_hub])
            told = np.flatnonzero(every)
            out[told, every[told]] += KNOWN
        return out

    def marginals(self, lat: Lattice, known: np.ndarray | None = None) -> np.ndarray:
        """Beliefs of the spans' nodes once damped messages over all links have settled.

        Where they don't settle by themselves they are damped further, by steps
        that shrink until no message moves. A directed link holds five numbers.
        """
        u = self.unary(lat, known)
        links = np.concatenate([lat.chain, lat.skip])
        n = len(lat.chain)
        ahead = [np.exp(self.chain), np.exp(self.skip)]
        m = np.zeros((2, len(links), 5))
        step = 0.5
        for k in itertools.count(1):
            total = self._gathered(u, links, m)
            moved = 0.0
            new = np.empty_like(m)
            for way in range(2):
                # What the sender believes without what the receiver told it.
                x = total[links[:, way]] - m[1 - way]
                x = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
                for part, pot in ((slice(0, n), ahead[0]), (slice(n, None), ahead[1])):
                    new[way, part] = x[part] @ (pot.T if way else pot)
            np.log(np.maximum(new, 1e-300, out=new), out=new)
            new -= new.max(axis=2, keepdims=True, initial=-np.inf)
            new -= m
            new *= step
            m += new
            moved = np.abs(new).max(initial=0.0)
            if moved < SETTLED:
                break
            step *= 0.9 if k > SWINGS else 1.0
        total = self._gathered(u, links, m)
        e = np.exp(total - total.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True))[: len(lat.spans)]

    @staticmethod
    def _gathered(u: np.ndarray, links: np.ndarray, m: np.ndarray) -> np.ndarray:
        """``m[0]`` goes from a link's first node to its second, ``m[1]`` back."""
        out = u.copy()
        for c in range(5):
            for way in range(2):
                out[:, c] += np.bincount(links[:, 1 - way], m[way, :, c], len(u))
        return out


def terms(lat: Lattice, labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """What one document gives to training: rows of (label, weight), each row's
    features, and for each kind of link (row, the label beside it, side)."""
    n, hubs = len(lat.spans), hub_labels(lat, labels)
    y = np.concatenate([labels, hubs])
    weight = np.ones(len(y))
    # Nothing is known of a token outside base spans whose hub is of a kind; it is taken to be of that kind by its neighbours.
    open_ = lat.skip[(hubs[lat.skip[:, 1] - n] > 0) & (labels[lat.skip[:, 0]] == 0)]
    weight[open_[:, 0]] = 0
    y[open_[:, 0]] = hubs[open_[:, 1] - n]
    row = np.repeat(np.arange(n), np.diff(lat.cuts))
    beside = [np.concatenate([np.column_stack([x[:, 1], y[x[:, 0]], np.zeros(len(x), int)]), np.column_stack([x[:, 0], y[x[:, 1]], np.ones(len(x), int)])]).astype(np.int64) for x in (lat.chain, lat.skip)]
    # Masked: the same token in prose, of its kind beside its hub, of none without one.
    told = lat.keyed[labels[lat.keyed] > 0]
    first, k = len(y), len(told)
    y, weight = np.concatenate([y, labels[told], np.zeros(k, dtype=np.int64)]), np.concatenate([weight, np.ones(2 * k)])
    plain = np.array([_PLACE[x] for x in PLAIN])
    own = [np.concatenate([f[np.isin(f, plain)], [_PLACE[x] for x in PROSE]]) for i in told for f in [lat.features[lat.cuts[i] : lat.cuts[i + 1]]]]
    masked = np.concatenate([np.zeros(0, dtype=np.int64), *own, *own]).astype(np.int64)
    features = np.concatenate([lat.features, masked])
    row = np.concatenate([row, np.repeat(np.arange(first, first + 2 * k), [len(f) for f in own + own])])
    both = np.arange(first, first + 2 * k)
    beside[0] = np.concatenate([beside[0], *(np.column_stack([both, np.zeros(2 * k, int), np.full(2 * k, side)]) for side in (0, 1))])
    beside[1] = np.concatenate([beside[1], np.column_stack([both[:k], labels[told], np.ones(k, int)])])
    return y, weight, row, features, *beside


def train(lattices: list[Lattice], labels: list[np.ndarray], steps: int = 200, rate: float = 0.5, decay: float = 0.05) -> Field:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels."""
    field = Field(np.zeros((len(NAMES), 5)), np.zeros((5, 5)), np.zeros((5, 5)))
    if not lattices:
        field.node[_PLACE["bias"], 0] = 10.0
        return field
    parts = [terms(x, own) for x, own in zip(lattices, labels)]
    starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    y, weight = (np.concatenate([p[k] for p in parts]) for k in range(2))
    at, col = np.concatenate([p[2] + s for p, s in zip(parts, starts)]), np.concatenate([p[3] for p in parts])
    links = [np.concatenate([p[k] + [s, 0, 0] for p, s in zip(parts, starts)]) for k in (4, 5)]
    one, n = np.eye(5), len(y)
    sums = [np.full(w.shape, 1e-6) for w in (field.node, field.chain, field.skip)]
    for _ in range(steps):
        z = np.zeros((n, 5))
        np.add.at(z, at, field.node[col])
        for (r, label, side), w in zip((x.T for x in links), (field.chain, field.skip)):
            np.add.at(z, r, np.where(side[:, None] == 0, w[label], w.T[label]))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - one[y]) * weight[:, None]
        grads = [np.zeros_like(field.node), np.zeros((5, 5)), np.zeros((5, 5))]
        np.add.at(grads[0], col, d[at])
        for g, (r, label, side) in zip(grads[1:], (x.T for x in links)):
            g += one[label[side == 0]].T @ d[r[side == 0]] + (one[label[side == 1]].T @ d[r[side == 1]]).T
        for w, g, s in zip((field.node, field.chain, field.skip), grads, sums):
            g = g + decay * w
            s += g * g
            w -= rate * g / np.sqrt(s)
    field.skip = (field.skip + field.skip.T) / 2
    return field


def all_spans(text: str, base: list[tuple[int, int, int]], field: Field, confidence: float = CONFIDENCE, repeated: float = REPEATED) -> list[tuple[int, int, int]]:
    """Base spans and those the field adds, sorted."""
    lat = lattice(text)
    if lat is None:
        return base
    known = gold(lat, base)
    belief = field.marginals(lat, known)
    told = np.zeros(len(lat.spans), dtype=bool)
    told[lat.skip[hub_labels(lat, known)[lat.skip[:, 1] - len(lat.spans)] > 0, 0]] = True
    label, sure = belief.argmax(axis=1), belief.max(axis=1) >= np.where(told, repeated, confidence)
    taken, at, added, i = sorted((s, e) for s, _, e in base), 0, [], 0
    while i < len(label):
        j = i + 1
        if label[i]:
            while j < len(label) and label[j] == label[i] and label[i] == 4 and text[lat.spans[j - 1][1] : lat.spans[j][0]] == " ":
                j += 1
            a, b = lat.spans[i][0], lat.spans[j - 1][1]
            edge = _STRIP if label[i] < 4 else ".,;:!?\"'|"
            while a < b and text[a] in edge:
                a += 1
            while a < b and text[b - 1] in edge:
                b -= 1
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if a < b and sure[i:j].any() and not (at < len(taken) and taken[at][0] < b):
                added.append((a, int(label[i]) - 1, b))
        i = j
    return sorted(base + added)


# --- Spark ------------------------------------------------------------------------


def fit(docs: DataFrame, limit: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most ``limit`` documents with base spans and as many with digits and
    without base spans, of smallest hash and of ``chars`` characters together
    (texts that don't fit are passed over). Of repeated ids the smallest text
    counts. Without any document the field labels nothing.
    """
    near = F.col(text_col).rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]|\+[0-9]|[0-9](?:[ -]?[0-9]){13}")
    keys = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("chars"), F.when(near, 1).when(F.col(text_col).rlike("[0-9]"), 0).alias("kind")).where("id is not null and kind is not null")
    chosen = fitting_ids(keys, {0: limit, 1: limit}, chars)
    texts = [r["text"] for r in docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()]
    pairs = [(lat, gold(lat, base_spans(t))) for t in texts if (lat := lattice(t))]
    return train([p[0] for p in pairs], [p[1] for p in pairs])


def find_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<start,end,kind,base>> by start, then kind; ends
    are exclusive, in code points.

    Null and empty texts have none. A column pii is replaced.
    """
    docs = docs.drop("pii")
    sent = docs.sparkSession.sparkContext.broadcast(field)
    one = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())])))])

    def spans(text):
        if not text:
            return []
        base = base_spans(text)
        known = set(base)
        return [{"start": s, "end": e, "kind": KINDS[k], "base": (s, k, e) in known} for s, k, e in all_spans(text, base, sent.value)]

    def run(batches):
        for batch in slices(batches):
            yield with_columns(batch, ["pii"], [pa.array([spans(t) for t in batch.column(text_col).to_pylist()], pa.list_(pa.struct(one)))])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the first one's kind. Other
    texts stay as they are, nulls included.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)

    def masked(text):
        if not text:
            return text
        out, done, end = [], 0, 0
        for s, k, e in all_spans(text, base_spans(text), sent.value):
            if s < end:
                end = max(end, e)
            else:
                out += [text[max(done, end) : s], f"[{KINDS[k].upper()}]"]
                end = e
            done = end
        return "".join(out) + text[done:] if out else text

    def run(batches):
        for batch in slices(batches):
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_pii(docs, fit(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
