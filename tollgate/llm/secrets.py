"""Secret scanning behind a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
what any text that matches must hold. The index has a posting (trigram,
document) for each trigram that some query names. Postings are brought
together by document and the queries are evaluated on them; the candidates are
then verified with the regular expression itself. A rule from which no
mandatory trigram follows is verified on every document.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table

#: Candidates that are few enough to be sent to all executors; more meet their texts in a shuffle.
FEW = 500_000
#: Matches of a text whose places are worked out together.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """``min_length`` holds for the given ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


def any_case(word: str) -> str:
    """``word`` in either case, spelt out so that no engine folds other letters to it."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# --- Boolean queries: True (nothing is mandatory), a trigram, ("and" | "or", queries) ---


def _both(op: str, qs: list):
    if op == "and":
        qs = [q for q in qs if q is not True]
        if not qs:
            return True
    elif any(q is True for q in qs):
        return True
    qs = list(dict.fromkeys(qs))
    if op == "or":  # a part that asks for more than another adds nothing
        asks = [frozenset([q]) if isinstance(q, str) else frozenset(q[1]) if q[0] == "and" else None for q in qs]
        qs = [q for q, a in zip(qs, asks) if a is None or not any(b is not None and b < a for b in asks)]
    return qs[0] if len(qs) == 1 else (op, tuple(qs))


def _of_strings(strings) -> object:
    """What a text that holds one of the strings must hold."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(node) -> tuple[frozenset | None, object]:
    """The strings a node stands for, in lower case (None: too many), and its query."""
    op, arg = node
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), True
    if op is C.AT:
        return frozenset([""]), True
    if op is C.IN:
        chars = set()
        for o, a in arg:
            if o is C.LITERAL:
                chars.add(chr(a).lower())
            elif o is C.RANGE and a[1] - a[0] < 4:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= 6 else (None, True)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return frozenset().union(*(s for s, _ in parts)), True
        return None, _both("or", [q if s is None else _of_strings(s) for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if low == 0:
            return (strings | {""}, True) if high == 1 and strings is not None else (None, True)
        if strings is not None and low == high == 1:
            return strings, True
        return None, query if strings is None else _of_strings({s * low for s in strings})
    return None, True


def _sequence(nodes) -> tuple[frozenset | None, object]:
    now, query, exact = frozenset([""]), [], True
    for node in nodes:
        strings, q = _walk(node)
        if strings is not None and len(now) * len(strings) <= 64:
            now = frozenset(a + b for a in now for b in strings)
            continue
        exact = False
        query += [_of_strings(now), q if strings is None else _of_strings(strings)]
        now = frozenset([""])
    return (now, True) if exact else (None, _both("and", [*query, _of_strings(now)]))


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; True where none follows."""
    strings, query = _sequence(P.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query, bit: dict[str, int]) -> Column:
    if isinstance(query, str):
        return F.col(f"mask{bit[query] // 63}").bitwiseAND(F.lit(1 << bit[query] % 63).cast("long")) != 0
    parts = [_holds(q, bit) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# --- index, candidates, verification -------------------------------------------

SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def trigram_index(docs: DataFrame, trigrams: list[str], key: str, text: Column) -> DataFrame:
    """Postings (trigram, key) of lower-cased texts."""
    # Bound to a variable, the lower-cased text is made once and not for each trigram.
    there = F.transform(F.array(F.lower(text)), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))[0]
    return docs.select(F.explode(there).alias("trigram"), F.col(key))


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str, may: str = "may") -> DataFrame:
    """A row for each key that satisfies a query, with a struct ``may`` that has a Boolean for each such rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    trigrams = sorted(set().union(*map(_trigrams, queries.values())))
    bit = {t: k for k, t in enumerate(trigrams)}

    def as_mask(k: int) -> Column:
        """A posting becomes a bit; a document's postings meet in partial aggregates."""
        own = [x for t in trigrams if bit[t] // 63 == k for x in (F.lit(t), F.lit(1 << bit[t] % 63).cast("long"))]
        return F.coalesce(F.bit_or(F.create_map(*own)[F.col("trigram")]), F.lit(0)).alias(f"mask{k}")

    met = index.groupBy(key).agg(*map(as_mask, range(-(-len(trigrams) // 63))))
    held = {k: _holds(q, bit) for k, q in queries.items()}
    some = reduce(lambda x, y: x | y, held.values())
    return met.where(some).select(key, F.struct(*(h.alias(k) for k, h in held.items())).alias(may))


def _found(rule: Rule, order: int, text: Column) -> Column:
    """Verified spans of one rule: array of struct<start,ord,kind,end>, in code points."""
    p = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("part"))
    none = F.array().cast(SPANS)
    shifted = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))).cast(SPANS)
        grown = F.when(x["hit"].isNotNull() & (F.length(x["part"]) >= rule.min_length), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), grown.alias("out"))

    def placed(all_pairs):
        """Each run's spans from its own beginning, then the runs one behind another: an array that grows is copied
        with every element, and both kinds stay short."""
        at = F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / RUN).cast("int"))
        runs = F.transform(at, lambda k: F.aggregate(F.slice(all_pairs, k * RUN + 1, RUN), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
        return F.flatten(F.aggregate(runs, begin, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(r["out"], acc["at"]))).alias("out")), lambda acc: acc["out"]))

    # Bound to a variable, the matches are found once and not for each run.
    return F.transform(F.array(pairs), placed)[0]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start,ord,kind,end>> by start, then rule.

    Null and empty texts have none. A key is made of id and text, so repeated
    rows share postings and each keeps its row. A column secrets is replaced.
    Flags of candidates are sent to the texts where they are few, by count;
    where they aren't, both are shuffled by key.
    """
    docs = docs.drop("secrets")
    cols = docs.columns
    key, may = fresh(docs, "scan_key", "may")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("string"), text))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted(set().union(*map(_trigrams, queries.values())))
    if trigrams:
        flags = checkpointed(candidates(trigram_index(docs, trigrams, key, text), rules, key, may))
        docs = docs.join(F.broadcast(flags) if flags.count() <= FEW else flags.hint("shuffle_hash"), key, "left")
    none = F.array().cast(SPANS)
    found = [F.when(F.rlike(text, F.lit(r.pattern)) if queries[r.kind] is True else F.col(may)[r.kind], _found(r, k, text)).otherwise(none) for k, r in enumerate(rules)]
    return docs.select(*cols, F.array_sort(F.concat(*found)).alias("secrets"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))
    return out.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _sql() -> str:
    def spans(order: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT r, {order} AS ord, '{r.kind}' AS kind, len(array_to_string(g[1:i], '')) + len(array_to_string(h[1:i - 1], '')) AS s, len(h[i]) AS n
          FROM (SELECT r, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS h, regexp_extract_all(text, '{p}', {r.group}) AS q, unnest(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1)) AS i FROM d)
          WHERE len(q[i]) >= {r.min_length}"""

    union = "\nUNION ALL\n".join(spans(k, r) for k, r in enumerate(RULES))
    say = "kind || ':' || s || ':' || (s + n)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
s AS ({union}),
a AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in BASE)},
  string_agg({say}, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base, string_agg({say}, ',' ORDER BY s, ord) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


OP6_SQL = _sql()
