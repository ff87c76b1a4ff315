"""SimHash near-duplicates by the generalised pigeonhole principle.

The fingerprint's bits are grouped into partitions, correlated bits together.
If thresholds t_1..t_m (each at least -1) add up to tau - m + 1, two
fingerprints that differ in tau bits or fewer differ in t_i or fewer in some
partition i. Each fingerprint gets thresholds of its own: a dynamic programme
picks those with the least probes and candidates, as estimated from how many
fingerprints hold its value in each partition and from the bits' frequencies.
It then probes, in each partition, every value within t_i of its own.

Another allocation is weighed against these: a single partition of all 64
bits, whose threshold is then tau itself (tau - m + 1 for m = 1). Its probes,
the codes within two bits, needn't be listed by one side: a code is within two
bits of another exactly if some code is within one bit of both, so either side
lists the 65 codes within one bit of its own. Its cost doesn't depend on how
many fingerprints crowd around a value, and it is taken where the partitions'
estimated probes and candidates come to more. A pair is found by the probes of
either side, or by these codes where both sides take them: no link is lost.

The near-copy stage of the pipeline takes its links of up to ``NEAR`` of 128 bits
from the same partitions and thresholds, and only what lies beyond from shingles.

Rows are gathered by key and verified within the task; a group yields links
that span its components, never all its pairs.
"""

from __future__ import annotations

import itertools
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array_sums, checkpointed, fresh, slices, stored, table, with_columns
from .components import components

SEED = 42
#: Estimated probes and candidates beyond which the single partition is cheaper: its
#: 65 codes stand on both sides, and a row that is sent costs about twice a candidate.
CROWD = 256
#: Codes of one value that meet in one group, at most.
HELD = 1 << 16
#: Groups of up to so many members are compared pair by pair, all groups of a batch at once.
FEW = 16


# --- fingerprints -----------------------------------------------------------


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words (A-Z lower-cased, split at ASCII white space); a
    shorter text is one shingle, one without words has none."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return []
    return [b" ".join(t) for t in zip(*(w[i:] for i in range(words)))] or [b" ".join(w)]


def fingerprint(grams: list[bytes], bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half of the shingles' hashes; big-endian."""
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=np.uint8)
    ones, step = np.zeros(bits, dtype=np.int64), bits // 8 * 4096
    for at in range(0, len(raw), step):
        ones += np.unpackbits(raw[at : at + step]).reshape(-1, bits).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with fp0 long (and fp1 where ``bits`` is 128).

    Null and empty texts have the fingerprint zero.
    """
    names = ["fp0", "fp1"][: bits // 64]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        for batch in slices(batches):
            raw = b"".join([fingerprint(shingles(t, words), bits) for t in batch.column(text_col).to_pylist()])
            codes = np.frombuffer(raw, dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, bits // 64)
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[c for i, c in enumerate(batch.schema.names) if i != at])
            yield with_columns(rest, names, [pa.array(codes[:, k], pa.int64()) for k in range(bits // 64)])

    return docs.mapInArrow(run, schema)


# --- partitions and thresholds ----------------------------------------------


def bit_moments(codes: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """The number of codes in fp0 (and fp1), and how often each two bits are set together."""
    bits = 64 * words
    cols = [f"c{j}" for j in range(bits)]

    def run(batches):
        total, n = np.zeros((bits, bits), dtype=np.int64), 0
        for batch in batches:
            x = unpack(codes_of(batch, words)).astype(np.float32)
            total += np.rint(x.T @ x).astype(np.int64)
            n += len(x)
        rows = np.vstack([total, np.full((1, bits), n)])
        yield pa.RecordBatch.from_arrays([pa.array(range(bits + 1), pa.int32()), *(pa.array(rows[:, j], pa.int64()) for j in range(bits))], names=["i", *cols])

    part = codes.select(*["fp0", "fp1"][:words]).mapInArrow(run, "i int, " + ", ".join(f"{c} long" for c in cols))
    rows = {r["i"]: [r[c] for c in cols] for r in part.groupBy("i").agg(*(F.sum(c).alias(c) for c in cols)).collect()}
    if not rows:
        return 0, np.zeros((bits, bits))
    return rows[bits][0], np.array([rows[i] for i in range(bits)], dtype=np.float64)


def codes_of(batch: pa.RecordBatch, words: int) -> np.ndarray:
    """Rows of fp0 (and fp1)."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ["fp0", "fp1"][:words]])


def unpack(codes: np.ndarray) -> np.ndarray:
    """The bits of each row of longs, the highest first."""
    return np.unpackbits(np.ascontiguousarray(codes).astype(">i8").view(np.uint8).reshape(len(codes), 8 * (codes.size // max(len(codes), 1))), axis=1)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, grown greedily by correlation."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    bits = len(together)
    left, out = set(range(bits)), []
    for k in range(parts):
        size = bits // parts + (k < bits % parts)
        seed = max(left, key=lambda i: (sum(corr[i, j] for j in left if j != i), -i))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(left, key=lambda i: (sum(corr[i, j] for j in group), -i))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def part_value(bits: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(bits), dtype=np.int64)
    for b in group:
        out = out << 1 | bits[:, b]
    return out


def flips(width: int, radius: int) -> np.ndarray:
    """Masks of exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)], dtype=np.int64)


def choose_thresholds(cost: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least summed cost for each row, and that cost.

    ``cost[row, part, t + 1]``: of threshold t in a partition; -1 costs nothing.
    """
    n, m, top = cost.shape
    best = np.zeros((n, 1))
    low, picks = 0, []
    for i in range(m):
        new = np.full((n, best.shape[1] + top - 1), np.inf)
        pick = np.zeros(new.shape, dtype=np.int8)
        for t in range(top):
            cand = best + cost[:, i, t : t + 1]
            view, old = new[:, t : t + best.shape[1]], pick[:, t : t + best.shape[1]]
            old[cand < view] = t
            np.minimum(view, cand, out=view)
        best, low = new, low - 1
        picks.append(pick)
    at = np.full(n, tau - m + 1 - low)
    total = best[np.arange(n), at]
    out = np.zeros((n, m), dtype=np.int8)
    for i in range(m - 1, -1, -1):
        t = picks[i][np.arange(n), at]
        out[:, i] = t - 1
        at = at - t
    return out, total


# --- verification -----------------------------------------------------------


def spanning_links(codes: np.ndarray, is_probe: np.ndarray, is_index: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that connect what pairs (probe, index) within ``limit`` bits connect.

    A search by breadth that begins at probes: what is found leaves the rest at
    once, so a crowd around few members is gone after few comparisons. A row
    that is only in the index meets the probes left and no other row, so the
    work is bounded by probes times rows.
    """
    links = []
    asking, stored_ = np.flatnonzero(is_probe), np.flatnonzero(is_index & ~is_probe)
    while len(asking):
        front, asking = [int(asking[0])], asking[1:]
        while front and (len(asking) or len(stored_)):
            x = front.pop()
            near = np.bitwise_count(codes[asking] ^ codes[x]).sum(axis=1, dtype=np.int64) <= limit
            if not is_index[x]:
                near &= is_index[asking]
            found, asking = asking[near], asking[~near]
            if is_probe[x]:
                near = np.bitwise_count(codes[stored_] ^ codes[x]).sum(axis=1, dtype=np.int64) <= limit
                found, stored_ = np.concatenate([found, stored_[near]]), stored_[~near]
            links += [(x, int(y)) for y in found]
            front += found.tolist()
    return links


def link_groups(rows: DataFrame, words: int, limit: int, above: int = -1) -> DataFrame:
    """Links (a, b) between codes of rows that share (part, value, salt).

    ``rows``: part int, value long, salt int, role int (1: probe, 2: index, 3:
    both), fp0 (and fp1); only rows of one salt meet. In part -1 all members of a group are linked without a check.
    Links of ``above`` bits or fewer are followed but not put out: whoever asks for
    that has them from elsewhere.
    """
    names = ["fp0", "fp1"][:words]
    rows = rows.select("part", "value", "salt", "role", *names).repartition("part", "value", "salt").sortWithinPartitions("part", "value", "salt", *names, "role")
    out_names = [f"{s}{k}" for s in "ab" for k in range(words)]

    def groups(batches):
        held = None
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4 + words)])
            x = x if held is None else np.concatenate([held, x])
            x = x[np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])[: len(x)]]
            cut = np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(axis=1)) + 1
            if len(cut):
                yield x[: cut[-1]], np.concatenate([[0], cut])
                x = x[cut[-1] :]
            held = x
        if held is not None and len(held):
            yield held, np.array([0, len(held)])

    def run(batches):
        for x, cuts in groups(batches):
            size = np.diff(cuts)
            group = np.repeat(np.arange(len(size)), size)
            small, free = size[group] <= FEW, x[:, 0] == -1
            head = cuts[:-1][group]
            at = np.flatnonzero(free & (head != np.arange(len(x))))
            found = [np.column_stack([head[at], at])]
            codes, role = np.ascontiguousarray(x[:, 4:]).view(np.uint64), x[:, 3]
            for step in range(1, min(FEW, int(size.max()))):
                i = np.flatnonzero((group[step:] == group[:-step]) & small[step:] & ~free[step:])
                j = i + step
                ok = ((role[i] & 1) & (role[j] >> 1)) | ((role[j] & 1) & (role[i] >> 1))
                i, j = i[ok > 0], j[ok > 0]
                near = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1, dtype=np.int64) <= limit
                found.append(np.column_stack([i[near], j[near]]))
            for k in np.flatnonzero(size > FEW):
                s, n = cuts[k], size[k]
                if not free[s]:
                    links = spanning_links(codes[s : s + n], (role[s : s + n] & 1) > 0, (role[s : s + n] & 2) > 0, limit)
                    found.append(np.array(links, dtype=np.int64).reshape(-1, 2) + s)
            a, b = np.concatenate(found).astype(np.int64).T
            pairs = np.concatenate([x[a, 4:], x[b, 4:]], axis=1)
            pairs = np.unique(pairs[np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1, dtype=np.int64) > max(above, 0)], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in range(2 * words)], names=out_names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in out_names))


# --- exact links within tau bits ----------------------------------------------


def pigeonhole_links(codes: DataFrame, tau: int = 2, words: int = 1) -> DataFrame:
    """Links (a0, b0; with two ``words`` a0, a1, b0, b1) that connect all distinct codes in
    ``codes.fp0`` (and fp1) within ``tau`` bits. The single partition is made for 2
    bits of 64; other codes always take the partitions."""
    names = ["fp0", "fp1"][:words]
    codes = codes.select(*names).where("fp0 is not null").distinct()
    n, together = bit_moments(codes, words)
    single = (tau, words) == (2, 1)
    parts = (3 if n < 1 << 24 else 2) if single else max(-(-(tau + 1) // 3), 4 * words if n < 1 << 24 else 3 * words)
    groups = group_bits(n, together, parts)
    freq = np.clip(np.diag(together) / max(n, 1), 1e-6, 1 - 1e-6)
    kind = "part int, value long, " + ", ".join(f"{c} long" for c in names)

    def out(part, value, fp):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(value, pa.int64()), *(pa.array(fp[:, k], pa.int64()) for k in range(words))], names=["part", "value", *names])

    def values(batches):
        for batch in batches:
            c = codes_of(batch, words)
            bits = unpack(c)
            yield out(np.repeat(np.arange(parts), len(c)), np.concatenate([part_value(bits, g) for g in groups]), np.tile(c, (parts, 1)))

    index = checkpointed(codes.mapInArrow(values, kind))
    held = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("held"))
    counted = index.join(held, ["part", "value"]).groupBy(*names).agg(*(F.max(F.when(F.col("part") == k, F.col("held"))).alias(f"h{k}") for k in range(parts)))
    top = min(tau, 2)  # no partition is probed further; the others then take the rest

    def probes(batches):
        for batch in batches:
            c = codes_of(batch, words)
            bits = unpack(c)
            cost = np.zeros((len(c), parts, top + 2))
            for k, g in enumerate(groups):
                h = batch.column(f"h{k}").to_numpy(zero_copy_only=False).astype(np.float64)
                p = freq[g]
                odds = np.where(bits[:, g] == 1, (1 - p) / p, p / (1 - p))
                one, two = odds.sum(axis=1), ((odds.sum(axis=1)) ** 2 - (odds**2).sum(axis=1)) / 2
                w = len(g)
                cost[:, k, 1] = 1 + h
                if top >= 1:
                    cost[:, k, 2] = 1 + w + h * (1 + one)
                if top >= 2:
                    cost[:, k, 3] = 1 + w + w * (w - 1) / 2 + h * (1 + one + two)
            limits, total = choose_thresholds(cost, tau)
            crowded = (total > CROWD) & single  # the single partition, part -1
            for k, g in enumerate(groups):
                mine = part_value(bits, g)
                for t in range(top + 1):
                    who = np.flatnonzero((limits[:, k] >= t) & ~crowded)
                    if len(who):
                        masks = flips(len(g), t)
                        yield out(np.full(len(who) * len(masks), k), (mine[who][:, None] ^ masks[None, :]).ravel(), np.repeat(c[who], len(masks), axis=0))
            who = np.flatnonzero(crowded)
            if len(who):
                masks = np.concatenate([[0], (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)])
                yield out(np.full(len(who) * len(masks), -1), (c[who] ^ masks[None, :]).ravel(), np.repeat(c[who], len(masks), axis=0))

    asked = counted.mapInArrow(probes, kind).withColumn("role", F.lit(1)).hint("merge")
    # A value that more than HELD codes share is dealt over salts; probes of it go to each salt.
    hot = held.where(F.col("held") > HELD).select("part", "value", F.ceil(F.col("held") / HELD).cast("int").alias("salts"))
    stored_rows = index.join(hot, ["part", "value"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*names), F.col("salts")).cast("int"), F.lit(0)))
    sent_rows = asked.join(hot, ["part", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
    return link_groups(stored_rows.withColumn("role", F.lit(2)).drop("salts").unionByName(sent_rows.drop("salts")), words, tau)


def near_duplicate_components(docs: DataFrame, words: int = 3, tau: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with fp0 long and component_id: the smallest id
    among documents reachable over links of at most ``tau`` differing bits.

    Equal fingerprints are one class; a class is linked once however many
    documents it has. Documents without words share the fingerprint zero. Null
    ids are passed over unless a component has no other.
    """
    marked = checkpointed(fingerprints(docs.drop("component_id"), words, 64, text_col))
    classes = checkpointed(marked.groupBy("fp0").agg(F.min(id_col).alias("least_id")))
    roots = components(pigeonhole_links(classes, tau), "a0", "b0")
    rooted = classes.join(roots, classes["fp0"] == roots["node"], "left").select("fp0", "least_id", F.coalesce("root", "fp0").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp0", "component_id"), "fp0").select(*marked.columns, "component_id")


# --- near copies at a similarity ----------------------------------------------

#: Buckets of the sketch that counts shingles.
SKETCH = 1 << 20
#: Sets of one coarse component that are compared in one group, at most.
BLOCK = 1 << 12
#: Bits of 128 up to which the pigeonhole principle links codes; shingles link what lies beyond.
NEAR = 8


#: Odd multipliers, from which a shingle's hash is put together, and words whose hashes a worker keeps.
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"%d" % k, SEED) | 1 for k in range(64)], dtype=np.uint64)
KEPT_WORDS = 200_000
_WORDS: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of the result depend on all bits of ``x``."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles, as ``shingles`` cuts them.

    A word is hashed once while a worker keeps it; a shingle's hash is a sum of
    its words' hashes, each times an odd number of its place, mixed.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, dtype=np.uint64)
    new = set(w).difference(_WORDS)
    if new:
        if len(_WORDS) + len(new) > KEPT_WORDS:
            _WORDS.clear()
            new = set(w)
        _WORDS.update((x, xxhash.xxh64_intdigest(x, SEED)) for x in new)
    h = np.fromiter(map(_WORDS.__getitem__, w), dtype=np.uint64, count=len(w))
    size = min(words, len(w))
    n = len(h) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += h[k : k + n] * _MULTIPLIERS[k]
    return np.unique(mixed(total))


def hashed_set(text: str | None, words: int) -> tuple[np.ndarray, bytes]:
    """The sorted 64-bit hashes of the distinct shingles, and the set's 128-bit fingerprint."""
    toks = shingle_hashes(text, words)
    ones = np.zeros(128, dtype=np.int64)
    for at in range(0, len(toks), 4096):
        some = toks[at : at + 4096]
        both = np.column_stack([mixed(some + np.uint64(1)), mixed(some + np.uint64(2))])
        ones += np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return toks, np.packbits(2 * ones > len(toks)).tobytes()


def as_longs(raw: list[bytes]) -> np.ndarray:
    """Rows of two longs from strings of 16 bytes."""
    return np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)


def prefix_size(n, similarity: float):
    """So many of the ``n`` shingles, the first in any order common to all sets, hold one
    of every set at ``similarity``: the pigeonhole principle for sets."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + (n > 0)


def shingle_sketch(texts: DataFrame, words: int) -> np.ndarray:
    """How many rows of ``texts.text`` hold a shingle of each bucket."""

    def work(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in slices(batches):
            toks = np.concatenate([shingle_hashes(t, words) for t in batch.column("text").to_pylist()])
            total += np.bincount((toks % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        return total

    return array_sums(texts.select("text"), work, SKETCH).astype(np.int64)


def similar_links(texts: DataFrame, similarity: float = 0.8, words: int = 5, above: int = -1) -> DataFrame:
    """Links (a0, a1, b0, b1) between codes of ``texts.text`` whose sets may be as
    similar as ``similarity``.

    Two such sets share a shingle among the first few of each (``prefix_size``),
    rare ones first, so that a passage that many texts hold is asked for only
    where little else is. What meets there is linked within a bit distance
    five standard deviations over that expected at the similarity. Neither
    rule depends on the number of texts. Links of ``above`` bits or fewer are left out.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    limit = int(128 * share + 5 * (128 * share * (1 - share)) ** 0.5 + 0.5)
    sent = texts.sparkSession.sparkContext.broadcast(shingle_sketch(texts, words))
    held = HELD

    def run(batches):
        counts = sent.value
        for batch in slices(batches):
            made = [hashed_set(t, words) for t in batch.column("text").to_pylist()]
            size = np.array([len(t) for t, _ in made], dtype=np.int64)
            toks, codes = np.concatenate([t for t, _ in made]), as_longs([c for _, c in made])
            doc, often = np.repeat(np.arange(len(made)), size), counts[(toks % np.uint64(SKETCH)).astype(np.int64)]
            order = np.lexsort((toks, often, doc))
            order = order[np.arange(len(toks)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(prefix_size(size, similarity), size)]
            doc, value, salts = doc[order], toks[order].view(np.int64), -(-often[order] // held)
            # What over HELD texts may share is dealt over salts; probes of it go to each salt.
            hot = np.flatnonzero(salts > 1)
            each = np.repeat(hot, salts[hot])
            rows = np.concatenate([np.arange(len(doc)), each])
            dealt = np.where(salts > 1, (codes[doc, 0] ^ codes[doc, 1]) % salts, 0)
            asked = np.arange(len(each)) - np.repeat(np.cumsum(salts[hot]) - salts[hot], salts[hot])
            role = np.concatenate([np.where(salts > 1, 2, 3), np.ones(len(each), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows)), pa.int32()), pa.array(value[rows]), pa.array(np.concatenate([dealt, asked]), pa.int32()), pa.array(role, pa.int32()), *(pa.array(codes[doc[rows], k]) for k in range(2))], names=["part", "value", "salt", "role", "fp0", "fp1"])

    rows = texts.select("text").mapInArrow(run, "part int, value long, salt int, role int, fp0 long, fp1 long")
    return link_groups(rows, 2, limit, above)


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between sets of at least ``similarity``, compared exactly, that connect what all such pairs connect."""
    size = np.array([len(s) for s in sets])
    toks, seen, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    cuts = np.cumsum(size)[:-1]
    stand, comp, links = {}, np.arange(len(sets)), []
    ranked = [s[np.lexsort((s, often[s]))] for s in np.split(seen, cuts)]
    for x in np.argsort(size, kind="stable"):
        keys = ranked[x][: int(prefix_size(size[x : x + 1], similarity)[0])].tolist()
        met = [np.frombuffer(stand[k], dtype=np.int64) for k in keys if k in stand]
        shared = np.bincount(np.concatenate(met), minlength=len(sets)) if met else np.zeros(0)
        del met
        near = np.flatnonzero(shared)
        near = near[size[near] >= similarity * size[x] - 1e-9]
        near = near[np.argsort(-shared[near], kind="stable")]
        while len(near):
            y, near = near[0], near[1:]
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= similarity * (size[x] + size[y] - both) - 1e-9:
                links.append((int(x), int(y)))
                comp[comp == comp[y]] = comp[x]
                near = near[comp[near] != comp[x]]
        for k in keys:
            if often[k] > 1:
                stand.setdefault(k, array("q")).append(x)
    return links


def verified_links(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (a, b) between ``texts.row_place`` of one ``root`` whose shingle sets are
    as similar as ``similarity``; sets of one (root, low, high) are compared."""

    def groups(batches):
        key, place, sets = None, [], []
        for batch in slices(batches):
            for *k, p, text in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "row_place", "text"))):
                if k != key and place:
                    yield place, sets
                    place, sets = [], []
                key = k
                place.append(p)
                sets.append(shingle_hashes(text, words))
        if place:
            yield place, sets

    def run(batches):
        for place, sets in groups(batches):
            links = similar_sets(sets, similarity)
            if links:
                a, b = np.array(place)[np.array(links).T]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["root", "low", "high"]
    return texts.select(*keys, "row_place", "text").repartition(*keys).sortWithinPartitions(*keys, "row_place").mapInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id.

    A group is what pairs connect whose sets of ``words``-word shingles have a
    Jaccard similarity of at least ``similarity``. Fingerprints of 128 bits that
    differ in ``NEAR`` or fewer are linked by the pigeonhole principle with
    thresholds of each code's own, which alone finds them; those further apart
    by shared rare shingles. Both make coarse components; within these the
    sets themselves are compared. All documents without words are copies
    of each other. Of repeated rows the first stays; a null id sorts last.
    The rows are stored with their places first, so that a place means the same
    row whenever it is read. Columns of any name are kept.
    """
    (place,) = fresh(docs, "row_place")
    placed, _ = stored(docs.withColumn(place, F.monotonically_increasing_id()), "placed")
    texts = placed.select(F.col(place).alias("row_place"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = checkpointed(set_keys(texts, words))
    classes = checkpointed(marked.groupBy("s0", "s1").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_place")).alias("first"), F.first("fp0").alias("fp0"), F.first("fp1").alias("fp1")).withColumn("row_place", F.col("first.row_place")))
    name = lambda s: F.concat_ws(":", F.col(f"{s}0").cast("string"), F.col(f"{s}1").cast("string"))
    near, beyond = pigeonhole_links(classes, NEAR, 2), similar_links(texts, similarity, words, NEAR)
    coarse = components(near.unionByName(beyond).select(name("a").alias("a"), name("b").alias("b")))
    named = classes.select("row_place", name("fp").alias("name"))
    rooted = checkpointed(named.join(coarse, named["name"] == coarse["node"], "left").select("row_place", F.coalesce("root", "name").alias("root")))
    # A coarse component of over BLOCK sets is compared by pairs of blocks.
    blocks = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    asked = rooted.join(blocks, "root").withColumn("mine", F.pmod(F.xxhash64("row_place"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("row_place", "root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    roots = components(verified_links(texts.join(asked, "row_place"), similarity, words))
    final = classes.join(roots, classes["row_place"] == roots["node"], "left").withColumn("root", F.coalesce("root", "row_place"))
    kept = final.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_place").alias("row_place"))
    return placed.join(kept.withColumnRenamed("row_place", place).hint("shuffle_hash"), place, "left_semi").drop(place)


def set_keys(texts: DataFrame, words: int) -> DataFrame:
    """row_place and id of ``texts``, a 128-bit key of the shingle set (s0, s1) and its fingerprint (fp0, fp1)."""

    def run(batches):
        for batch in slices(batches):
            made = [hashed_set(t, words) for t in batch.column("text").to_pylist()]
            both = np.hstack([as_longs([xxhash.xxh3_128_digest(t.tobytes(), SEED) for t, _ in made]), as_longs([c for _, c in made])])
            rest = batch.select(["row_place", "id"])
            yield with_columns(rest, ["s0", "s1", "fp0", "fp1"], [pa.array(both[:, k]) for k in range(4)])

    schema = T.StructType([*(f for f in texts.schema.fields if f.name != "text"), *(T.StructField(n, T.LongType()) for n in ("s0", "s1", "fp0", "fp1"))])
    return texts.mapInArrow(run, schema)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
