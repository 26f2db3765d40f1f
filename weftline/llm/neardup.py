"""Groups of texts that are versions of each other, by MinHash with Bayesian candidate pruning.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one node from here on, named by
   the hash of the set, so any number of exact copies costs one node.
2. Candidates by prefix filtering, which misses no pair: the shingles of all sets are put in one order, and two sets that
   reach the threshold hold a common shingle among the first ``n - ceil(threshold * n) + 1`` of either. Each of these is a
   bucket. Shingles frequent in a sample of the texts come last, so buckets are small; the order only decides what the
   search costs. In the bucket of their first common shingle two sets share no more than what either holds from there on, so
   each member has a largest partner size; two members whose sizes exceed each other's bound are no candidates there. A
   bucket of a formula that many otherwise different texts hold therefore empties, whatever its size: a member without any
   possible partner is found from running maxima, in one sorted pass and not by comparing members with each other. Sets
   that differ too much in the parity of their shingles in 256 cells are no candidates either. All these bounds are exact.
3. Of a bucket of up to ``small`` members the candidate pairs are listed at once. A larger one never emits all its pairs:
   each member is first paired with one possible partner only; the links found give components, and then only members that
   are still in different components are paired. What is left out are pairs that are connected already, so no component
   is lost.
4. A pair's MinHash values are compared in steps. With m of n equal, the posterior of the similarity under a uniform prior
   is known; a pair is dropped as soon as the posterior probability of reaching the threshold falls below ``tolerance``.
   This is the only step that may lose a link: one at 0.5 with probability 4e-8 at the tolerance used.
   The signature keeps 8 bits of each value, and the posterior accounts for chance agreement.
5. Pairs that survive are verified exactly on the whole shingle sets.
6. Connected components by alternating large-star and small-star steps until nothing changes; every step is written to the
   shared folder and the table before it is removed.

Defined cases: a row without key, a null text, or one of fewer than ``min_words`` words, takes no part; equal texts are linked; a repeated row
(same key) is the same record and is not paired with itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import WORD, mix, shingle_hashes, word_hashes
from weftline.session import discard, written

PARITY = [f"p{i}" for i in range(4)]
SKETCH = "field int, id bigint, node bigint, n int, sig binary, shingles binary"
#: A bucket's rows travel as one value each: a column less to convert for every field.
ROWS = "bucket bigint, member binary"
MEMBER = np.dtype([("node", "<i8"), ("n", "<i4"), ("most", "<i4"), ("parity", "<u8", len(PARITY))])
SHARED = "bucket bigint, node bigint, n int, most int, " + ", ".join(f"{p} bigint" for p in PARITY) + ", mate bigint"


@dataclass(frozen=True)
class Settings:
    """``threshold`` is the Jaccard similarity of shingle sets. ``signature`` MinHash values are kept of each set, ``step`` are
    compared at a time. About ``sample`` texts are counted for the order of shingles, of which at most ``frequent`` are
    broadcast. Of a bucket at most ``widest`` members are looked at together, and each is compared with at most ``look``
    after it in its search for one partner; only memory and time depend on either. Buckets of at most ``small`` members
    list their candidate pairs. A class of more than ``split`` records is paired in several tasks."""

    shingle: int = 3
    min_words: int = 12
    threshold: float = 0.5
    signature: int = 128
    step: int = 32
    tolerance: float = 1e-4
    seed: int = 1
    sample: int = 20_000
    frequent: int = 100_000
    widest: int = 200_000
    look: int = 256
    small: int = 16
    split: int = 2_000


#: What the operators use: pruning that loses next to nothing at the threshold.
WHOLE = Settings(tolerance=1e-8)


@lru_cache(maxsize=8)
def _multipliers(count: int, seed: int) -> np.ndarray:
    got = np.random.default_rng(seed).integers(1, 2**32, (2, count), dtype=np.uint32)
    got[0] |= np.uint32(1)
    return got


def minhash(shingles: np.ndarray, starts: np.ndarray, count: int, seed: int) -> np.ndarray:
    """MinHash values of many sets laid end to end: one row per set. No set may be empty."""
    a, b = _multipliers(count, seed)
    base = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out, held = np.empty((count, len(starts)), np.uint32), np.empty_like(base)
    for i in range(count):
        np.multiply(base, a[i], out=held)
        np.add(held, b[i], out=held)
        np.minimum.reduceat(held, starts, out=out[i])
    return out.T


def shingle_sets(texts: list[list[str]], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text's words; each text has at least ``size`` words."""
    ends = np.cumsum([len(w) for w in texts])
    every = shingle_hashes(word_hashes([w for words in texts for w in words]), size)
    return [np.unique(every[start : end - size + 1]) for start, end in zip([0, *ends[:-1]], ends)]


def sketcher(s: Settings):
    """Batches of ``field, id, text`` to batches of ``SKETCH``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, words, size = [], [], 0
            for f, i, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = WORD.findall(text.lower()) if text else ()
                if len(found) >= max(s.min_words, s.shingle):
                    kept.append((f, i))
                    words.append(found)
                    size += len(found)
                # a few thousand texts at a time, fewer of long ones: what is held stays in proportion to a batch
                if size > 200_000:
                    yield _sketch(kept, shingle_sets(words, s.shingle), s)
                    kept, words, size = [], [], 0
            if kept:
                yield _sketch(kept, shingle_sets(words, s.shingle), s)

    return run


def _sketch(kept: list[tuple], sets: list[np.ndarray], s: Settings) -> pa.RecordBatch:
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    values = minhash(np.concatenate(sets), starts, s.signature, s.seed)
    low = np.ascontiguousarray((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    raw = [x.tobytes() for x in sets]
    nodes = [xxhash.xxh64_intdigest(x, f) - 2**63 for x, (f, _) in zip(raw, kept)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f for f, _ in kept], pa.int32()), pa.array([i for _, i in kept], pa.int64()), pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int32()),
            pa.array([r.tobytes() for r in low], pa.binary()), pa.array(raw, pa.binary()),
        ],
        ["field", "id", "node", "n", "sig", "shingles"],
    )


def _sets(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``field, node, shingles`` to (nodes, sizes, shingles of all laid end to end, kept apart by field), some sets at a time."""
    fields, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    raw = batch.column(2).to_pylist()
    ends = np.cumsum([len(x) // 8 for x in raw])
    for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(ends // most)) + 1):
        if len(part):
            sizes = np.array([len(raw[k]) // 8 for k in part])
            every = np.frombuffer(b"".join(raw[k] for k in part), np.uint64)
            yield nodes[part], sizes, mix(every + np.repeat(fields[part].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), sizes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, every in _sets(batch):
            keys, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["bucket", "n"])


def frequencies(sketches: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur most in a sample of the texts, sorted, and how often they do; any answer is a valid order."""
    every = max(1, sketches.count() // s.sample)
    seen = sketches.where(F.pmod("node", F.lit(every)) == 0).select("field", "node", "shingles").mapInArrow(_counted, "bucket bigint, n bigint")
    counts = seen.groupBy("bucket").agg(F.sum("n").alias("c")).where("c > 1").orderBy(F.desc("c"), "bucket").limit(s.frequent).toArrow()
    keys, c = counts.column("bucket").to_numpy().view(np.uint64), counts.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], c[order]


def prefixes(shared, s: Settings):
    """Batches of ``field, node, shingles`` to batches of ``ROWS``; ``shared.value`` holds what ``frequencies`` gave.

    A bucket is named by its shingle's frequency and 47 bits of its hash, so the numbers' order is the shingles' order.
    """
    grow = (1 + s.threshold) / s.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in batches:
            for nodes, sizes, every in _sets(batch):
                name = every >> np.uint64(17)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
                    often = np.where(keys[at] == every, np.minimum(counts[at], 2**15 - 1), 0).astype(np.uint64)
                    name |= often << np.uint64(47)
                starts = np.cumsum(sizes) - sizes
                for a, b in zip(starts, starts + sizes):
                    name[a:b].sort()
                kept = np.minimum(sizes - np.ceil(s.threshold * sizes - 1e-9).astype(np.int64) + 1, sizes)
                at = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
                n = np.repeat(sizes, kept)
                # a partner of m shingles shares at least threshold / (1 + threshold) * (n + m) of those left from here on
                most = np.floor((n - at) * grow - n + 1e-6)
                cell, bit = (every >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (every & np.uint64(63))
                parity = np.stack([np.bitwise_xor.reduceat(np.where(cell == np.uint64(i), bit, np.uint64(0)), starts) for i in range(len(PARITY))], 1)
                out = np.empty(len(n), MEMBER)
                for c, x in (("node", np.repeat(nodes, kept)), ("n", n), ("most", most), ("parity", np.repeat(parity, kept, 0))):
                    out[c] = x
                ends = np.arange(len(out) + 1, dtype=np.int32) * MEMBER.itemsize
                members = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([pa.array(name[np.repeat(starts, kept) + at].view(np.int64)), members], ["bucket", "member"])

    return run


def _mates(bucket: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each row of whole buckets, sorted by bucket and size: the place of a row that may be its partner, or -1.

    Two rows may be partners if neither's size exceeds the other's ``most``. Among the rows whose size suits, the one with
    the largest ``most`` decides; running maxima give it and, for a row that is itself the largest, the second.
    """
    rows = np.arange(len(bucket))
    step = np.int64(2) ** 33
    base = (np.cumsum(np.concatenate(([True], bucket[1:] != bucket[:-1]))) * step) if len(bucket) else rows
    value = base + most
    first = np.maximum.accumulate(value)
    before = np.concatenate(([np.int64(-1)], first[:-1]))
    record = value > before
    first_at = np.maximum.accumulate(np.where(record, rows, 0))
    rest, rest_at = np.where(record, before, value), np.where(record, np.concatenate(([0], first_at[:-1])), rows)
    second = np.maximum.accumulate(rest)
    second_at = rest_at[np.maximum.accumulate(np.where(rest > np.concatenate(([np.int64(-2)], second[:-1])), rows, 0))]
    end = np.searchsorted(base + n, value, "right") - 1
    end = np.maximum(end, 0)
    own = first_at[end] == rows
    found, reach = np.where(own, second_at[end], first_at[end]), np.where(own, second[end], first[end])
    # a row whose size no row suits would look into the bucket before
    return np.where((reach >= base + n) & (bucket[found] == bucket) & (n[found] <= most) & (found != rows), found, -1)


def _near_mates(bucket: np.ndarray, n: np.ndarray, most: np.ndarray, parity: np.ndarray, small: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, the place of the first row found that may be its partner by sizes and parity, or -1; the rows of which
    not all others were looked at; and all pairs (two rows of places) that may be partners among the rows of ``small``."""
    mate, a, d, pairs = np.full(len(bucket), -1), np.arange(len(bucket)), 0, [np.empty((2, 0), np.int64)]
    while d < max(s.look, s.small):
        d += 1
        a = a[a < len(bucket) - d]
        # rows are sorted by size: all further ones are too large
        a = a[(bucket[a] == bucket[a + d]) & (n[a + d] <= most[a])]
        if not len(a):
            return mate, np.zeros(len(bucket), bool), np.concatenate(pairs, 1)
        b = a + d
        odd = np.bitwise_count(parity[a] ^ parity[b]).sum(1, dtype=np.int64)
        ok = (n[a] <= most[b]) & (odd <= (1 - s.threshold) / (1 + s.threshold) * (n[a] + n[b]) + 1e-6)
        x, y = a[ok], b[ok]
        pairs.append(np.stack((x, y))[:, small[x]])
        fresh = mate[x] < 0
        mate[x[fresh]] = y[fresh]
        fresh = mate[y] < 0
        mate[y[fresh]] = x[fresh]
    return mate, np.isin(bucket, bucket[a]), np.concatenate(pairs, 1)


def _members(column: pa.Array) -> np.ndarray:
    """The values of a binary column of ``MEMBER``, in place."""
    if not len(column):
        return np.empty(0, MEMBER)
    _, ends, data = column.buffers()
    begin = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(data, MEMBER, len(column), int(begin))


def mated(s: Settings):
    """Rows of ``ROWS`` sorted by bucket to ``SHARED``, without members that can have no link there.

    Of small buckets come candidate pairs ``node, mate`` with ``n`` 0; of larger ones the members, each with one partner.

    What is kept between batches is one bucket of at most ``widest`` rows; a wider one is passed on in parts that keep all
    their members, since the partner of a member may be in another part.
    """

    def of(bucket: np.ndarray, rows: np.ndarray, whole: bool = False) -> pa.RecordBatch:
        # most buckets hold one row; a part of one may too
        more = bucket[1:] == bucket[:-1]
        at = np.arange(len(bucket)) if whole or not len(bucket) else np.flatnonzero(np.concatenate((more, [False])) | np.concatenate(([False], more)))
        at = at[np.lexsort((rows["node"][at], rows["n"][at], bucket[at]))]
        bucket, rows = bucket[at], rows[at]
        keep = np.ones(len(bucket), bool)
        keep[1:] = (bucket[1:] != bucket[:-1]) | (rows["node"][1:] != rows["node"][:-1])
        bucket, rows = bucket[keep], rows[keep]
        mate = _mates(bucket, rows["n"].astype(np.int64), rows["most"].astype(np.int64))
        keep, pairs = np.ones(len(bucket), bool), np.empty((2, 0), np.int64)
        if not whole:
            bucket, rows = bucket[mate >= 0], rows[mate >= 0]
            size = np.diff(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))) if len(bucket) else np.empty(0, np.int64)
            small = np.repeat(size <= s.small, size)
            mate, unsure, pairs = _near_mates(bucket, rows["n"].astype(np.int64), rows["most"].astype(np.int64), rows["parity"], small, s)
            # of a bucket wider than was looked through, a member stays without a partner found
            keep = ((mate >= 0) | unsure) & ~small
        listed = rows["node"][pairs]
        # a bucket in parts: a member without partner in its part may have one in another
        mate = np.where(mate >= 0, rows["node"][mate] if len(mate) else mate, rows["node"])[keep]
        bucket, rows = bucket[keep], rows[keep]
        none = np.zeros(listed.shape[1], np.int64)
        columns = [(none, bucket), (listed[0], rows["node"]), (none, rows["n"]), (none, rows["most"]), *((none, np.ascontiguousarray(rows["parity"][:, i]).view(np.int64)) for i in range(len(PARITY))), (listed[1], mate)]
        types = [pa.int32() if c in ("n int", "most int") else pa.int64() for c in SHARED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(columns, types)], [c.split()[0] for c in SHARED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide = None, None
        for batch in batches:
            bucket, rows = batch.column(0).to_numpy(), _members(batch.column(1))
            if held is not None:
                bucket, rows = np.concatenate((held[0], bucket)), np.concatenate((held[1], rows))
            if wide is not None:
                end = int(np.searchsorted(bucket, wide, "right"))
                yield of(bucket[:end], rows[:end], whole=True)
                bucket, rows = bucket[end:], rows[end:]
            if not len(bucket):
                held = None
                continue
            last = int(np.searchsorted(bucket, bucket[-1], "left"))
            yield of(bucket[:last], rows[:last])
            held, wide = (bucket[last:], rows[last:]), None
            if len(held[0]) > s.widest:
                wide = held[0][0]
                yield of(*held, whole=True)
                held = None
        if held is not None:
            yield of(*held)

    return run


def posterior(matches: int, compared: int, threshold: float, chance: float = 1 / 256, cells: int = 2000) -> float:
    """P(similarity >= threshold | ``matches`` of ``compared`` values agree), uniform prior, chance agreement included."""
    grid = (np.arange(cells) + 0.5) / cells
    agree = grid + (1 - grid) * chance
    log = matches * np.log(agree) + (compared - matches) * np.log1p(-agree)
    weight = np.exp(log - log.max())
    return float(weight[grid >= threshold].sum() / weight.sum())


@lru_cache(maxsize=8)
def pruning_table(s: Settings) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches with which a pair goes on) of each step."""
    out = []
    for n in range(s.step, s.signature + 1, s.step):
        out.append((n, next(m for m in range(n + 1) if m == n or posterior(m, n, s.threshold) >= s.tolerance)))
    return tuple(out)


def _survivors(s: Settings):
    table = pruning_table(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, s.signature) for i in (2, 3))
            live, matches, done = np.arange(len(x)), np.zeros(len(x), np.int32), 0
            for n, least in table:
                matches[live] += (x[live, done:n] == y[live, done:n]).sum(1, dtype=np.int32)
                live, done = live[matches[live] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["a", "b"])

    return run


def _verified(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= s.threshold * (len(x) + len(y) - shared) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def links(pairs: DataFrame, nodes: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets reach the threshold: pruned on signatures, then verified on whole sets."""
    side = lambda t, c, x: t.select(F.col("node").alias(c), F.col(x).alias(f"{x}_{c}"))
    both = pairs.join(side(nodes, "a", "sig"), "a").join(side(nodes, "b", "sig"), "b")
    live = written(both.select("a", "b", "sig_a", "sig_b").mapInArrow(_survivors(s), "a bigint, b bigint"), "neardup-live")
    ends = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    sets = sketches.join(ends, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"])
    full = live.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    found = written(full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verified(s), "a bigint, b bigint"), "neardup-links")
    discard(live)
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``; the root is the component's smallest node."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "neardup-edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    had, seen = None, mark(now)
    while had != seen:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last, now = now, written(small.distinct(), "neardup-edges")
        discard(last)
        had, seen = seen, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(df: DataFrame, key: str, fields: list[str], s: Settings = WHOLE) -> DataFrame:
    """``field, id, class_id`` of every text that takes part; texts of one class are linked directly or through others."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for i, f in enumerate(fields))))
    texts = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), cells.alias("c")).select("c.field", "id", "c.text").where("text is not null and id is not null")
    sketches = written(texts.mapInArrow(sketcher(s), SKETCH), "neardup-sketches")

    order = df.sparkSession.sparkContext.broadcast(frequencies(sketches, s))
    rows = sketches.select("field", "node", "shingles").mapInArrow(prefixes(order, s), ROWS)
    shared = written(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(mated(s), SHARED), "neardup-buckets")
    # what pruning needs of a node that has a possible partner; copies of a set are one node
    near = shared.select(F.explode(F.array("node", "mate")).alias("node")).distinct()
    nodes = written(sketches.select("node", "sig").join(near, "node", "left_semi").dropDuplicates(["node"]), "neardup-nodes")

    star = written(shared.where("node != mate").select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")).distinct(), "neardup-star")
    roots = components(links(star, nodes, sketches, s))

    # members of a larger bucket that are still in different components
    placed = shared.where("n > 0").drop("mate").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    placed = placed.join(mixed, "bucket", "left_semi")
    side = lambda c: placed.select("bucket", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "most", "root", *PARITY)))
    odd = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY), F.lit(0))
    rest = (
        side("a")
        .join(side("b"), "bucket")
        .where("root_a < root_b and n_a <= most_b and n_b <= most_a")
        .where(odd <= F.lit((1 - s.threshold) / (1 + s.threshold)) * (F.col("n_a") + F.col("n_b")) + 1e-6)
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    second = links(rest, nodes, sketches, s)
    # the new links join components, so they are resolved between roots; without any, the first components stand
    final = roots
    if not second.isEmpty():
        root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        joined = second.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
        above = components(joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
        placed = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # nodes that had no component of their own before
        final = placed.unionAll(above.join(roots, "node", "left_anti").select("node", "root"))
    for done in (shared, nodes, star):
        discard(done)
    return sketches.select("field", "id", "node").distinct().join(final, "node", "left").select("field", "id", F.coalesce("root", "node").alias("class_id"))


def linked_pairs(df: DataFrame, key: str, fields: list[str], s: Settings = WHOLE) -> DataFrame:
    """Every pair of records of one class: ``field, id_a, id_b`` with ``id_a < id_b``.

    The members of a class of more than ``split`` records are dealt to as many tasks as it holds that many; the other side
    of the pairs goes to each of them, which is less than the pairs themselves.
    """
    found = written(classes(df, key, fields, s).distinct(), "neardup-classes")
    many = found.groupBy("field", "class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = found.join(many, ["field", "class_id"]).withColumn("parts", F.ceil(F.col("n") / s.split).cast("int"))
    a = found.select("field", "class_id", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = found.select("field", "class_id", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    names = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    return a.join(b, ["field", "class_id", "part"]).where("id_a < id_b").select(names.alias("field"), "id_a", "id_b")
