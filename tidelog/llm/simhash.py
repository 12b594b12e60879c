"""SimHash near-duplicates: fingerprints of three-word shingles, linked at few differing bits.

Fingerprints are compared once each, however many documents share one. The links are found with a hierarchical
index in Gray order. Its upper nodes are masked bit patterns: the bits are cut into one part more than may differ, so
two linked fingerprints agree on a whole part, and each part's mask and pattern is a node that holds the
fingerprints with that pattern. A node with more than ``leaf`` fingerprints is cut again by the bits it leaves
open, so no task gets a large node. A task builds the tree below its nodes: fingerprints sorted by Gray rank in
each, runs of them as groups, runs of groups as groups, each with the bits that all its members share. Pairs of
groups are compared from the top down; the differences are handed down and added up over the bits that each level
shares anew, and a pair of groups above the limit is dropped with all below it. Every link is found there, in nodes
of any size. Nothing is capped, so the links are complete.

Defined results: a text without words (or null) has fingerprint 0 and is linked like any other; with one or two
words, its whole sequence is the only shingle; repeated rows each get the component of their fingerprint; the
component is the smallest doc_id in it (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components

_PIECE = 200_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if it is in over half of the shingles' hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PIECE):
        to = min(n, at + _PIECE)
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)), np.uint64, to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with ``fp`` (the 64 bits as a signed long)."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch), np.uint64, len(batch))
            yield pa.array(values.view(np.int64))

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (text, "fp")), fp(F.col(f"`{text}`")).alias("fp"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each value stands in the Gray sequence."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _cut(bits: list[int], parts: int) -> list[int]:
    """The bits dealt into runs, as masks."""
    runs = np.array_split(np.array(bits), parts)
    return [int(sum(1 << int(b) for b in run)) for run in runs]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_pairs(fps: np.ndarray, node: np.ndarray, limit: int, fan: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """All pairs in a node of distinct ``fps`` with at most ``limit`` differing bits, as two arrays of their places, and
    how many pairs of groups were looked at. ``node`` has the index node of each.

    The tree: fingerprints in the order of nodes and, in a node, of Gray ranks; runs of ``fan`` are groups, and so on up.
    A group has the masked pattern that all below it share. On the way down, a pair of groups inherits what its
    parents differ by and which bits that covers, adds the differences on the bits that are new in its own patterns,
    and goes with all below it once the sum is above the limit (or no node reaches from one to the other).
    """
    order = np.lexsort((gray_rank(fps), node))
    fps, node = fps[order], node[order]
    place = np.cumsum(np.concatenate(([0], node[1:] != node[:-1])))
    levels = [(fps, fps, place, place)]  # bits set in all and in any; the first and the last node
    while len(levels[-1][0]) > fan:
        ands, ors, low, high = levels[-1]
        at = np.arange(0, len(ands), fan)
        levels.append((np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at), low[at], high[np.minimum(at + fan, len(ands)) - 1]))
    i, j = np.triu_indices(len(levels[-1][0]))
    differ, covered = np.zeros(len(i), np.uint8), np.zeros(len(i), np.uint64)
    step, looked = np.arange(fan), 0
    for depth in range(len(levels) - 1, -1, -1):
        ands, ors, low, high = levels[depth]
        shared = ~(ands ^ ors)
        kept = []
        for at in range(0, len(i), 4096):  # in pieces, so that memory is bounded
            a, b, d, known = (x[at : at + 4096] for x in (i, j, differ, covered))
            if depth < len(levels) - 1:  # the groups below
                a, b = np.broadcast_arrays((a[:, None] * fan + step)[:, :, None], (b[:, None] * fan + step)[:, None, :])
                d, known = (np.broadcast_to(x[:, None, None], a.shape) for x in (d, known))
                ok = (a <= b) & (b < len(ands))
                a, b, d, known = a[ok], b[ok], d[ok], known[ok]
            looked += len(a)
            both = shared[a] & shared[b]
            d = d + np.bitwise_count((ands[a] ^ ands[b]) & both & ~known)
            near = (d <= limit) & (low[b] <= high[a])
            kept.append((a[near], b[near], d[near], both[near]))
        i, j, differ, covered = (np.concatenate(x) for x in zip(*kept, strict=True))
    apart = i != j
    return order[i[apart]], order[j[apart]], looked


def forest(n: int, a: np.ndarray, b: np.ndarray, few: int = 1, stars: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges ``a`` to ``b`` among ``n`` connect: ``stars`` stars in each component, around the
    least and around others drawn by a fixed rule; all its edges in a component of at most ``few``."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            break
    small = np.bincount(least, minlength=n)[least[a]] <= few
    left, right = [a[small]], [b[small]]
    some = np.flatnonzero(np.bincount(least, minlength=n)[least] > few)
    for k in range(stars):
        rank = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 if k else 1)) >> np.uint64(8 * k)
        order = some[np.lexsort((rank[some], least[some]))]
        new = np.concatenate(([True], least[order][1:] != least[order][:-1])) if len(order) else np.zeros(0, bool)
        centre = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        left.append(order[order != centre])
        right.append(centre[order != centre])
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch], limit: int, few: int, stars: int) -> Iterator[pa.RecordBatch]:
    """Links inside the nodes of a partition that is sorted by node, some nodes at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: tuple[np.ndarray, ...] | None = None

    def within(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        i, j, _ = close_pairs(fp, node, limit)
        i, j = forest(len(fp), i, j, few, stars)
        a, b = fp[i].view(np.int64), fp[j].view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[1] = now[1].view(np.uint64)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
        rest = tuple(x[last:] for x in now)
        if last:
            yield within(*(x[:last] for x in now))
    if rest is not None and len(rest[0]):
        yield within(*rest)


def links(distinct: DataFrame, limit: int = 2, leaf: int = 512, few: int = 1, stars: int = 1) -> DataFrame:
    """``(a, b)``, a < b, of the distinct longs ``fp``: pairs that connect what all pairs with at most ``limit`` differing
    bits connect. Of what hangs together in a node, every pair up to ``few`` fingerprints and ``stars`` stars beyond."""
    parts = limit + 1
    spark = distinct.sparkSession
    node = F.xxhash64("path", F.col("fp").bitwiseAND(F.col("mask"))).alias("node")
    # paths, and their masks, are rows: as expressions they would be eight times as many in each level
    masks = dict(enumerate(_cut(list(range(64)), parts)))
    level = distinct.select("fp", F.lit(0).cast("long").alias("path"))
    below = [(0, k, _signed(m)) for k, m in masks.items()]
    found = None
    while True:
        table = F.broadcast(spark.createDataFrame(below, "path long, _path long, mask long"))
        level = settle(level.join(table, "path").select("fp", F.col("_path").alias("path"), "mask").select("fp", "path", node))
        sizes = settle(level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1"))
        ready = level.join(sizes.where(F.col("n") <= leaf).select("node"), "node").select("node", "fp")
        some = settle(ready.repartition("node").sortWithinPartitions("node").mapInArrow(lambda it: _links(it, limit, few, stars), "a long, b long").distinct())
        found = some if found is None else found.unionByName(some)
        large = sizes.where(F.col("n") > leaf)
        paths = [r["path"] for r in large.select("path").distinct().collect()]
        if not paths:
            return settle(found.distinct())
        # cut large nodes by the bits they leave open: again one part more than may differ
        cuts: dict[int, int] = {}
        below = []
        for path in paths:
            open_ = [b for b in range(64) if not masks[path] >> b & 1]
            if len(open_) < parts:
                raise RuntimeError("a node of equal fingerprints: they must be distinct")
            for m in _cut(open_, parts):
                below.append((path, len(cuts), _signed(masks[path] | m)))
                cuts[len(cuts)] = masks[path] | m
        masks = cuts
        level = level.join(large.select("node"), "node").select("fp", "path")


def mapping(slim: DataFrame, limit: int = 2) -> DataFrame:
    """``(fp, component_id)`` for each fingerprint of ``slim (doc_id, fp)``: the smallest doc_id reachable over links."""
    distinct = settle(slim.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    joined = components(links(distinct.select("fp"), limit))
    mine = distinct.join(joined, distinct["fp"] == joined["node"], "left")
    mine = settle(mine.select("fp", "_first", F.coalesce("component", "fp").alias("_class")))
    firsts = settle(mine.groupBy("_class").agg(F.min("_first").alias("component_id")))
    return settle(mine.join(firsts, "_class").select("fp", "component_id"))


def classes(docs: DataFrame, text: str = "text", limit: int = 2, shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with ``fp`` and ``component_id``: the smallest doc_id reachable over links."""
    slim = settle(fingerprints(docs, text, shingle))
    return slim.join(mapping(slim.select("doc_id", "fp"), limit), "fp")


def digest(docs: DataFrame) -> DataFrame:
    out = classes(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes of the runs of ``k`` words of a text in lower case, in order; of the whole, if it has fewer."""
    w = (text or "").encode().lower().split()
    runs = {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)).view(np.int64))


def verified(pairs: DataFrame, homes: DataFrame, docs: DataFrame, k: int, threshold: float, broadcast_rows: int = 200_000) -> DataFrame:
    """The ``pairs (a, b)`` of texts, by their MD5, that have at least ``threshold`` of their shingles of ``k`` words in common
    (two texts without words do). ``homes (_t, _first)`` names a document of each text; ``docs`` has ``doc_id`` and ``text``."""

    @F.arrow_udf("array<long>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(t.as_py(), k) for t in batch], pa.list_(pa.int64()))

    wanted = settle(pairs.select(F.col("a").alias("_t")).union(pairs.select("b")).distinct().join(homes.select("_t", "_first"), "_t"))
    few = F.broadcast if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda x: x
    found = docs.withColumn("_t", _print()).join(few(wanted.withColumnRenamed("_t", "_w")), (F.col("_t") == F.col("_w")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    shingles = settle(found.select("_t", sets("text").alias("_s")).dropDuplicates(["_t"]))
    side = lambda x: shingles.select(F.col("_t").alias(x), F.col("_s").alias(f"_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("_i"), (F.size("_a") + F.size("_b")).alias("_n"))
    return both.where(F.col("_i") >= threshold * (F.col("_n") - F.col("_i")) - 1e-9).select("a", "b")


def _print() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def prefix(s: np.ndarray, threshold: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """What of a set, in an order that all sets share, a set with ``threshold`` in common must meet: its first members, as
    many as may be missing from the other and one more. Members of ``frequent`` (sorted) come last, by ``rank``, so that
    few sets meet by chance; a set without members has the member 0."""
    if not len(s):
        return np.zeros(1, np.int64)
    n = len(s) - int(np.ceil(threshold * len(s) - 1e-6)) + 1
    if not len(frequent):
        return s[:n]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    return s[np.argsort(np.where(frequent[at] == s, rank[at], 0), kind="stable")[:n]]


def chained(n: np.ndarray, pos: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what all pairs connect that may have ``threshold`` in common, by their sizes and places alone: at
    most one for each set, found without looking at all pairs.

    A set may have a larger one for a partner up to a size ``high``, and none beyond ``most``. Of the sets with ``high``
    at or above their own size, each is linked to the smaller one that reaches highest; all that reach it may be partners
    of each other. Any other set has smaller partners only, up to ``most``, and the same holds for them."""
    most = (1 + threshold) / threshold * (n - pos + 1e-6) - n
    high = np.minimum(most, (n + 1e-6) / threshold)
    order = np.argsort(n, kind="stable")
    core, rest = order[high[order] >= n[order]], order[high[order] < n[order]]
    if not len(core):
        return core, core
    top = np.maximum.accumulate(high[core])
    best = core[np.maximum.accumulate(np.where(high[core] == top, np.arange(len(core)), 0))]
    last = np.searchsorted(n[core], most[rest], "right") - 1
    a, b = np.concatenate((core[1:], rest)), np.concatenate((best[:-1], best[np.maximum(last, 0)]))
    ok = (high[b] >= n[a]) & np.concatenate((np.ones(len(core) - 1, bool), last >= 0))
    return a[ok], b[ok]


def _meeting(token: np.ndarray, mine: np.ndarray, cls: np.ndarray, n: np.ndarray, pos: np.ndarray, threshold: float, most: int = 1 << 20, few: int | None = None) -> np.ndarray:
    """Pairs of sets that meet at a token, lie in different classes and may have ``threshold`` in common: by their sizes
    ``n``, and by what can follow after the places ``pos`` if the token is the first that they share. Of more than ``few``
    sets at a token, pairs that connect what these pairs connect, or more."""
    order = np.lexsort((mine, token))
    token, mine, cls, n, pos = (x[order] for x in (token, mine, cls, n, pos))
    once = np.concatenate(([True], (token[1:] != token[:-1]) | (mine[1:] != mine[:-1])))
    token, mine, cls, n, pos = (x[once] for x in (token, mine, cls, n, pos))
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(start, len(token)))
    mixed = np.minimum.reduceat(cls, start) != np.maximum.reduceat(cls, start)
    found = [np.zeros((0, 2), np.int64)]

    def add(a: np.ndarray, b: np.ndarray) -> None:
        found.append(np.stack([mine[a], mine[b]], axis=1))
        if len(found) > 64:
            found[:] = [np.unique(np.concatenate(found), axis=0)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        rest, both = np.minimum(n[a] - pos[a], n[b] - pos[b]), n[a] + n[b]
        ok = (cls[a] != cls[b]) & (rest >= threshold / (1 + threshold) * both - 1e-6) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-6)
        add(a[ok], b[ok])

    for m in np.unique(size[mixed]).tolist():
        starts = start[mixed & (size == m)]
        if few is not None and m > few:
            for s in starts.tolist():
                a, b = chained(n[s : s + m], pos[s : s + m], threshold)
                add(s + a, s + b)
        elif m * m <= most:
            i, j = np.triu_indices(m, 1)
            step = max(1, most // len(i))
            for at in range(0, len(starts), step):
                some = starts[at : at + step, None]
                compare((some + i).reshape(-1), (some + j).reshape(-1))
        else:  # some rows of the triangle at a time, so that memory is bounded
            step = max(1, most // m)
            for s in starts.tolist():
                for i in range(0, m, step):
                    a, b = np.meshgrid(np.arange(i, min(m, i + step)), np.arange(i, m), indexing="ij")
                    compare(s + a[a < b], s + b[a < b])
    return np.unique(np.concatenate(found), axis=0)


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of a set's members falls on each of some bits, about two bits a member. Each member that only
    one of two sets has changes one bit, so as many bits as differ, so many members at least do."""
    size = 256
    while size < min(2 * len(s), 1 << 14):
        size *= 2
    return np.packbits(np.bincount(s & (size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The bits that differ, once the longer is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def meeting(postings: DataFrame, threshold: float, few: int = 8) -> DataFrame:
    """``(a, b)``: pairs that connect what the pairs of ``postings (token, id, cls, n, pos)`` that ``_meeting`` finds connect;
    of the tokens that are looked at together, at most one for each set."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []  # the last token may go on in the next batch

        def out() -> pa.RecordBatch:
            got = _meeting(*(np.concatenate(x) for x in zip(*waiting, strict=True)), threshold, few=few)
            ids, at = np.unique(got, return_inverse=True)
            a, b = forest(len(ids), *at.reshape(-1, 2).T)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last or waiting and waiting[-1][0][-1] != now[0][0]:
                if last:
                    waiting.append([x[:last] for x in now])
                yield out()
                waiting = []
            waiting.append([x[last:] for x in now])
        if waiting:
            yield out()

    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(pairs, "a long, b long").distinct()


class Frequent:
    """In how many sets a shingle is, as a level: 0 for those of one set, up to 3; some are put too high. By bit tables of the
    shingles in at least 2, 8 and 64 sets, each in slices by the first bits of the hashes."""

    LEAST, SLICES = (2, 8, 64), 1024

    def __init__(self, tables: list[np.ndarray]) -> None:
        self.tables = tables

    @staticmethod
    def parts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slice of each hash, and 32 more bits of it."""
        x = s.view(np.uint64)
        return (x >> np.uint64(54)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def level(self, s: np.ndarray) -> np.ndarray:
        part, low = self.parts(s)
        out = np.zeros(len(s), np.int64)
        for table in self.tables:
            width = 8 * len(table) // self.SLICES
            at = part * width + low % width
            out += (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return out

    @classmethod
    def of(cls, texts: DataFrame, k: int, chunk: int = 2_000_000, max_bits: int = 1 << 30) -> Frequent:
        """Of all ``texts (text)``. Hashes are moved in 4 bytes each, sorted by slice."""

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def out() -> pa.RecordBatch:
                part, low = cls.parts(np.concatenate(held))
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(cls.SLICES + 1)).tolist()
                low = low[order].astype(np.uint32)
                some = [i for i in range(cls.SLICES) if cut[i] < cut[i + 1]]
                return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["part", "data"])

            n = 0
            for batch in batches:
                for text in batch.column(0):
                    held.append(shingle_set(text.as_py(), k))
                    n += len(held[-1])
                    if n >= chunk:
                        yield out()
                        held, n = [], 0
            if n:
                yield out()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for batch in batches:
                for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.setdefault(part, []).append(data)
            for part, datas in held.items():
                x, n = np.unique(np.frombuffer(b"".join(datas), np.uint32), return_counts=True)
                levels = [x[n >= least] for least in cls.LEAST]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(levels), pa.int32()), pa.array(range(len(levels)), pa.int32()), pa.array(map(len, levels), pa.int64()), pa.array([x.tobytes() for x in levels], pa.binary())], names=["part", "level", "n", "data"])

        kept = settle(texts.mapInArrow(packed, "part int, data binary").repartition("part").mapInArrow(counted, "part int, level int, n long, data binary"))
        sizes = {r["level"]: r["n"] for r in kept.groupBy("level").agg(F.sum("n").alias("n")).collect()}
        tables = []
        for i in range(len(cls.LEAST)):
            bits = min(max_bits, 1 << max(13, (16 * sizes.get(i, 0) - 1).bit_length()))
            width = bits // cls.SLICES

            def fill(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        x = np.zeros(width, bool)
                        x[np.frombuffer(data, np.uint32) % width] = True
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["part", "data"])

            table = np.zeros(bits // 8, np.uint8)
            for r in kept.where((F.col("level") == i) & (F.col("n") > 0)).select("part", "data").mapInArrow(fill, "part int, data binary").toLocalIterator():
                table[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(r["data"], np.uint8)
            tables.append(table)
        return cls(tables)


def alike(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect the places of ``sets`` as all pairs with ``threshold`` in common do: each set is compared with those
    that nothing has reached yet, so in one group there are few comparisons."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    left, at, links = np.ones(len(sets), bool), len(sets), []
    begin = where = None
    queue: list[int] = []
    for first in range(len(sets)):
        if left[first]:
            left[first] = False
            queue.append(first)
        while queue and left.any():
            if begin is None or 2 * left.sum() < at:  # an index of the sets that are left
                at, mine = int(left.sum()), np.flatnonzero(left[owner])
                mine = mine[np.argsort(member[mine], kind="stable")]
                where, begin = owner[mine], np.searchsorted(member[mine], np.arange(member.max(initial=-1) + 2))
            i = queue.pop()
            its = member[ends[i] - size[i] : ends[i]]
            many = begin[its + 1] - begin[its]
            both = np.bincount(where[np.repeat(begin[its] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(sets))
            for j in np.flatnonzero(left & (both >= threshold * (size + size[i] - both) - 1e-9)).tolist():
                left[j] = False
                links.append((i, j))
                queue.append(j)
        queue.clear()
    return links


def missed(docs: DataFrame, texts: DataFrame, of: DataFrame, k: int, threshold: float, group: int = 2_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``(a, b)``, by their MD5: verified pairs that connect what all pairs of ``texts`` in different classes of ``of (node,
    component)`` with ``threshold`` of their shingles of ``k`` words in common connect.

    An exact prefix filter, rare shingles first, finds what may be so alike: of its pairs no more are given out than
    connect the same. What hangs together by them then meets in a task, where all its pairs are judged; a text's
    shingles are moved once for it, unless more than ``group`` texts hang together: these are cut into blocks, and every
    pair of blocks is a group of its own."""
    # a document of each text, with the class of the text; most texts have no copy, and are a class
    mine = texts.join(of, texts["_t"] == of["node"], "left").where("_docs > 1 OR component IS NOT NULL")
    mine = settle(mine.select(F.col("_t").alias("_w"), "_first", F.xxhash64(F.coalesce("component", "_t")).alias("_c")))
    few = F.broadcast if mine.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda x: x
    rows = docs.withColumn("_t", _print()).join(few(mine), F.col("_t") == F.col("_w"), "left").where(F.col("_w").isNull() | F.col("doc_id").eqNullSafe(F.col("_first")))
    rows = rows.select(F.xxhash64("_t").alias("id"), F.coalesce("_c", F.xxhash64("_t")).alias("cls"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(Frequent.of(rows.select("text"), k).tables)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Frequent(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.slice(at, 200)
                sets = [shingle_set(t.as_py(), k) for t in some.column("text")]
                tokens, places = [], []
                for s in sets:
                    level = often.level(s)
                    first = prefix(s, threshold, s[level > 0], level[level > 0])
                    # a shingle of one set meets nothing
                    places.append(np.flatnonzero(often.level(first) > 0) if len(s) else np.arange(1))
                    tokens.append(first[places[-1]])
                many = [len(x) for x in tokens]
                columns = [np.concatenate(tokens), *(np.repeat(some.column(c).to_numpy(), many) for c in ("id", "cls")), np.repeat([len(s) for s in sets], many), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["token", "id", "cls", "n", "pos"])

    found = components(settle(meeting(rows.mapInArrow(post, "token long, id long, cls long, n int, pos int"), threshold)))
    large = settle(found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("blocks")).where("blocks > 1"))
    found = found.join(large, "component", "left").select(F.col("node").alias("_id"), F.col("component").alias("together"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    found = settle(found)
    few = F.broadcast if found.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda x: x

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.slice(at, 200)
                data = pa.array([shingle_set(t.as_py(), k).tobytes() for t in some.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("together", "blocks", "id")), data], names=["together", "blocks", "id", "data"])

    sets = rows.join(few(found), F.col("id") == F.col("_id")).select("together", "blocks", "id", "text").mapInArrow(packed, "together long, blocks int, id long, data binary")
    sets = sets.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("together", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "id", "data")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, members in groupby(its, itemgetter(0, 1, 2)):
            once = {r[3]: np.frombuffer(r[4], np.int64) for r in members}
            ids, links = list(once), alike(list(once.values()), threshold)
            yield pa.RecordBatch.from_arrays([pa.array([ids[x[side]] for x in links], pa.int64()) for side in (0, 1)], names=["a", "b"])

    links = settle(sets.repartition("together", "i", "j").sortWithinPartitions("together", "i", "j").mapInArrow(judged, "a long, b long"))
    names = settle(found.join(texts.select(F.xxhash64("_t").alias("_id"), "_t"), "_id").select("_id", "_t"))
    side = lambda x: names.select(F.col("_id").alias(x), F.col("_t").alias(f"_{x}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def keep_one(docs: DataFrame, limit: int = 7, shingle: int = 2, k: int = 5, threshold: float = 0.8, leaf: int = 2048, few: int = 8, stars: int = 3, group: int = 2_000, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs``, one for each group of near-duplicates: texts connected by pairs that have at least
    ``threshold`` of their shingles of ``k`` words in common, each such pair. SimHash proposes: fingerprints over runs of
    ``shingle`` words (shorter runs move fewer bits for a changed word) that differ in at most ``limit`` bits; the pairs are
    verified.

    A group that is proposed isn't verified pair by pair, which would cost its square: of fingerprints that hang together
    in a node of the index, all links are verified up to ``few`` of them; in a larger group, the links of each to
    ``stars`` others, in each node. Different texts of one fingerprint are compared with one of them. What is not
    connected by these, in large groups or as the fingerprints differ by more, is found by ``missed`` and verified too.

    Of a group, the row of the smallest doc_id stays (those without come last; then the least MD5 of the text; of
    several rows equal in both, the one whose columns are least, in their order). Null texts count as empty, and texts
    without words are near-duplicates of each other. No text is shuffled but those of proposed pairs, unless more than
    ``broadcast_rows`` texts have copies or are dropped.
    """
    read = docs.select("doc_id", "text")
    slim = settle(fingerprints(read.withColumn("_t", _print()), "text", shingle).groupBy("_t", "doc_id").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")))
    texts = slim.groupBy("_t").agg(F.min("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("_k"), F.count(F.lit(1)).alias("_docs"))
    texts = settle(texts.select("_t", "fp", F.col("_k.doc_id").alias("_first"), F.col("_k.n").alias("_rows"), "_docs"))
    reps = settle(texts.groupBy("fp").agg(F.min("_t").alias("rep")))

    def named(pairs: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("fp").alias(x), F.col("rep").alias(f"_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))

    same = texts.join(reps, "fp").where("_t <> rep").select(F.least("_t", "rep").alias("a"), F.greatest("_t", "rep").alias("b"))
    proposed = settle(named(links(reps.select("fp"), limit, leaf, few, stars)).unionByName(same))
    near = settle(verified(proposed, texts, read, k, threshold, broadcast_rows))
    of = components(near)
    more = settle(missed(read, texts, of, k, threshold, group, broadcast_rows))
    if not more.isEmpty():
        of = components(near.unionByName(more))
    mine = texts.join(of, texts["_t"] == of["node"], "left").withColumn("_class", F.coalesce("component", "_t"))
    firsts = mine.groupBy("_class").agg(F.min(F.struct(F.col("_first").isNull().alias("none"), "_first", "_t")).alias("_k"))
    # what is to be dropped: texts of which none stays, and rows of those that stay but are there several times
    judged = mine.join(firsts, "_class").select("_t", "_first", "_rows", "_docs", (F.col("_t") == F.col("_k._t")).alias("_stays"))
    table = settle(judged.where("NOT _stays OR _docs > 1 OR _rows > 1").select(F.col("_t").alias("_w"), "_first", "_rows", "_stays"))
    few = F.broadcast if table.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda x: x
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), "doc_id", _print().alias("_t"))
    rows = rows.join(few(table), F.col("_t") == F.col("_w"), "left").where(F.col("_w").isNull() | (F.col("_stays") & F.col("doc_id").eqNullSafe(F.col("_first"))))
    once = rows.where("_w IS NULL OR _rows = 1").select("_all")
    if table.where("_stays AND _rows > 1").isEmpty():
        return once.select(*(F.col("_all")[c].alias(c) for c in docs.columns))
    several = rows.where("_rows > 1").groupBy("doc_id", "_t").agg(F.min("_all").alias("_all")).select("_all")
    return once.unionByName(several).select(*(F.col("_all")[c].alias(c) for c in docs.columns))
