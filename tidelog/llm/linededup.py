"""Fuzzy line dedup by MinHash.

Lines are the parts of a text between line feeds, compared trimmed and in lower case; blank lines are kept. A
line's shingles are its runs of ``shingle`` characters (a shorter line is its own). A signature has the least shingle
hash in each of 21 orders, in seven bands of three: a pair at a similarity of 0.8 shares a band with a probability of
99.3 %, more similar ones more surely.

Lines that share a band meet in a task and are verified there by the Jaccard similarity of their shingles: first with
one line of the band, then all that are still in different components, each pair in the first band that it shares.
Only links that join two components are given out, so what comes of a band is at most its number of lines, though the
comparisons of lines that are alike but not alike enough grow with their square. Pairs with fewer than 9 equal values
of 21 in their signatures aren't verified (at a similarity of 0.8 that is one in 30,000). Distributed union-find joins
the verified pairs, and of each component the first line is kept (by doc_id, then line number). Links are thus found
with a high probability, that of the signatures whatever the size of a band, and not with certainty; what is removed
is always verified.

What bounds it: a task works on chunks of ``chunk`` characters, or one longer document; equal lines of a chunk are one.
Bands with lines of two kinds are marked in a bit table sized by their number, broadcast up to ``max_bits``; beyond,
the lines are joined with them. A band with more than ``group`` lines is cut into blocks, and every pair of blocks is a
group of its own, so no task gets a large band whole.

This is not in DataFrame functions alone: in that form the verification of pairs by higher-order functions took most of
the time, and the pairs were rows (README has the figures). No user function is called for a row.

Defined results: null texts have one blank line; documents without a doc_id come last; rows equal in doc_id and
text are one document; lines are told apart by a 64-bit hash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, settle
from .components import components
from .substring import mark

_LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(line: str) -> str:
    return line.strip(SPACES).lower()


def line_hash(norm: str) -> int:
    return xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(norm: str, k: int) -> set[str]:
    return {norm[i : i + k] for i in range(max(1, len(norm) - k + 1))}


def packed_shingles(norm: str, k: int) -> set[int] | None:
    """The same as numbers, where ``k`` characters make one of eight bytes; None elsewhere."""
    if k != 8 or len(norm) < 8:
        return None
    try:
        x = norm.encode("latin-1")
    except UnicodeEncodeError:
        return None
    n = len(x) - 7
    return set(np.concatenate([np.frombuffer(x, "<u8", (n - i + 7) // 8, i) for i in range(min(8, n))]).tolist())


def shingle_hashes(norms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all lines, in UTF-16 units, and where each line's begin. A line shorter than ``k``
    is filled up."""
    units = [x.encode("utf-16-le", "surrogatepass").ljust(2 * k, b"\xff") for x in norms]
    sizes = np.fromiter(map(len, units), np.int64, len(units)) // 2
    flat = np.frombuffer(b"".join(units), np.uint16).astype(np.uint32)
    h = flat[: len(flat) - k + 1].copy()
    for i in range(1, k):
        h *= np.uint32(0x9E3779B1)
        h += flat[i : len(flat) - k + 1 + i]
    inside = np.ones(len(flat), bool)  # less the starts at the end of each line
    ends = np.cumsum(sizes)
    for i in range(1, k):
        inside[ends - i] = False
    h = h[inside[: len(h)]]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(16)
    counts = sizes - k + 1
    return h, np.cumsum(counts) - counts


class Signatures:
    """MinHash signatures of lines, and their bands."""

    def __init__(self, rows: int, n_bands: int) -> None:
        self.rows, self.n_bands = rows, n_bands
        # fixed by a rule: the constants that make one hash into many orders
        self.orders = [np.uint32(xxhash.xxh32_intdigest(k.to_bytes(4, "big"))) for k in range(rows * n_bands)]

    def of(self, norms: list[str], k: int) -> np.ndarray:
        h, begin = shingle_hashes(norms, k)
        return np.stack([np.minimum.reduceat(h ^ c, begin) for c in self.orders], axis=1)

    def bands(self, signs: np.ndarray) -> np.ndarray:
        """A key for each band of each signature, which no two bands share but by chance."""
        out = np.empty((len(signs), self.n_bands), np.uint64)
        for b in range(self.n_bands):
            x = np.full(len(signs), b + 1, np.uint64)
            for r in range(self.rows):
                x = _mixed(x * _A + signs[:, b * self.rows + r])
            out[:, b] = x
        return out.view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    for batch in batches:
        for d, t, text in zip(batch.column("_d").to_pylist(), batch.column("_t").to_pylist(), batch.column("text"), strict=True):
            yield d, t, text.as_py() or ""


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[str]]:
    """The different lines of some documents, without the blank one."""
    seen: dict[str, None] = {}
    n = 0
    for _, _, text in _texts(batches):
        seen.update(dict.fromkeys(map(normal, text.split("\n"))))
        n += len(text)
        if n >= size:
            seen.pop("", None)
            if seen:
                yield list(seen)
            seen, n = {}, 0
    seen.pop("", None)
    if seen:
        yield list(seen)


def occurrences(docs: DataFrame) -> DataFrame:
    """``(_d, _t, line_no, lid)`` of ``docs (_d, _t, text)``, without blank lines."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["_d", "_t", "line_no", "lid"])

        for d, t, text in _texts(batches):
            rows += [(d, t, i, line_hash(x)) for i, x in enumerate(map(normal, text.split("\n"))) if x]
            if len(rows) >= 50_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return docs.mapInArrow(split, "_d long, _t long, line_no int, lid long")


def linked(lids: list[int], norms: list[str], place: list[int] | None, signs: np.ndarray, bands: np.ndarray, band: int, shingle: int, threshold: float, least_alike: int) -> list[tuple[int, int]]:
    """Links that join the lines of one group as all its verified pairs do. ``place``: the block of each line, of which
    only lines of different blocks are compared; None if all are."""
    n = len(lids)
    sets: dict[int, set | None] = {}
    first = bands[0].tolist()
    mine = first.index(band)
    if n == 2:  # most groups
        if first[:mine] and any(map(eq, first[:mine], bands[1].tolist())) or np.count_nonzero(signs[0] == signs[1]) < least_alike:
            return []
    comp, links = np.arange(n), []
    side = np.array(place) if place is not None else None

    def of(i: int) -> set | None:
        if i not in sets:
            sets[i] = packed_shingles(norms[i], shingle)
        return sets[i]

    def verify(i: int, j: int) -> None:
        a, b = of(i), of(j)
        if a is None or b is None:
            a, b = shingles(norms[i], shingle), shingles(norms[j], shingle)
        if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
            return
        both = len(a & b)
        if both >= threshold * (len(a) + len(b) - both) - 1e-9:
            links.append((lids[i], lids[j]))
            comp[comp == comp[j]] = comp[i]

    if n == 2:
        if side is None or side[0] != side[1]:
            verify(0, 1)
        return links
    for i in range(n - 1):
        rest = slice(i + 1, n)
        some = (comp[rest] != comp[i]) & ((signs[rest] == signs[i]).sum(axis=1) >= least_alike)
        if mine:  # what shares an earlier band meets there
            some &= ~(bands[rest, :mine] == bands[i, :mine]).any(axis=1)
        if side is not None:
            some &= side[rest] != side[i]
        for j in (np.flatnonzero(some) + i + 1).tolist():
            if comp[j] != comp[i]:
                verify(i, j)
    return links


def line_links(docs: DataFrame, shingle: int = 8, rows: int = 3, n_bands: int = 7, threshold: float = 0.8, least_alike: int = 9, chunk: int = 2_000_000, group: int = 2_000, max_bits: int = 1 << 30, broadcast_rows: int = 200_000) -> DataFrame:
    """``(a, b)``: verified pairs of line hashes that connect the near-duplicate lines of ``docs (_d, _t, text)``."""
    sign = Signatures(rows, n_bands)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for norms in _chunks(batches, chunk):
            lids = np.fromiter(map(line_hash, norms), np.int64, len(norms))
            bands = sign.bands(sign.of(norms, shingle)).reshape(-1)
            lids = np.repeat(lids, n_bands)
            for at in range(0, len(bands), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(bands[at : at + 50_000]), pa.array(lids[at : at + 50_000])], names=["band", "lid"])

    met = docs.mapInArrow(keys, "band long, lid long").groupBy("band").agg(F.min("lid").alias("a"), F.max("lid").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = settle(met.where("a <> b").select("band", "n"))
    n, most = shared.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    bits = 1 << max(10, (64 * n - 1).bit_length())
    while bits > max_bits and bits >= 16 * n:
        bits //= 2
    table = docs.sparkSession.sparkContext.broadcast(mark(shared.select(F.col("band").alias("anchor")), bits)) if bits <= max_bits else None
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for norms in _chunks(batches, chunk):
            signs = sign.of(norms, shingle)
            bands = sign.bands(signs)
            if table is None:
                some = np.ones(bands.shape, bool)
            else:
                bit = np.mod(bands, bits)
                some = (table.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            line, b = np.nonzero(some)
            for at in range(0, len(line), 5_000):
                x = line[at : at + 5_000].tolist()
                columns = [bands[line[at : at + 5_000], b[at : at + 5_000]], [line_hash(norms[i]) for i in x], [signs[i].tobytes() for i in x], [norms[i] for i in x]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["band", "lid", "signs", "norm"])

    found = docs.mapInArrow(lines, "band long, lid long, signs binary, norm string")
    if table is None:
        found = found.join(shared.select("band"), "band", "left_semi")
    found = found.withColumns({"i": F.lit(0), "j": F.lit(0), "place": F.lit(0)})
    if most > group:  # every pair of blocks of a large band is a group
        large = shared.where(F.col("n") > group).select("band", F.ceil(F.col("n") / group).cast("int").alias("blocks"))
        large = F.broadcast(large) if large.limit(broadcast_rows + 1).count() <= broadcast_rows else large
        at = F.pmod(F.xxhash64("lid"), F.coalesce("blocks", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        found = found.join(large, "band", "left").withColumn("place", at).withColumn("_other", other)
        found = found.withColumns({"i": F.least("place", "_other"), "j": F.greatest("place", "_other")})
    found = found.select("band", "i", "j", "lid", "place", "signs", "norm")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
                signs = np.frombuffer(b"".join(columns["signs"]), np.uint32).reshape(len(batch), -1)
                yield from zip(columns["band"], columns["i"], columns["j"], columns["lid"], columns["place"], columns["norm"], signs, sign.bands(signs), strict=True)

        links: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            a, b = zip(*links, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for (band, i, j), its in groupby(rows(), itemgetter(0, 1, 2)):
            once = {r[3]: r for r in its}  # the same line comes from several chunks
            if len(once) < 2:
                continue
            _, _, _, lids, place, norms, signs, bands = zip(*once.values(), strict=True)
            links += linked(list(lids), list(norms), list(place) if i != j else None, np.array(signs), np.array(bands), band, shingle, threshold, least_alike)
            if len(links) >= 50_000:
                yield out()
                links.clear()
        if links:
            yield out()

    met = found.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "lid")
    return settle(met.mapInArrow(verify, "a long, b long").distinct())


def duplicate_lines(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``n_lines``, and ``(_d, _t, removed)``: the numbers, from 0, of lines that go, by document."""
    ids = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    tie = F.lit(0).cast("long") if ids[0] == ids[1] == ids[2] else F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({"_d": F.coalesce("doc_id", F.lit(_LAST)), "_t": tie})
    texts = keyed.select("_d", "_t", "text")
    slim = settle(occurrences(texts))
    of = components(line_links(texts, **options))
    slim = slim.join(of, F.col("lid") == of["node"], "left").select(F.struct("_d", "_t", "line_no").alias("at"), F.coalesce("component", "lid").alias("class"))
    first = settle(slim.groupBy("class").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    gone = slim.join(first, "class").where(F.col("at") != F.col("first"))
    gone = gone.groupBy(F.col("at._d").alias("_d"), F.col("at._t").alias("_t")).agg(F.sort_array(F.collect_set("at.line_no")).alias("removed"))
    out = keyed.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    return out, gone


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` less the lines that go, ``n_lines`` and ``removed``. Other columns stay; those named like the
    results are replaced."""
    rest = [c for c in docs.columns if c not in ("n_lines", "removed")]
    out, gone = duplicate_lines(docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), "doc_id", "text"), **options)
    joined = out.join(gone, ["_d", "_t"], "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), i))
    text = F.array_join(kept, "\n").alias("text")
    return joined.select(*(text if c == "text" else F.col("_row")[c].alias(c) for c in rest), "n_lines", "removed")


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its lines, and the numbers of those that go. No text is shuffled for it but that of lines that
    share a band."""
    out, gone = duplicate_lines(docs.select("doc_id", "text"), **options)
    joined = out.drop("text").join(gone, ["_d", "_t"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))
