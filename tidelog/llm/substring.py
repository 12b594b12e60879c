"""Substring dedup by seed and extend, over runs of words.

A window is ``length`` consecutive words of one document; a window is repeated if its words also start earlier
(in a smaller doc_id, or earlier in the same document). Every word under a repeated window goes.

Seeds are winnowed anchors: of the hashes of ``seed_words`` words that start in a window, the least (the leftmost of
equals). Equal windows have equal anchors at equal places, so whatever is repeated shares an anchor, and about one
word in seven begins one. A first pass counts the places of each anchor; a second gives each place of an anchor with
two or more its context, the words on both sides that the windows with this anchor reach. Places with equal anchors are brought
together, and there each is extended both ways: every way to take ``i`` words to the left of the seed and the rest
of a window to the right is compared, word for word, with what earlier places have there. Matches that overlap or
touch form the maximal repeats, which are cut from the text. All that removes a word is a comparison of words; hashes
only propose.

What bounds it: a task holds a chunk of ``chunk_words`` words, or one longer document. Places with the same context
in a chunk are settled there and one goes on, so a passage that very many documents share comes to one row for each
chunk. Places are compared in groups of at most ``group`` at a time; an anchor with more places than that (or, straight
away, one of the at most ``max_hot`` that have the largest counts) is told apart further, by the extended windows
themselves: their first places are found by a minimum that combines before it shuffles, and joined back. Anchors of
two places or more are marked in a bit table sized by their number and broadcast, up to ``max_bits``; beyond that,
the places are joined with the anchors instead.

Defined results: null texts have no words; texts shorter than a window lose nothing; rows equal in doc_id and text
are one document (each gets its result); different texts under one doc_id, and documents without a doc_id (which
come last), are ordered by a hash of the text; further columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_LAST = (1 << 63) - 1
_CACHED = 120_000
#: A row has a place (anchor, words from ``a`` to ``b``), a window (words), or a run of words to remove.
_ROWS = pa.schema([("anchor", pa.int64()), ("_d", pa.int64()), ("_t", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("words", pa.binary())])
_ROWS_SQL = "anchor long, _d long, _t long, a int, b int, words binary"


class _Words(dict):
    """Numbers words as they come; ``names`` and ``hashes`` by number."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return i


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """For each start, a hash of ``n`` values in a row: a polynomial modulo 2^64, mixed."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _A
        out += h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= _C
    out ^= out >> np.uint64(32)
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the minimum of ``n`` values in a row is, for each start; the leftmost of equals."""
    at, have = np.arange(len(x), dtype=np.int32), 1
    while have < n:
        step = min(have, n - have)
        left, right = at[: len(at) - step], at[step:]
        at, have = np.where(x[right] < x[left], right, left), have + step
    return at


class Chunk:
    """Some documents as numbers of words: ``no``; and, in flat positions, the places of their anchors: ``at``, with the
    words from ``a`` to before ``b`` as their contexts: those of the windows that have this anchor, a run of starts."""

    def __init__(self, docs: list[np.ndarray], ids: list[int], ties: list[int], words: _Words, length: int, seed: int) -> None:
        self.ids, self.ties, self.names, self.length, self.seed = np.array(ids, np.int64), np.array(ties, np.int64), words.names, length, seed
        self.no = np.concatenate(docs)
        self.h = np.array(words.hashes, np.uint64)[self.no]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.begin = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        seeds = _runs(self.h, seed)
        inside = doc[: len(doc) - length + 1] == doc[length - 1 :]
        start, at = np.flatnonzero(inside), _least(seeds, length - seed + 1)[inside]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        self.at, self.a, self.b = at[cut], start[cut], start[np.append(cut[1:], len(at))[: len(cut)] - 1] + length
        self.anchor = seeds[self.at].view(np.int64)
        self.doc = doc[self.at]

    def settled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the places ``some`` (a mask): the context of each, from ``a`` to ``b``; those to compare further, in
        the order of documents; and those whose context is an earlier one's in this chunk."""
        at, doc, a, b = self.at[some], self.doc[some], self.a[some], self.b[some]
        powers = np.cumprod(np.full(len(self.h), _B))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.h * powers)))
        back = np.cumprod(np.full(len(self.h), _B_INVERSE))
        key = (sums[b] - sums[a]) * back[a] + (at - a).astype(np.uint64) * _C
        place = np.lexsort((self.ties, self.ids))
        rank = np.empty(len(self.ids), np.int64)
        rank[place] = np.cumsum(np.concatenate(([0], (np.diff(self.ids[place]) != 0) | (np.diff(self.ties[place]) != 0))))
        order = np.lexsort((a - self.begin[doc], rank[doc], key))
        new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, bool)
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        # equal keys only propose: the words are compared
        same = (b - a)[order] == (b - a)[lead]
        for i in range(2 * self.length - self.seed):
            x, y = np.minimum(a[order] + i, b[order] - 1), np.minimum(a[lead] + i, b[lead] - 1)
            same &= self.no[x] == self.no[y]
        earlier = (rank[doc[order]] != rank[doc[lead]]) | ((a - self.begin[doc])[order] != (a - self.begin[doc])[lead])
        go_on = order[new | ~same]
        return a, b, go_on[np.lexsort((a[go_on] - self.begin[doc[go_on]], rank[doc[go_on]]))], np.sort(order[same & earlier])


def _chunks(batches: Iterator[pa.RecordBatch], length: int, seed: int, size: int) -> Iterator[tuple[Chunk, list]]:
    """Chunks, and what the documents in each have in the column ``marked``, if there is one."""
    words, docs, ids, ties, marked, n = _Words(), [], [], [], [], 0
    for batch in batches:
        marks = batch.column("marked") if "marked" in batch.schema.names else [None] * len(batch)
        for d, t, text, m in zip(batch.column("_d").to_pylist(), batch.column("_t").to_pylist(), batch.column("text"), marks, strict=True):
            w = (text.as_py() or "").encode().split()
            if len(w) < length:
                continue
            docs.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)))
            ids.append(d)
            ties.append(t)
            marked.append(m)
            n += len(w)
            if n >= size:
                yield Chunk(docs, ids, ties, words, length, seed), marked
                docs, ids, ties, marked, n = [], [], [], [], 0
                if len(words) >= _CACHED:
                    words = _Words()
    if docs:
        yield Chunk(docs, ids, ties, words, length, seed), marked


def extend(places: Iterable[tuple[int, int, int, list[bytes]]], length: int) -> tuple[list[tuple[int, int, int, int]], dict[tuple[bytes, ...], tuple[int, int, int]]]:
    """Extends the places ``(_d, _t, a, words)`` of one anchor, in the order of documents, both ways: the runs of words
    that an earlier place has too, and the first place of every window."""
    first: dict[tuple[bytes, ...], tuple[int, int, int]] = {}
    runs = []
    for d, t, a, w in places:
        begin = end = -1
        for s in range(len(w) - length + 1):  # from the farthest to the left to the farthest to the right
            mine = (d, t, a + s)
            if first.setdefault(tuple(w[s : s + length]), mine) != mine:
                if s > end:
                    if begin >= 0:
                        runs.append((d, t, a + begin, a + end))
                    begin = s
                end = s + length
        if begin >= 0:
            runs.append((d, t, a + begin, a + end))
    return runs, first


def _batches(rows: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS, strict=True)], schema=_ROWS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _windows(first: dict[tuple[bytes, ...], tuple[int, int, int]], length: int) -> Iterator[tuple]:
    return ((None, d, t, a, a + length, b" ".join(w)) for w, (d, t, a) in first.items())


def mark(anchors: DataFrame, bits: int, slices: int = 64) -> np.ndarray:
    """A table of ``bits`` bits with those of the given anchors set; each slice of it is filled by one task."""
    width = bits // slices

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            for s in np.unique(at // width).tolist():
                mine = at[at // width == s] - s * width
                held.setdefault(s, np.zeros(width, bool))[mine] = True
        for s, x in held.items():
            yield pa.RecordBatch.from_pydict({"slice": [s], "data": [np.packbits(x, bitorder="little").tobytes()]}, pa.schema([("slice", pa.int64()), ("data", pa.binary())]))

    bit = anchors.select(F.pmod("anchor", F.lit(bits)).alias("bit")).withColumn("s", F.expr(f"bit div {width}L"))
    table = np.zeros(bits // 8, np.uint8)
    for r in bit.repartition(slices, "s").select("bit").mapInArrow(fill, "slice long, data binary").toLocalIterator():
        table[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r["data"], np.uint8)
    return table


def repeats(docs: DataFrame, length: int = 20, seed_words: int = 8, chunk_words: int = 200_000, max_bits: int = 1 << 30, group: int = 2_000, max_hot: int = 10_000, least_hot: int = 20_000) -> DataFrame:
    """``(_d, _t, a, b)`` of ``docs (_d, _t, text)``: runs of words, from ``a`` to before ``b``, under repeated windows;
    they may overlap."""
    sc = docs.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches, length, seed_words, chunk_words):
            x, n = np.unique(chunk.anchor, return_counts=True)
            for at in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]), pa.array(n[at : at + 50_000].astype(np.int32))], names=["anchor", "n"])

    twice = settle(docs.mapInArrow(count, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    n, places = twice.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # anchors with more than their share of the places: at most max_hot
    hot = sc.broadcast(np.sort(twice.where(F.col("n") > max(least_hot, places // max_hot)).select("anchor").toArrow()["anchor"].to_numpy()))
    bits = 1 << max(10, (16 * n - 1).bit_length())
    while bits > max_bits and bits >= 8 * n:
        bits //= 2
    if bits <= max_bits:
        table = sc.broadcast(mark(twice, bits))
        marked = docs
    else:
        table = None

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, _ in _chunks(batches, length, seed_words, chunk_words):
                at = (chunk.at - chunk.begin[chunk.doc]).astype(np.int32)
                for k in range(0, len(at), 50_000):
                    s = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(chunk.anchor[s]), pa.array(chunk.ids[chunk.doc[s]]), pa.array(chunk.ties[chunk.doc[s]]), pa.array(at[s])], names=["anchor", "_d", "_t", "at"])

        found = docs.mapInArrow(every, "anchor long, _d long, _t long, at int").join(twice.select("anchor"), "anchor")
        marked = docs.join(found.groupBy("_d", "_t").agg(F.collect_list("at").alias("marked")), ["_d", "_t"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, marks in _chunks(batches, length, seed_words, chunk_words):
            if table is not None:
                bit = np.mod(chunk.anchor, bits)
                some = (table.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            else:
                wanted = [np.array(m.as_py(), np.int64) + b for m, b in zip(marks, chunk.begin.tolist(), strict=True)]
                some = np.isin(chunk.at, np.concatenate(wanted))
            a, b, rest, gone = chunk.settled(some)
            doc, anchor = chunk.doc[some], chunk.anchor[some]
            ids, ties, begin, no, names = chunk.ids, chunk.ties, chunk.begin, chunk.no, chunk.names
            if len(gone):  # their contexts, merged
                cut = np.concatenate(([True], (a[gone][1:] > b[gone][:-1]) | (doc[gone][1:] != doc[gone][:-1])))
                to = np.append(np.flatnonzero(cut)[1:] - 1, len(gone) - 1)
                d = doc[gone][cut]
                nothing = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, pa.array(ids[d]), pa.array(ties[d]), pa.array((a[gone][cut] - begin[d]).astype(np.int32)), pa.array((b[gone][to] - begin[d]).astype(np.int32)), pa.nulls(len(d), pa.binary())], schema=_ROWS)

            def row(i: int) -> tuple:
                d = doc[i]
                return int(anchor[i]), int(ids[d]), int(ties[d]), int(a[i] - begin[d]), int(b[i] - begin[d]), b" ".join([names[k] for k in no[a[i] : b[i]].tolist()])

            large = np.isin(anchor[rest], hot.value)
            yield from _batches(map(row, rest[~large].tolist()))
            # a hot anchor's places meet by their windows, of which one of each goes on
            for _, its in groupby(sorted(map(row, rest[large].tolist())), itemgetter(0)):
                runs, first = extend(((d, t, s, w.split(b" ")) for _, d, t, s, _, w in its), length)
                yield from _batches((None, *r, None) for r in runs)
                yield from _batches(_windows(first, length))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of a partition, sorted; at most ``group`` of an anchor at a time."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def out() -> Iterator[tuple]:
            for anchor, its in groupby(rows(), itemgetter(0)):
                if anchor is None:  # settled runs, and windows
                    yield from its
                    continue
                whole = True
                while held := list(islice(its, group)):
                    whole &= len(held) < group
                    if whole and len(held) == 1:
                        continue
                    runs, first = extend(((d, t, s, w.split(b" ")) for _, d, t, s, _, w in held), length)
                    yield from ((None, *r, None) for r in runs)
                    if not whole:
                        yield from _windows(first, length)

        yield from _batches(out())

    # rows without an anchor are spread out, and pass
    salt = F.coalesce(F.col("anchor"), F.xxhash64("_d", "_t", "a"))
    met = marked.mapInArrow(contexts, _ROWS_SQL).withColumn("_p", salt).repartition("_p").sortWithinPartitions("anchor", "_d", "_t", "a").drop("_p")
    met = settle(met.mapInArrow(meet, _ROWS_SQL).drop("anchor"))
    windows = met.where("words IS NOT NULL").withColumn("at", F.struct("_d", "_t", "a", "b")).select("words", "at")
    firsts = windows.groupBy("words").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = windows.join(firsts, "words").where("at <> first").select("at.*")
    return met.where("words IS NULL").drop("words").unionByName(late)


def cut_repeats(docs: DataFrame, length: int = 20, seed_words: int = 8, broadcast_spans: int = 1_000_000, **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by a space).

    Up to ``broadcast_spans`` maximal repeats are broadcast to the texts; more are joined, and the texts shuffled for it."""
    ids = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    plain = ids[0] == ids[1] == ids[2]
    tie = F.lit(0).cast("long") if plain else F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != "text")).alias("_rest"), F.coalesce("doc_id", F.lit(_LAST)).alias("_d"), tie.alias("_t"), "text")
    found = repeats(keyed.select("_d", "_t", "text"), length, seed_words, **options)

    @F.arrow_udf("array<int>")
    def maximal(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Runs that overlap or touch, as one: begin and end of each."""
        for begins, ends in batches:
            rows = []
            for a, b in zip(begins, ends, strict=True):
                out: list[int] = []
                for x, y in sorted(zip(a.as_py(), b.as_py(), strict=True)):
                    if out and x <= out[-1]:
                        out[-1] = max(out[-1], y)
                    else:
                        out += (x, y)
                rows.append(out)
            yield pa.array(rows, pa.list_(pa.int32()))

    spans = found.groupBy("_d", "_t").agg(F.collect_list(F.struct("a", "b")).alias("_s"))
    spans = settle(spans.select("_d", "_t", maximal("_s.a", "_s.b").alias("_spans")))
    few = spans.agg(F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()[0] <= 2 * broadcast_spans
    kind = "n_words long, n_removed long, kept string"

    @F.arrow_udf(kind)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        out_type = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for texts, runs in batches:
            rows = []
            for text, its in zip(texts, runs, strict=True):
                words = (text.as_py() or "").encode().split()
                its = its.as_py()
                if its:
                    kept, at = [], 0
                    for a, b in zip(its[::2], its[1::2], strict=True):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    removed = len(words) - len(kept)
                else:
                    kept, removed = words, 0
                rows.append({"n_words": len(words), "n_removed": removed, "kept": b" ".join(kept).decode()})
            yield pa.array(rows, out_type)

    out = keyed.join(F.broadcast(spans) if few else spans, ["_d", "_t"], "left").select("_rest", "text", apply("text", "_spans").alias("_x"))
    return out.select(*(F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in columns), "_x.*")


def digest(docs: DataFrame) -> DataFrame:
    out = cut_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
