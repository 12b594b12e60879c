"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of each source are cut into equal blocks. The blocks of the mix go to the sources by highest quotients
(target over 1, 3, 5, ...), the blocks of a source go to its shards likewise, and each shard fills its quota with
blocks of a seeded order of its documents: whole passes over the shard first, then a run of blocks from a seeded
start, round the end. A document takes the words of its that lie in chosen blocks.

Sources, their sizes and the shards are tables of bounded size (``max_sources``, ``max_shards``); only these come
to the driver. Documents are ordered inside a shard, which holds some 16,000 words, or one part in ``max_shards`` of
all if that is more, so that no task grows with a source. More than ``max_sources`` sources are refused.

Defined results: null and blank texts have size 0 and are not taken; a null source is a source (last in order);
repeated rows are documents of their own; an empty table gives an empty mix. Reruns give the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settle


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """``share`` of all sizes by weight; none above ``cap`` times its size, the excess dealt again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(shares: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients share / (2k + 1); ties go to the first."""
    w = np.asarray(shares, dtype=float)
    if seats <= 0 or w.sum() <= 0:
        return [0] * len(w)
    low, high = 0.0, 2.0 * seats / w.sum() + 1.0
    for _ in range(60):  # the largest scale at which rounding gives at most the seats
        mid = (low + high) / 2
        if np.floor(w * mid + 0.5).sum() <= seats:
            low = mid
        else:
            high = mid
    got = np.floor(w * low + 0.5).astype(np.int64)
    heap = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(w.tolist(), got.tolist(), strict=True)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-w[i] / (2 * got[i] + 1), i))
    return got.tolist()


def mix(df: DataFrame, size: str = "size", source: str = "source", order: Sequence[str] = ("doc_id",), cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 11, max_sources: int = 100_000, max_shards: int = 100_000, shard_words: int = 16_384, blocks: int = 1024) -> DataFrame:
    """``df`` with ``source_size``, ``target`` (both of the row's source) and ``taken`` (words, with repeats).

    Weights repeat ``cycle`` over the sources by code point, null last. ``df`` is read three times, but for its
    last use only ``size``, ``source`` and ``order`` of it.
    """
    spark, keys = df.sparkSession, [f"_o{k}" for k in range(len(order))]
    # columns of the caller's are kept in a struct, so that none can clash with those used here
    kept = [c for c in df.columns if c not in ("source_size", "target", "taken")]
    slim = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{size}`").alias("_size"), F.col(f"`{source}`").alias("_in"), *(F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)))
    found = slim.groupBy("_in").agg(F.sum("_size").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or group them first")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in found], [int(r["n"] or 0) for r in found]
    goal = targets(sizes, [cycle[i % len(cycle)] for i in range(len(names))], share, cap)
    each = max(shard_words, -(-sum(sizes) // max_shards))
    parts = [max(1, n // each) for n in sizes]
    plan = spark.createDataFrame([(names[i], i, parts[i], sizes[i], goal[i]) for i in range(len(names))], "_source string, _no int, _parts int, source_size long, target double")
    rows = slim.join(F.broadcast(plan), F.col("_in").eqNullSafe(F.col("_source"))).drop("_source", "_in").withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("_parts")).cast("int")).drop("_parts")
    held = rows.groupBy("_no", "_shard").agg(F.sum("_size").alias("n")).collect()
    held.sort(key=lambda r: (r["_no"], r["_shard"]))
    block = max(1, each // blocks)
    quota = sainte_lague(goal, round(sum(goal) / block))
    shards, rng = [], np.random.default_rng(seed)
    by_no: dict[int, list] = {}
    for r in held:
        by_no.setdefault(r["_no"], []).append(r)
    for no, its in sorted(by_no.items()):
        for r, q in zip(its, sainte_lague([x["n"] for x in its], quota[no]), strict=True):
            n = int(r["n"])
            m = max(1, round(n / block))
            q = min(q, cap * m)
            passes, run, first = q // m, q % m, int(rng.integers(m))
            a, b = first * n // m, (first + run) * n // m  # in words; beyond n it goes on from the start
            shards.append((no, r["_shard"], passes, a, min(b, n), ((first + run - m) * n // m) if first + run > m else 0))
    chosen = spark.createDataFrame(shards, "_no int, _shard int, _passes int, _a long, _b long, _c long")
    line = Window.partitionBy("_no", "_shard").orderBy("_h", *keys, "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_end", F.sum("_size").over(line)).join(F.broadcast(chosen), ["_no", "_shard"])
    start = F.col("_end") - F.col("_size")
    part = F.greatest(F.lit(0), F.least("_end", "_b") - F.greatest(start, F.col("_a"))) + F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_c")) - start)
    taken = (F.col("_passes") * F.col("_size") + part).cast("long")
    return out.select(*(F.col("_row")[c].alias(c) for c in kept), "source_size", "target", taken.alias("taken"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """Sizes, targets and what the mix takes of each document. Texts are read once and never shuffled."""
    slim = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(slim, **options).select("doc_id", "source", "size", "source_size", "target", "taken")


def resample(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents of the mix, whole, with their columns: as many copies as ``taken`` has of the size, rounded.

    Only documents at the ends of a run of blocks are taken in part, so rounding moves a shard by a document.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), F.col("doc_id"), F.col("source"), n_words(F.col(text)).alias("size"))
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    out = mix(rows, **options).withColumn("_copies", copies).where("_copies > 0").select("_all", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return out.select(*(F.col("_all")[c].alias(c) for c in docs.columns))
