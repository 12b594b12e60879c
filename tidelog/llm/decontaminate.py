"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A shingle is five words of the lower-cased text, joined by a space (fewer words: the whole sequence). A document
is contaminated by an item if it holds at least ``threshold`` of the item's distinct shingles.

Items are the queries. Each is indexed under its smallest shingle hashes (its bottom-k MinHash sketch). How many
depends on its size: with n distinct shingles, of which ceil(threshold * n) must be found, at most
n - ceil(threshold * n) may be missing, so one more than that can't all be missing from a contaminated document:
the search loses nothing. A size partition (a power of two of shingles) shares the sketch length its largest
member needs and the least document size its smallest member allows. Every document's hashes are looked up in the
index; the hits come down to one for each document and item, and a text that was found is verified once against its
items: its shingles that an item has too are told by hash and SHA-256, and counted. So the work for a document grows
with its length, however often it repeats an item. No text is shuffled while the texts found are few enough to
broadcast their checksums (``broadcast_rows``); beyond, only the search hits' texts are.

The index has rows of fixed size and is broadcast in blocks of about ``block_rows``; each further block reads the
documents again.

Defined results: null and blank items match nothing, null and blank documents hold nothing; equal items with
different ids are reported one by one; repeated document rows give one row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, trimmed, words


def _at(w: str, i: Column, k: int) -> list[Column]:
    return [F.get(w, i + j) for j in range(k)]


def shingles(w: str, k: int = 5) -> Column:
    """The shingles of word array ``w`` in order, as strings."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *_at(w, i, k)))
    return F.when(n >= k, runs).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def hashes(w: str, k: int = 5) -> Column:
    """A 64-bit hash for each of the shingles."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*_at(w, i, k)))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " "), F.lit("whole")))).otherwise(F.array().cast("array<bigint>"))


def index(items: DataFrame, threshold: float, k: int) -> DataFrame:
    """``(_item, item_id, n_shingles, _need, _least, _sketch, _w)``, settled: a row for each item that has words."""
    w = items.where(trimmed(F.col("text")) != "").select("item_id", words(F.lower("text")).alias("_w"))
    s = w.select("item_id", "_w", F.sort_array(F.array_distinct(hashes("_w", k))).alias("_hashes"), F.size(F.array_distinct(shingles("_w", k))).alias("n_shingles"))
    part = F.floor(F.log2(F.col("n_shingles").cast("double")) + 1e-9)
    low, high = F.pow(F.lit(2.0), part), F.pow(F.lit(2.0), part + 1) - 1
    need = lambda n: F.ceil(n * threshold - 1e-9).cast("int")
    # n - need(n) doesn't fall as n grows, so the largest size of a partition needs the longest sketch
    s = s.withColumns({"_need": need(F.col("n_shingles")), "_least": need(low), "_sketch": F.slice("_hashes", F.lit(1), (high - need(high) + 1).cast("int"))})
    return settle(s.drop("_hashes").withColumn("_item", F.monotonically_increasing_id()))


def _starts(read: DataFrame, k: int) -> DataFrame:
    """``read (..., _w)`` with ``_key``, the hash of a shingle: a row for each start. Unlike higher-order functions, this
    is compiled, with the join that follows."""
    starts = read.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - k, F.lit(0)))).alias("_i"))
    short = F.xxhash64(F.array_join("_w", " "), F.lit("whole"))
    return starts.withColumn("_key", F.when(F.size("_w") >= k, F.xxhash64(*_at("_w", F.col("_i"), k))).otherwise(short))


def _in_blocks(rows: DataFrame, keys: DataFrame, n: int, block_rows: int, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Joins all ``rows`` with the ``n`` rows of ``keys``, of which ``block_rows`` or so are broadcast at a time."""
    blocks = max(1, -(-n // block_rows))
    if blocks == 1:
        return join(rows, F.broadcast(keys))
    return reduce(DataFrame.unionByName, [join(rows, F.broadcast(keys.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b))) for b in range(blocks)])


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, block_rows: int = 2_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """``(doc_id, _print, item_id, n_shingles, n_found)``: one row for each document and item it is contaminated by.

    ``_print`` is the MD5 of the text, which tells apart rows that share a doc_id.
    """
    held = index(items.select("item_id", "text"), threshold, k)
    sizes = held.agg(F.coalesce(F.sum(F.size("_sketch")), F.lit(0)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    read = docs.where(trimmed(F.col("text")) != "").select("doc_id", F.md5(F.col("text").cast("binary")).alias("_print"), "text")
    split = lambda df: df.withColumn("_w", words(F.lower("text"))).drop("text")
    # search: what has one of an item's least hashes, once for each document and item
    keys = held.select(F.explode("_sketch").alias("_key"), "_item", "_least")
    hit = lambda rows, keys: rows.join(keys, "_key").where(F.greatest(F.size("_w") - (k - 1), F.lit(1)) >= F.col("_least")).select("doc_id", "_print", "_item")
    hits = settle(_in_blocks(_starts(split(read), k), keys, int(sizes[0]), block_rows, hit).distinct())
    # verification: the distinct shingles of each text and item that were found together, counted
    texts, pairs = settle(hits.select("_print").distinct()), settle(hits.select("_print", "_item").distinct())
    few = F.broadcast if pairs.limit(broadcast_rows + 1).count() <= broadcast_rows else lambda x: x
    runs = F.when(F.size("_w") >= k, F.concat_ws(" ", *_at("_w", F.col("_i"), k))).otherwise(F.array_join("_w", " "))
    digest = F.sha2(runs.cast("binary"), 256)
    whole = _starts(held.select("_item", "_w"), k).select("_item", "_key", digest.alias("_digest")).distinct()
    again = _starts(split(read.join(few(texts), "_print", "left_semi").select("_print", "text")), k)
    same = lambda rows, keys: rows.join(keys, "_key").where(digest == F.col("_digest")).select("_print", "_item", "_digest")
    found = _in_blocks(again, whole, int(sizes[1]), block_rows, same).join(few(pairs), ["_print", "_item"]).distinct()
    found = found.groupBy("_print", "_item").agg(F.count(F.lit(1)).cast("int").alias("n_found"))
    enough = found.join(F.broadcast(held.select("_item", "item_id", "n_shingles", "_need")) if sizes[1] <= block_rows else held.select("_item", "item_id", "n_shingles", "_need"), "_item").where("n_found >= _need")
    enough = settle(enough.select("_print", "_item", "item_id", "n_shingles", "n_found"))
    return hits.join(few(enough), ["_print", "_item"]).select("doc_id", "_print", "item_id", "n_shingles", "n_found").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """The contaminated pairs with the share of the item's shingles found."""
    out = find(docs, items, threshold, k).drop("_print").distinct()
    return out.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns.

    The contaminated texts' checksums are broadcast up to ``broadcast_rows`` of them and joined by a shuffle beyond.
    """
    bad = settle(find(docs, items, threshold, k).select(F.col("_print").alias("_bad")).distinct())
    if bad.limit(broadcast_rows + 1).count() <= broadcast_rows:
        bad = F.broadcast(bad)
    return docs.join(bad, F.md5(F.col("text").cast("binary")) == F.col("_bad"), "left_anti")
