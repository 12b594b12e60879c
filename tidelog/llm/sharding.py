"""Proportional stratified interleaving: shards of equal row counts, each with the mixture of the sources.

Rows get a seeded order within their source, the row of rank r among n stands at (2r - 1) / 2n, and the rows of
all sources are cut into runs in the order of these fractions. Every run then has of each source its share, but
for rounding. Law: ``rows`` (counts of any two shards differ by one at most).

Both orders are found without a global sort and without a task that grows with a source: a rank is the number of
rows in the lower buckets of a uniform seeded hash plus the rank inside the bucket; the place in the interleaved
order likewise, over equal slices of the fraction. There are as many buckets and slices as make some ``each`` rows come
to one, so no task grows with a source; only their counts are summed in one place.

Defined results: null sources are a stratum; null texts count as empty; rows with equal order keys (equal id,
size, checksum and source) are interchangeable, so repeated rows are dealt like any others; no rows give no rows.
Input columns stay; ``shard`` and ``slot`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def _offsets(counts: DataFrame, within: list[str], key: str, to: str) -> DataFrame:
    """Adds ``to``: the sum of ``n`` over the rows of ``within`` with a lower ``key``. ``counts`` is small."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return counts.withColumn(to, F.sum("n").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))


def interleave(df: DataFrame, stratum: str, order: list[str], seed: int = 7, each: int = 16_384) -> DataFrame:
    """Adds ``_place`` (1 to the number of rows): the place in the interleaved order; and ``_total``. Columns of ``df`` with
    a leading underscore may be replaced; see ``shard``.

    ``order`` names columns that tell rows of a stratum apart; the seeded hash is over them.
    """
    buckets = slices = max(1, df.count() // each)
    h = F.xxhash64(F.lit(seed), *order)
    rows = df.withColumns({"_h": h, "_bucket": F.pmod(h, F.lit(buckets)).cast("int")})
    key = F.xxhash64(F.col(stratum).isNull(), stratum)
    rows = rows.withColumn("_stratum", key)
    counts = settle(rows.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("_stratum").agg(F.sum("n").alias("_n"))
    starts = _offsets(counts, ["_stratum"], "_bucket", "_before").join(totals, "_stratum").drop("n")
    inside = Window.partitionBy("_stratum", "_bucket").orderBy("_h", *order)
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(starts, ["_stratum", "_bucket"]).withColumn("_r", F.col("_r") + F.col("_before"))
    # (2r - 1) / 2n, and the slice of the unit interval it lies in, in whole numbers
    ranked = ranked.withColumn("_slice", F.expr(f"cast(((2 * _r - 1) * {slices}L) div (2 * _n) as int)")).drop("_bucket", "_before")
    ranked = settle(ranked)
    by_slice = settle(ranked.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")))
    places = _offsets(by_slice, [], "_slice", "_start").withColumn("_total", F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")
    line = Window.partitionBy("_slice").orderBy((2 * F.col("_r") - 1) / (2.0 * F.col("_n")), "_stratum", "_r")
    out = ranked.withColumn("_at", F.row_number().over(line)).join(places, "_slice")
    return out.withColumn("_place", F.col("_at") + F.col("_start")).drop("_at", "_start", "_slice", "_r", "_n", "_h", "_stratum")


def shard(df: DataFrame, shards: int = 16, stratum: str = "source", order: list[str] | None = None, seed: int = 7, each: int = 16_384) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard). ``df`` is read twice."""
    order = order or ["doc_id"]
    kept, keys = [c for c in df.columns if c not in ("shard", "slot")], [f"_o{k}" for k in range(len(order))]
    # columns of the caller's are kept in a struct, so that none can clash with those used here
    slim = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{stratum}`").alias("_in"), *(F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)))
    placed = interleave(slim, "_in", keys, seed, each)
    base, extra = F.expr(f"_total div {shards}"), F.expr(f"_total % {shards}")
    placed = placed.withColumns({"_base": base, "_extra": extra, "_p": F.col("_place") - 1})
    long_rows = F.col("_extra") * (F.col("_base") + 1)
    in_long = F.col("_p") < long_rows
    shard_no = F.when(in_long, F.expr("_p div (_base + 1)")).otherwise(F.col("_extra") + F.expr("(_p - _extra * (_base + 1)) div greatest(_base, 1)"))
    slot = F.when(in_long, F.expr("_p % (_base + 1)")).otherwise(F.expr("(_p - _extra * (_base + 1)) % greatest(_base, 1)"))
    return placed.select(*(F.col("_row")[c].alias(c) for c in kept), shard_no.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def digest(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per document with its size, checksum and place. Texts are read once and never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = settle(docs.select("doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")))
    out = shard(slim, shards, "source", ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
