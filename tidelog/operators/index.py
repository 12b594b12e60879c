"""The subset index: a row for each subset of an event's tags, so that "has all of these tags" becomes an equality.

It is not needed for reads (a scan with a filter does those); it serves many conditions at once. Stored by
``build_index``, in buckets of the subset, it serves point reads by tags: ``lookup`` reads one bucket, and of that the
row groups that can hold the subset.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import EventNotFound
from ..functions import canonical_tags, position_hex, tag_subsets
from ..model import canonical_tags as canonical
from ..plans import after_column


def subset_key(tags: Column | str) -> Column:
    """A subset as a string: its tags with their lengths, so that different subsets differ."""
    return F.array_join(F.transform(tags, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")


def subset_index(log: DataFrame, tags: str = "tags") -> DataFrame:
    """``(subset, type_name, commit_version, batch_index)``: at most 1,024 rows for an event."""
    return log.select(F.explode(tag_subsets(tags)).alias("subset"), "type_name", "commit_version", "batch_index")


def wanted_entries(log: DataFrame, wanted: DataFrame, few: int = 1000) -> DataFrame:
    """``log`` with ``_key``: a row for each of its tag subsets that can be one of ``wanted (tags)``.

    Tags that nobody asks for are left out before subsets are formed, so an event has as many rows as the tags that
    are asked for have subsets, not 2^n. ``wanted`` is broadcast by the caller's leave only; its distinct tags are too.
    """
    tags = wanted.select(F.explode("tags").alias("_tag")).distinct().agg(F.array_sort(F.collect_set("_tag")).alias("_asked"))
    some = log.crossJoin(F.broadcast(tags)).withColumn("_some", F.array_intersect(canonical_tags("tags"), "_asked")).drop("_asked")
    return some.select(*log.columns, F.explode(tag_subsets("_some")).alias("_subset")).withColumn("_key", subset_key("_subset")).drop("_subset")


def build_index(log: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes the subset index to ``path``, in folders by a hash of the subset, sorted by subset, type and position."""
    rows = subset_index(log).withColumn("subset_key", subset_key("subset"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("subset_key"), F.lit(buckets)).cast("int")).drop("subset")
    # by key and not by bucket alone: a subset that most events have (the empty one) doesn't meet in one task
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("commit_version"), F.lit(8))).sortWithinPartitions("bucket", "subset_key", "type_name", "commit_version", "batch_index")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, tags: Sequence[str], types: Sequence[str] = (), after: bytes | None = None, buckets: int = 64) -> DataFrame:
    """``(type_name, commit_version, batch_index)`` of the events that have all ``tags`` (and one of ``types``, if there are
    any; and are after a position), from a stored index alone. The bucket is pruned by its folder, the rest is pushed down."""
    key = "".join(f"{len(t)}:{t}" for t in canonical(tags))
    hashed = spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(buckets)).cast("int")).first()[0]
    rows = spark.read.parquet(path).where((F.col("bucket") == hashed) & (F.col("subset_key") == key))
    if types:
        rows = rows.where(F.col("type_name").isin(*types))
    if after is not None:
        rows = rows.where(after_column(after))
    return rows.select("type_name", "commit_version", "batch_index")


def fetch(index: DataFrame, log: DataFrame) -> DataFrame:
    """The index rows with their events. An entry without its event fails the read, with its position."""
    keys = ["commit_version", "batch_index"]
    out = index.drop("type_name").join(log.withColumn("_there", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit(f"{EventNotFound.__name__}: "), position_hex()))
    return out.where(F.when(F.col("_there"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_there")


def fetched(index: DataFrame, log: DataFrame) -> list[Row]:
    """``fetch``, collected; raises ``EventNotFound`` where an entry has no event."""
    try:
        return fetch(index, log).collect()
    except Exception as e:
        if m := re.search(rf"{EventNotFound.__name__}: ([0-9a-f]{{24}})", str(e)):
            raise EventNotFound(m[1]) from e
        raise


def orphans(index: DataFrame, log: DataFrame) -> DataFrame:
    """Index rows without an event."""
    return index.join(log.select("commit_version", "batch_index"), ["commit_version", "batch_index"], "left_anti")


__all__ = ["build_index", "canonical_tags", "fetch", "fetched", "lookup", "orphans", "subset_index", "subset_key", "wanted_entries"]
