"""Append conditions against a log: one append's, or very many at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import has_all
from ..model import AppendCondition, canonical_tags, unpack_position
from ..plans import match_column, simplify
from .index import subset_key, wanted_entries

#: Rows of a condition table up to which it is broadcast.
BROADCAST_ROWS = 200_000
CONDITIONS = "cond_id long, types array<string>, tags array<string>, after_version long, after_index int"


def exists(log: DataFrame, conditions: Sequence[AppendCondition]) -> bool:
    """Whether an event matches any of the conditions: one scan, which stops at the first."""
    if not conditions:
        return False
    hit = log.where(reduce(or_, (match_column(c.query, c.after) for c in conditions)))
    return bool(hit.select(F.lit(1)).take(1))


def matches(condition: AppendCondition, at: tuple[int, int], type_name: str, tags: Sequence[str]) -> bool:
    """Whether one event violates a condition, without Spark."""
    if condition.after is not None and at <= unpack_position(condition.after):
        return False
    return any((not i.types or type_name in i.types) and set(i.tags) <= set(tags) for i in condition.query.items)


def condition_rows(spark: SparkSession, conditions: Sequence[tuple[int, AppendCondition]]) -> DataFrame:
    """A row for each item; ``after`` as the two numbers of a position, (-1, -1) if none."""
    rows = []
    for cond_id, c in conditions:
        v, i = (-1, -1) if c.after is None else unpack_position(c.after)
        if v >= 1 << 63:
            v, i = (1 << 63) - 1, 65_535
        rows += [(cond_id, list(item.types), list(canonical_tags(item.tags)), v, i) for item in simplify(c.query).items]
    return spark.createDataFrame(rows, CONDITIONS)


def _later() -> object:
    v = F.col("commit_version")
    return (v > F.col("after_version")) | ((v == F.col("after_version")) & (F.col("batch_index") > F.col("after_index")))


def conflicts(log: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(cond_id, n_events)``: the conditions (as ``condition_rows`` gives them) that events match, and how many.

    A join by equality on a key of each item, one of its tags (that the fewest items ask for) or else its type, with the
    rest checked on what meets; the condition side is broadcast, never the log. Beyond ``BROADCAST_ROWS`` rows of
    conditions the subset index does the same without a broadcast.
    """
    if conditions.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return conflicts_indexed(log, conditions)
    asked = conditions.select(F.explode("tags").alias("_tag")).groupBy("_tag").agg(F.count(F.lit(1)).alias("_n"))
    items = conditions.withColumn("_item", F.xxhash64(*conditions.columns))
    rarest = items.select("_item", F.explode("tags").alias("_tag")).join(asked, "_tag").groupBy("_item").agg(F.min(F.struct("_n", "_tag"))["_tag"].alias("_tag"))
    by_tag = items.join(rarest, "_item").withColumn("_key", F.concat(F.lit("tag "), "_tag")).drop("_tag")
    by_type = items.where(F.size("tags") == 0).withColumn("_key", F.explode(F.transform("types", lambda t: F.concat(F.lit("type "), t))))
    keyed = by_tag.unionByName(by_type).drop("_item")
    keys = F.array_append(F.transform(F.array_distinct("tags"), lambda t: F.concat(F.lit("tag "), t)), F.concat(F.lit("type "), "type_name"))
    events = log.select("commit_version", "batch_index", "type_name", F.col("tags").alias("e_tags"), F.explode(keys).alias("_key"))
    hit = events.join(F.broadcast(keyed), "_key").where(_later() & ((F.size("types") == 0) | F.array_contains("types", F.col("type_name"))) & has_all(F.col("e_tags"), F.col("tags")))
    return hit.select("cond_id", "commit_version", "batch_index").distinct().groupBy("cond_id").agg(F.count(F.lit(1)).alias("n_events"))


def conflicts_indexed(log: DataFrame, conditions: DataFrame) -> DataFrame:
    """The same by an equality join on tag subsets. Only subsets that a condition asks for are joined; the hot ones
    are left to adaptive skew joins, as neither side is bounded."""
    wanted = conditions.withColumn("_key", subset_key("tags")).drop("tags")
    entries = wanted_entries(log.select("commit_version", "batch_index", "type_name", "tags"), conditions).drop("tags")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = entries.join(F.broadcast(wanted) if small else wanted, "_key")
    hit = hit.where(_later() & ((F.size("types") == 0) | F.array_contains("types", F.col("type_name"))))
    return hit.select("cond_id", "commit_version", "batch_index").distinct().groupBy("cond_id").agg(F.count(F.lit(1)).alias("n_events"))
