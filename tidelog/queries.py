"""The registered queries of the event log, over the ``events`` table read as a log, and the SQL that states them.

Eight events make a commit, so positions have batch indexes. Results have scalars only: positions as hex, tags
joined by a bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store_queries
from .functions import canonical_tags, position_hex, position_index, position_version
from .model import AppendCondition, Query, QueryItem, ReadOptions, pack_position
from .operators import conditions, index, reads

PER_COMMIT = 8


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a log frame."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = F.array(F.concat(F.lit("user:"), F.col("user_id")), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")), F.concat(F.lit("day:"), F.date_format("ts", "yyyy-MM-dd")))
    return e.select(F.expr(f"event_id div {PER_COMMIT}").alias("commit_version"), (F.col("event_id") % PER_COMMIT).cast("int").alias("batch_index"), F.col("event_type").alias("type_name"), tags.alias("tags"), F.encode("props", "UTF-8").alias("data"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower(F.hex("position")).alias("position"), "type_name", F.array_join("tags", "|").alias("tags"), F.decode("data", "UTF-8").alias("data"))


def _read(query: Query, options: ReadOptions | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _shown(reads.read(events_log(spark, sf_dir), query, options))


_LOG = """
WITH log AS (
  SELECT event_id // 8 AS v, event_id % 8 AS i, printf('%020x%04x', event_id // 8, event_id % 8) AS position, event_type AS type_name,
         ['user:' || user_id, 'k:' || json_extract_string(props, '$.k'), 'day:' || strftime(ts, '%Y-%m-%d')] AS t, props AS data
  FROM events)
"""


def _sql(where: str = "true", rest: str = "") -> str:
    return f"{_LOG} SELECT position, type_name, array_to_string(t, '|') AS tags, data FROM log WHERE {where} {rest}"


TYPES = Query.of_types("click", "purchase")
TAGS = Query.of_tags("day:2024-01-05", "k:7")
BOTH = Query((QueryItem(("click",), ("user:8",)),))
OR_ITEMS = Query((QueryItem(("click",), ("user:8",)), QueryItem(("error", "view"), ("k:7",))))
OR_MIXED = Query((QueryItem(("purchase",), ("user:3",)), QueryItem((), ("day:2024-01-05", "k:7"))))
TWICE = Query((QueryItem(("click",), ("k:7",)), QueryItem(("click", "click"), ("k:7", "k:7"))))
SUBSUMED = Query((QueryItem((), ("user:8",)), QueryItem(("click",), ("k:7", "user:8"))))
PAGE = ReadOptions(25, pack_position(40, 3))
LATEST = ReadOptions(25, pack_position(40, 3), True)

#: The conditions of the bulk queries; ids repeat for several items.
CONDITIONS = (
    (0, AppendCondition(Query((QueryItem(("click",), ("user:8",)), QueryItem(("nope",), ("user:8",)))))),
    (1, AppendCondition(Query.of_tags("k:7", "day:2024-01-05"))),
    (2, AppendCondition(Query.of_types("nope"))),
    (3, AppendCondition(Query.of_types("view", "error"), pack_position(600, 3))),
    (4, AppendCondition(Query((QueryItem(("click",), ("user:8", "user:8", "k:7")),)))),
    (5, AppendCondition(Query.of_tags("user:9"), b"\xff" * 12)),
)
_CONDITIONS_SQL = """
, c(cond_id, types, tags, v0, i0) AS (VALUES
  (0, ['click'], ['user:8'], -1, -1), (0, ['nope'], ['user:8'], -1, -1), (1, []::VARCHAR[], ['k:7', 'day:2024-01-05'], -1, -1),
  (2, ['nope'], []::VARCHAR[], -1, -1), (3, ['view', 'error'], []::VARCHAR[], 600, 3), (4, ['click'], ['user:8', 'k:7'], -1, -1),
  (5, []::VARCHAR[], ['user:9'], 9223372036854775807, 65535))
"""
_BULK_SQL = f"""{_LOG} {_CONDITIONS_SQL}
SELECT cond_id::BIGINT AS cond_id, count(DISTINCT position)::BIGINT AS n_events FROM log JOIN c
  ON (v > v0 OR (v = v0 AND i > i0)) AND (len(types) = 0 OR list_contains(types, type_name)) AND list_has_all(t, tags)
GROUP BY cond_id
"""
_SUBSETS_SQL = """
, s AS (
  SELECT v, i, type_name, array_to_string(list_sort(list_filter(['', CASE WHEN m & 1 > 0 THEN t[1] END, CASE WHEN m & 2 > 0 THEN t[2] END, CASE WHEN m & 4 > 0 THEN t[3] END], lambda x: x <> '')), '|') AS subset
  FROM log, range(8) r(m))
"""


def _bulk(how: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: how(events_log(spark, sf_dir), conditions.condition_rows(spark, CONDITIONS))


def read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reads.read_all(events_log(spark, sf_dir)))


def type_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.discover_types(events_log(spark, sf_dir), ("user:8",))


def condition_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each condition, from one scan of the log."""
    found = conditions.conflicts(events_log(spark, sf_dir), conditions.condition_rows(spark, CONDITIONS))
    every = spark.createDataFrame([(k,) for k, _ in CONDITIONS], "cond_id long")
    return every.join(F.broadcast(found), "cond_id", "left").select("cond_id", F.col("n_events").isNotNull().alias("violated"))


def conflict_iff_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mechanisms side by side: direct matches, and matches by way of the subset index."""
    log, c = events_log(spark, sf_dir), conditions.condition_rows(spark, CONDITIONS)
    a = conditions.conflicts(log, c).withColumnRenamed("n_events", "n_direct")
    b = conditions.conflicts_indexed(log, c).withColumnRenamed("n_events", "n_indexed")
    out = a.join(b, "cond_id", "full")
    return out.select("cond_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_direct", "n_indexed")), F.coalesce(F.col("n_direct") == F.col("n_indexed"), F.lit(False)).alias("equal"))


def powerset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.subset_index(events_log(spark, sf_dir)).select(F.array_join("subset", "|").alias("subset"), "type_name")
    return rows.groupBy("subset", "type_name").agg(F.count(F.lit(1)).alias("n_events"))


def index_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index rows of one subset and type, after a position."""
    log = events_log(spark, sf_dir).where("type_name = 'click' AND (commit_version > 40 OR (commit_version = 40 AND batch_index > 3))")
    rows = index.wanted_entries(log.drop("data"), spark.createDataFrame([(["k:7"],)], "tags array<string>"))
    return rows.where(F.col("_key") == index.subset_key(F.array(F.lit("k:7")))).select(position_hex().alias("position"), "type_name")


def index_fetch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    rows = index.wanted_entries(log.drop("data"), spark.createDataFrame([(["k:7"],)], "tags array<string>"))
    rows = rows.where(F.col("_key") == index.subset_key(F.array(F.lit("k:7")))).select("type_name", "commit_version", "batch_index")
    return index.fetch(rows, log).select(position_hex().alias("position"), "type_name", F.decode("data", "UTF-8").alias("data"))


def orphan_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows whose event is missing from a log without the commits divisible by ten."""
    log = events_log(spark, sf_dir)
    lost = index.orphans(index.subset_index(log), log.where("commit_version % 10 <> 0"))
    return lost.groupBy("type_name").agg(F.count(F.lit(1)).alias("n_rows"))


def sentinel_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last commit, as the position of its first event, and the last position."""
    log = events_log(spark, sf_dir)
    last = log.agg(F.max(F.struct("commit_version", "batch_index")).alias("m"))
    return last.select(position_hex(F.col("m.commit_version"), F.lit(0)).alias("sentinel"), position_hex(F.col("m.commit_version"), F.col("m.batch_index")).alias("last_position"))


CURSORS = (("a", 100, 3), ("b", 1 << 40, 0), ("c", -1, -1))


def cursor_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after each cursor; all, for one that was never set."""
    cursors = spark.createDataFrame(CURSORS, "name string, v long, i int")
    log = events_log(spark, sf_dir).groupBy("commit_version").agg(F.count(F.lit(1)).alias("n"), F.collect_set("batch_index").alias("at"))
    lag = F.when(F.col("commit_version") > F.col("v"), F.col("n")).when(F.col("commit_version") == F.col("v"), F.size(F.filter("at", lambda x: x > F.col("i")))).otherwise(0)
    return log.join(F.broadcast(cursors), F.col("commit_version") >= F.col("v"), "right").groupBy("name").agg(F.coalesce(F.sum(lag), F.lit(0)).cast("long").alias("n_events"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with a repeat and out of order, as a set and as given."""
    log = events_log(spark, sf_dir).withColumn("tags", F.concat("tags", F.slice("tags", 1, 1)))
    return log.select(position_hex().alias("position"), F.array_join(canonical_tags("tags"), "|").alias("canonical"), F.array_join("tags", "|").alias("stored"))


def position_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions packed to bytes and taken apart again."""
    from .functions import position

    p = events_log(spark, sf_dir).select(position().alias("p"))
    return p.select(F.lower(F.hex("p")).alias("position"), position_version("p").alias("commit_version"), position_index("p").cast("long").alias("batch_index"))


def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions, with the running number of each row as it was returned."""
    rows = []
    for name, options in (("ascending", ReadOptions()), ("descending", ReadOptions(reverse=True))):
        found = reads.read(events_log(spark, sf_dir), OR_ITEMS, options).select(F.lower(F.hex("position")))
        rows += [(name, k, r[0]) for k, r in enumerate(found.toLocalIterator())]
    return spark.createDataFrame(rows, "direction string, number long, position string")


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read by pages: the last position and the count of each page of 40."""
    found = reads.page_rows(events_log(spark, sf_dir), OR_ITEMS, 40)
    rows = [(k, len(page), max(r.position for r in page).hex()) for k, page in enumerate(found)]
    return spark.createDataFrame(rows, "page long, n_events long, last_position string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_all": read_all,
    "read_types": _read(TYPES),
    "read_tags_and": _read(TAGS),
    "read_type_and_tags": _read(BOTH),
    "read_or_items": _read(OR_ITEMS),
    "read_or_mixed": _read(OR_MIXED),
    "read_or_duplicate_items": _read(TWICE),
    "read_or_subsumed": _read(SUBSUMED),
    "read_no_items": _read(Query()),
    "read_after": _read(TYPES, ReadOptions(after=pack_position(40, 3))),
    "read_page": _read(TYPES, PAGE),
    "read_reverse": _read(TAGS, ReadOptions(reverse=True)),
    "read_reverse_limit_after": _read(TYPES, LATEST),
    "read_or_reverse_after_limit": _read(OR_ITEMS, LATEST),
    "read_pages": all_pages,
    "read_order": read_order,
    "type_discovery": type_discovery,
    "condition_exists": condition_exists,
    "conditions_bulk": _bulk(conditions.conflicts),
    "conditions_bulk_indexed": _bulk(conditions.conflicts_indexed),
    "conflict_iff_matches": conflict_iff_matches,
    "powerset_index": powerset_index,
    "index_range_scan": index_range_scan,
    "index_fetch_join": index_fetch_join,
    "orphan_index_rows": orphan_index_rows,
    "sentinel_watermark": sentinel_watermark,
    "cursor_lag": cursor_lag,
    "canonical_tags": canonical,
    "position_codec": position_codec,
}

_OR = "((type_name = 'click' AND list_contains(t, 'user:8')) OR (type_name IN ('error', 'view') AND list_contains(t, 'k:7')))"
_AFTER = "(v > 40 OR (v = 40 AND i > 3))"
ORACLE_SQL: dict[str, str] = {
    "read_all": _sql(),
    "read_types": _sql("type_name IN ('click', 'purchase')"),
    "read_tags_and": _sql("list_has_all(t, ['day:2024-01-05', 'k:7'])"),
    "read_type_and_tags": _sql("type_name = 'click' AND list_contains(t, 'user:8')"),
    "read_or_items": _sql(_OR),
    "read_or_mixed": _sql("(type_name = 'purchase' AND list_contains(t, 'user:3')) OR list_has_all(t, ['day:2024-01-05', 'k:7'])"),
    "read_or_duplicate_items": f"{_LOG}, u AS (SELECT * FROM log WHERE type_name = 'click' AND list_contains(t, 'k:7') UNION SELECT * FROM log WHERE type_name = 'click' AND list_contains(t, 'k:7')) SELECT position, type_name, array_to_string(t, '|') AS tags, data FROM u",
    "read_or_subsumed": _sql("list_contains(t, 'user:8') OR (type_name = 'click' AND list_has_all(t, ['k:7', 'user:8']))"),
    "read_no_items": _sql("false"),
    "read_after": _sql(f"type_name IN ('click', 'purchase') AND {_AFTER}"),
    "read_page": _sql(f"type_name IN ('click', 'purchase') AND {_AFTER}", "ORDER BY position LIMIT 25"),
    "read_reverse": _sql("list_has_all(t, ['day:2024-01-05', 'k:7'])", "ORDER BY position DESC"),
    "read_reverse_limit_after": _sql(f"type_name IN ('click', 'purchase') AND {_AFTER}", "ORDER BY position DESC LIMIT 25"),
    "read_or_reverse_after_limit": _sql(f"{_OR} AND {_AFTER}", "ORDER BY position DESC LIMIT 25"),
    "read_pages": f"{_LOG}, m AS (SELECT position, (row_number() OVER (ORDER BY position) - 1) // 40 AS page FROM log WHERE {_OR}) SELECT page::BIGINT AS page, count(*)::BIGINT AS n_events, max(position) AS last_position FROM m GROUP BY page",
    "read_order": f"{_LOG}, m AS (SELECT position FROM log WHERE {_OR}) SELECT 'ascending' AS direction, (row_number() OVER (ORDER BY position) - 1)::BIGINT AS number, position FROM m UNION ALL SELECT 'descending', (row_number() OVER (ORDER BY position DESC) - 1)::BIGINT, position FROM m",
    "type_discovery": f"{_LOG} SELECT DISTINCT type_name FROM log WHERE list_contains(t, 'user:8')",
    "condition_exists": f"{_LOG} {_CONDITIONS_SQL} SELECT cond_id::BIGINT AS cond_id, bool_or(EXISTS (SELECT 1 FROM log WHERE (v > v0 OR (v = v0 AND i > i0)) AND (len(types) = 0 OR list_contains(types, type_name)) AND list_has_all(t, tags))) AS violated FROM c GROUP BY cond_id",
    "conditions_bulk": _BULK_SQL,
    "conditions_bulk_indexed": _BULK_SQL,
    "conflict_iff_matches": f"SELECT cond_id, n_events AS n_direct, n_events AS n_indexed, true AS equal FROM ({_BULK_SQL})",
    "powerset_index": f"{_LOG} {_SUBSETS_SQL} SELECT subset, type_name, count(*)::BIGINT AS n_events FROM s GROUP BY subset, type_name",
    "index_range_scan": f"{_LOG} SELECT position, type_name FROM log WHERE type_name = 'click' AND list_contains(t, 'k:7') AND {_AFTER}",
    "index_fetch_join": f"{_LOG} SELECT position, type_name, data FROM log WHERE list_contains(t, 'k:7')",
    "orphan_index_rows": f"{_LOG} SELECT type_name, (8 * count(*))::BIGINT AS n_rows FROM log WHERE v % 10 = 0 GROUP BY type_name",
    "sentinel_watermark": f"{_LOG} SELECT printf('%020x%04x', max(v), 0) AS sentinel, max(position) AS last_position FROM log",
    "cursor_lag": f"{_LOG}, k(name, v0, i0) AS (VALUES ('a', 100, 3), ('b', 1099511627776, 0), ('c', -1, -1)) SELECT name, count(log.v)::BIGINT AS n_events FROM k LEFT JOIN log ON log.v > v0 OR (log.v = v0 AND log.i > i0) GROUP BY name",
    "canonical_tags": f"{_LOG} SELECT position, array_to_string(list_sort(t), '|') AS canonical, array_to_string(list_append(t, t[1]), '|') AS stored FROM log",
    "position_codec": f"{_LOG} SELECT position, v::BIGINT AS commit_version, i::BIGINT AS batch_index FROM log",
}


QUERIES |= store_queries.QUERIES
ORACLE_SQL |= store_queries.ORACLE_SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["read_or_items"](spark, sf_dir)
