"""Registered queries of the write and stream path: each fills a store of its own from the whole ``events`` table, in
the folder that driver and executors share, works on it, and returns what is there afterwards.

A store's versions begin at 1, so commits stand one version above those of ``events_log``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AppendConditionFailed, LogError
from .functions import position_hex
from .model import MAX_BATCH, AppendCondition, Event, Query, QueryItem, ReadOptions, pack_position
from .operators import index
from .sources import Store, shared_folder
from .streaming import catch_up, tail

_SHIFTED = """
WITH log AS (
  SELECT event_id // 8 + 1 AS v, event_id % 8 AS i, printf('%020x%04x', event_id // 8 + 1, event_id % 8) AS position, event_type AS type_name,
         ['user:' || user_id, 'k:' || json_extract_string(props, '$.k'), 'day:' || strftime(ts, '%Y-%m-%d')] AS t, props AS data
  FROM events),
high AS (SELECT max(v) AS high FROM log)
"""


def _store(spark: SparkSession, sf_dir: str) -> Store:
    from .queries import events_log

    store = Store(spark, shared_folder(spark), f"query-{uuid.uuid4().hex}")
    store.load(events_log(spark, sf_dir).withColumn("commit_version", F.col("commit_version") + 1))
    return store


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower(F.hex("position")).alias("position"), "type_name", F.array_join("tags", "|").alias("tags"), F.decode("data", "UTF-8").alias("data"))


#: Conditional appends, in this order; each appends one event of type "Checked".
STEPS = (
    AppendCondition(Query((QueryItem(("click",), ("user:8",)), QueryItem(("nope",), ("user:8",))))),
    AppendCondition(Query.of_types("nope")),
    AppendCondition(Query.of_types("view", "error"), pack_position(60, 3)),
    AppendCondition(Query.of_types("view"), b"\xff" * 12),
    AppendCondition(Query.of_tags("user:8", "nope")),
    AppendCondition(Query.of_types("Checked")),
    AppendCondition(Query.of_tags("k:7", "day:2024-01-05")),
)


def append_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes of each conditional append, and where its event is. The sixth meets events of this run."""
    store, rows = _store(spark, sf_dir), []
    for k, condition in enumerate(STEPS):
        try:
            rows.append((k, "appended", store.append([Event("Checked", (f"step:{k}",))], [condition]).hex()))
        except AppendConditionFailed as e:
            rows.append((k, type(e).__name__, ""))
    return spark.createDataFrame(rows, "step long, outcome string, position string")


def append_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of five and one of one, appended to the loaded log, compacted, vacuumed and read whole, in order."""
    store = _store(spark, sf_dir)
    store.append([Event("Batch", (f"n:{k}", "b", "a", "b"), str(k).encode()) for k in range(5)])
    store.append([Event("Last")])
    store.compact()
    store.vacuum(0)
    return _shown(store.read_all())


def append_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append whose version is taken by another writer, and one whose success isn't reported: both are there once."""
    store = _store(spark, sf_dir)
    publish, rival = store.files.publish, Store(spark, shared_folder(spark), store.namespace)
    calls: list[str] = []

    def unlucky(staged: str, target: str) -> bool:
        calls.append(target)
        if len(calls) == 1:
            rival.append([Event("Rival")])
        done = publish(staged, target)
        if len(calls) == 3:
            raise OSError("the answer was lost")
        return done

    store.files.publish = unlucky
    store.append([Event("Mine")], [AppendCondition(Query.of_types("nope"))])
    store.append([Event("Once")])
    return _shown(store.read(Query.of_types("Rival", "Mine", "Once")))


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of one snapshot in pages of 500."""
    found = _store(spark, sf_dir).page_rows(Query.of_types("click"), 500, ReadOptions(after=pack_position(41, 3)))
    rows = [(k, len(page), max(r.position for r in page).hex()) for k, page in enumerate(found)]
    return spark.createDataFrame(rows, "page long, n_events long, last_position string")


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors: never set, set, set back, and moved by catching up with what matches."""
    store = _store(spark, sf_dir)
    store.set_cursor("set", pack_position(41, 3))
    store.set_cursor("back", pack_position(1 << 70, 3))
    store.set_cursor("back", pack_position(1, 0))
    store.set_cursor("caught up", pack_position(41, 3))
    handled: list[int] = []
    n = catch_up(store, "caught up", Query.of_types("click"), lambda rows: handled.append(len(rows.collect())), page=700)
    rows = [(name, at.hex() if (at := store.get_cursor(name)) else "none", 0) for name in ("never", "set", "back")]
    rows.append(("caught up", store.get_cursor("caught up").hex(), n if n == sum(handled) else -1))
    return spark.createDataFrame(rows, "name string, position string, n_handled long")


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch fires for what is appended after it was armed, once; another namespace doesn't fire it."""
    store = _store(spark, sf_dir)
    other = Store(spark, shared_folder(spark), f"{store.namespace}-other")
    watch, rows = store.watch(), []
    other.append([Event("T")])
    rows.append(("armed", watch.wait(0)))
    store.append([Event("T")])
    rows.append(("appended", watch.wait(5)))
    rows.append(("armed again", store.watch().wait(0)))
    return spark.createDataFrame(rows, "step string, fired boolean")


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tail of what matches: the loaded log, then, after a restart from its checkpoint, what was appended since."""
    store = _store(spark, sf_dir)
    out = f"{shared_folder(spark)}/tail-{uuid.uuid4().hex}"
    query = Query((QueryItem(("click",), ("k:7",)), QueryItem(("New",))))
    seen: list[str] = []

    def handle(rows: DataFrame, batch: int) -> None:
        seen.append(f"{out}/{len(seen)}")
        rows.write.parquet(seen[-1])

    tail(store, query, handle, f"{out}/checkpoint", once=True).awaitTermination()
    for k in range(3):
        store.append([Event("New", (f"n:{k}",), b"x"), Event("Other")])
    tail(store, query, handle, f"{out}/checkpoint", once=True).awaitTermination()
    return _shown(spark.read.parquet(*seen))


def invalid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each invalid request is refused with; nothing of them is in the log."""
    store, e = _store(spark, sf_dir), Event("T")
    bad = Query((QueryItem(),))
    cases: dict[str, Callable[[], object]] = {
        "no events": lambda: store.append([]),
        "no type": lambda: store.append([Event("", ("a",) * 11)]),
        "eleven equal tags": lambda: store.append([Event("T", ("t",) * 11)]),
        "reserved tag": lambda: store.append([Event("T", ("_",))]),
        "too many events": lambda: store.append([e] * (MAX_BATCH + 1)),
        "condition without items": lambda: store.append([e], [AppendCondition(Query())]),
        "condition with an empty item": lambda: store.append([e], [AppendCondition(bad)]),
        "reserved tag in a condition": lambda: store.append([e], [AppendCondition(Query.of_tags("_"))]),
        "read with an empty item": lambda: store.read(bad),
        "read with a reserved tag": lambda: store.read(Query.of_tags("_")),
        "no events and a bad condition": lambda: store.append([], [AppendCondition(bad)]),
    }
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, None))
        except LogError as error:
            rows.append((name, type(error).__name__))
    rows.append(("events of type T", str(store.read(Query.of_types("T")).count())))
    return spark.createDataFrame(rows, "name string, outcome string")


def missing_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index entry without its event fails the fetch, with the position; a whole log doesn't."""
    from .queries import events_log

    log = events_log(spark, sf_dir)
    entries = log.where("array_contains(tags, 'k:7')").select("type_name", "commit_version", "batch_index")
    last = entries.agg(F.max(F.struct("commit_version", "batch_index")).alias("m")).select("m.*").first()
    rows = []
    for name, there in (("whole", log), ("damaged", log.where(~((F.col("commit_version") == last[0]) & (F.col("batch_index") == last[1]))))):
        try:
            rows.append((name, str(len(index.fetched(entries, there)))))
        except LogError as e:
            rows.append((name, f"{type(e).__name__} {e}"))
    return spark.createDataFrame(rows, "name string, outcome string")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads by tags from a stored index: one bucket is read."""
    from .queries import events_log

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.build_index(events_log(spark, sf_dir), path)
    found = index.lookup(spark, path, ("user:8", "k:7", "k:7")).withColumn("tags", F.lit("k:7|user:8"))
    found = found.unionByName(index.lookup(spark, path, ("day:2024-01-05",), ("click", "view"), pack_position(40, 3)).withColumn("tags", F.lit("day:2024-01-05")))
    return found.select("tags", "type_name", position_hex().alias("position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "append_conditions": append_conditions,
    "append_round_trip": append_round_trip,
    "append_retry": append_retry,
    "store_pages": store_pages,
    "cursors": cursors,
    "watches": watches,
    "stream_tail": stream_tail,
    "invalid_requests": invalid_requests,
    "missing_event": missing_event,
    "stored_index": stored_index,
}

ORACLE_SQL: dict[str, str] = {
    "append_conditions": f"""{_SHIFTED}, c(step, types, tags, v0, i0) AS (VALUES
  (0, ['click'], ['user:8'], -1, -1), (0, ['nope'], ['user:8'], -1, -1), (1, ['nope'], []::VARCHAR[], -1, -1), (2, ['view', 'error'], []::VARCHAR[], 60, 3),
  (3, ['view'], []::VARCHAR[], 9223372036854775807, 65535), (4, []::VARCHAR[], ['user:8', 'nope'], -1, -1), (6, []::VARCHAR[], ['k:7', 'day:2024-01-05'], -1, -1)),
f AS (SELECT step, bool_or(EXISTS (SELECT 1 FROM log WHERE (v > v0 OR (v = v0 AND i > i0)) AND (len(types) = 0 OR list_contains(types, type_name)) AND list_has_all(t, tags))) AS failed FROM c GROUP BY step
  UNION ALL SELECT 5, true),
n AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (ORDER BY step) AS k FROM f)
SELECT step::BIGINT AS step, CASE WHEN failed THEN 'AppendConditionFailed' ELSE 'appended' END AS outcome,
  CASE WHEN failed THEN '' ELSE printf('%020x%04x', (high + k)::BIGINT, 0) END AS position FROM n, high""",
    "append_round_trip": f"""{_SHIFTED} SELECT position, type_name, array_to_string(t, '|') AS tags, data FROM log
UNION ALL SELECT printf('%020x%04x', high + 1, k), 'Batch', 'n:' || k || '|b|a|b', k::VARCHAR FROM high, range(5) r(k)
UNION ALL SELECT printf('%020x%04x', high + 2, 0), 'Last', '', '' FROM high""",
    "append_retry": f"{_SHIFTED} SELECT printf('%020x%04x', high + k, 0) AS position, type_name, '' AS tags, '' AS data FROM high, (VALUES (1, 'Rival'), (2, 'Mine'), (3, 'Once')) x(k, type_name)",
    "store_pages": f"{_SHIFTED}, m AS (SELECT position, (row_number() OVER (ORDER BY position) - 1) // 500 AS page FROM log WHERE type_name = 'click' AND (v > 41 OR (v = 41 AND i > 3))) SELECT page::BIGINT AS page, count(*)::BIGINT AS n_events, max(position) AS last_position FROM m GROUP BY page",
    "cursors": f"""{_SHIFTED} SELECT 'never' AS name, 'none' AS position, 0::BIGINT AS n_handled UNION ALL SELECT 'set', printf('%020x%04x', 41, 3), 0
UNION ALL SELECT 'back', printf('%020x%04x', 1, 0), 0
UNION ALL SELECT 'caught up', max(position), count(*)::BIGINT FROM log WHERE type_name = 'click' AND (v > 41 OR (v = 41 AND i > 3))""",
    "watches": "SELECT step, fired FROM (VALUES ('armed', false), ('appended', true), ('armed again', false)) x(step, fired)",
    "stream_tail": f"""{_SHIFTED} SELECT position, type_name, array_to_string(t, '|') AS tags, data FROM log WHERE type_name = 'click' AND list_contains(t, 'k:7')
UNION ALL SELECT printf('%020x%04x', high + 1 + k, 0), 'New', 'n:' || k, 'x' FROM high, range(3) r(k)""",
    "invalid_requests": """SELECT name, outcome FROM (VALUES ('no events', 'EmptyEvents'), ('no type', 'MissingEventType'), ('eleven equal tags', 'TooManyTags'),
  ('reserved tag', 'ReservedTag'), ('too many events', 'BatchTooLarge'), ('condition without items', 'InvalidQuery'), ('condition with an empty item', 'InvalidQuery'),
  ('reserved tag in a condition', 'ReservedTag'), ('read with an empty item', 'InvalidQuery'), ('read with a reserved tag', 'ReservedTag'),
  ('no events and a bad condition', 'EmptyEvents'), ('events of type T', '0')) x(name, outcome)""",
    "missing_event": """WITH log AS (SELECT event_id // 8 AS v, event_id % 8 AS i FROM events WHERE json_extract_string(props, '$.k') = '7')
SELECT 'whole' AS name, count(*)::VARCHAR AS outcome FROM log UNION ALL SELECT 'damaged', 'EventNotFound ' || max(printf('%020x%04x', v, i)) FROM log""",
    "stored_index": f"""{_SHIFTED} SELECT 'k:7|user:8' AS tags, type_name, printf('%020x%04x', v - 1, i) AS position FROM log WHERE list_has_all(t, ['k:7', 'user:8'])
UNION ALL SELECT 'day:2024-01-05', type_name, printf('%020x%04x', v - 1, i) FROM log WHERE list_contains(t, 'day:2024-01-05') AND type_name IN ('click', 'view') AND (v > 41 OR (v = 41 AND i > 3))""",
}
