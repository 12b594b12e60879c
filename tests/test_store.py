from __future__ import annotations

import multiprocessing
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog.errors import AppendConditionFailed, CommitContention, CorruptRecord, InvalidQuery, ReservedTag
from tidelog.model import AppendCondition, Event, Query, QueryItem, ReadOptions, pack_position, unpack_position
from tidelog.sources import HadoopFiles, LocalFiles, Store
from tidelog.sources import store as store_module
from tidelog.streaming import catch_up, tail


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), "ns")


def types(rows):
    return [r.type_name for r in rows.collect()]


def test_empty_store(store):
    assert store.version == 0 and types(store.read_all()) == [] and types(store.read(Query.of_tags("x"), ReadOptions(reverse=True))) == []


def test_round_trip_and_positions(store):
    last = store.append([Event("A", ("t", "s", "t"), b"\x01\x00"), Event("B"), Event("C")])
    assert unpack_position(last) == (1, 2)
    assert unpack_position(store.append([Event("D")])) == (2, 0)
    found = Store.events(store.read_all())
    assert [unpack_position(x.position) for x in found] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert found[0].event == Event("A", ("t", "s", "t"), b"\x01\x00")
    assert [x.position for x in Store.events(store.read(Query.of_types("D")))] == [found[3].position]


def test_limit_after_reverse(store):
    at = [store.append([Event("T")]) for _ in range(4)]
    assert [bytes(r.position) for r in store.read(Query.of_types("T"), ReadOptions(2, reverse=True)).collect()] == [at[3], at[2]]
    assert [bytes(r.position) for r in store.read(Query.of_types("T"), ReadOptions(after=at[1])).collect()] == at[2:]
    assert [len(Store.events(p)) for p in store.pages(Query.of_types("T"), 3)] == [3, 1]
    assert [len(Store.events(p)) for p in store.pages(Query.of_types("T"), 2, ReadOptions(after=at[0]))] == [2, 1]
    for options in (ReadOptions(2), ReadOptions(reverse=True)):
        with pytest.raises(ValueError, match="pages"):
            next(store.pages(Query.of_types("T"), 3, options))


def test_pages_are_of_one_snapshot(store):
    for _ in range(3):
        store.append([Event("T")])
    pages = store.pages(Query.of_types("T"), 2)
    first = Store.events(next(pages))
    store.append([Event("T")])
    assert len(first) == 2 and [len(Store.events(p)) for p in pages] == [1]


def counting(monkeypatch, store):
    """Counts the events that the store's log frames hand out."""
    handed, log = store.spark.sparkContext.accumulator(0), store.log

    @F.udf("boolean")
    def seen(_):
        handed.add(1)
        return True

    monkeypatch.setattr(store, "log", lambda *a, **k: log(*a, **k).where(seen.asNondeterministic()("batch_index")))
    return handed


def test_pages_scan_the_log_once(store, monkeypatch):
    for k in range(6):
        store.append([Event("T", ("a",) * (k % 3), bytes([k])), Event("U")])
    at = [bytes(r.position) for r in store.read(Query.of_types("T")).collect()]
    handed = counting(monkeypatch, store)
    found = [[(bytes(r.position), r.type_name, list(r.tags), bytes(r.data)) for r in p.collect()] for p in store.pages(Query.of_types("T"), 1)]
    assert handed.value == 12
    assert found == [[(p, "T", ["a"] * (k % 3), bytes([k]))] for k, p in enumerate(at)]
    assert [[bytes(r.position) for r in p] for p in store.page_rows(Query.of_types("T"), 4, ReadOptions(after=at[0]))] == [at[1:5], at[5:]]


@pytest.mark.parametrize("direct", [0, 16])
def test_conditions(store, monkeypatch, direct):
    monkeypatch.setattr(store_module, "DIRECT", direct)
    at = store.append([Event("T", ("a",))])
    for c in (Query.of_types("T"), Query.of_tags("a"), Query((QueryItem(("X",)), QueryItem((), ("a",))))):
        with pytest.raises(AppendConditionFailed):
            store.append([Event("X")], [AppendCondition(c)])
    with pytest.raises(AppendConditionFailed):  # all conditions must hold
        store.append([Event("X")], [AppendCondition(Query.of_types("none")), AppendCondition(Query.of_types("T"))])
    assert types(store.read_all()) == ["T"] and os.listdir(store.base) == ["commit_version=1"]
    store.append([Event("Y")], [AppendCondition(Query.of_types("T"), at)])
    with pytest.raises(AppendConditionFailed):  # each condition has its own position
        store.append([Event("Z")], [AppendCondition(Query.of_types("T"), at), AppendCondition(Query.of_types("Y"), at)])
    store.append([Event("Own"), Event("Own")], [AppendCondition(Query.of_types("Own"))])  # not against its own events
    assert types(store.read_all()) == ["T", "Y", "Own", "Own"]


def test_invalid_requests(store):
    with pytest.raises(InvalidQuery):
        store.read(Query((QueryItem(),)))
    with pytest.raises(ReservedTag):
        store.read(Query.of_tags("_"))
    with pytest.raises(TypeError):
        store.append(Event("T"))
    with pytest.raises(TypeError):
        store.read("T")


def test_commit_between_check_and_publish(store, spark, tmp_path):
    """A writer that lost its version looks at what was committed since, and only at that."""
    other, publish, calls = Store(spark, str(tmp_path), "ns"), store._publish, []

    def late(staged, version, txn):
        if not calls:
            calls.append(1)
            other.append([Event("Rival")])
        return publish(staged, version, txn)

    store._publish = late
    with pytest.raises(AppendConditionFailed):
        store.append([Event("Mine")], [AppendCondition(Query.of_types("Rival"))])
    calls.clear()
    assert unpack_position(store.append([Event("Mine")], [AppendCondition(Query.of_types("Other"))]))[0] == 3
    assert types(store.read_all()) == ["Rival", "Rival", "Mine"]


def test_unknown_outcome_is_found_by_its_transaction(store):
    publish = store.files.publish

    def lossy(staged, target):
        publish(staged, target)
        raise OSError("the answer was lost")

    store.files.publish = lossy
    assert unpack_position(store.append([Event("Once")])) == (1, 0)
    store.files.publish = publish
    assert types(store.read_all()) == ["Once"]


def test_racing_threads_have_one_winner(spark, tmp_path):
    wins, losses = [], []

    def race(ns):
        try:
            wins.append((ns, Store(spark, str(tmp_path), ns).append([Event("Singleton")], [AppendCondition(Query.of_types("Singleton"))])))
        except AppendConditionFailed:
            losses.append(ns)

    threads = [threading.Thread(target=race, args=(f"slot{k % 3}",)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(ns for ns, _ in wins) == ["slot0", "slot1", "slot2"] and len(losses) == 9


def _publish_one(args):
    staged, target = args
    os.makedirs(staged)
    open(f"{staged}/x", "w").close()
    return LocalFiles().publish(staged, target)


def test_racing_processes_have_one_winner(tmp_path):
    with multiprocessing.get_context("spawn").Pool(4) as pool:
        won = pool.map(_publish_one, [(f"{tmp_path}/s{k}", f"{tmp_path}/t/commit_version=1") for k in range(12)])
    assert sum(won) == 1


def test_namespaces_are_apart(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), "a/ä b"), Store(spark, str(tmp_path), "b")
    at = a.append([Event("T")])
    a.set_cursor("c", at)
    assert types(b.read_all()) == [] and b.get_cursor("c") is None and not b.watch().fired()
    b.append([Event("T")], [AppendCondition(Query.of_types("T"))])


def test_snapshot_is_pinned_through_compaction_and_vacuum(store):
    for k in range(5):
        store.append([Event("T", (str(k),)), Event("U")])
    pinned = store.snapshot()
    before = Store.events(store.read_all())
    assert store.compact(keep=1) == (1, 4)
    store.append([Event("V")])
    assert Store.events(store.read_all(pinned)) == before and Store.events(store.read_all())[:-1] == before
    assert store.vacuum(older_than=0) == 4
    assert Store.events(store.read_all())[:-1] == before and unpack_position(store.append([Event("W")])) == (7, 0)
    with pytest.raises(AppendConditionFailed):
        store.append([Event("X")], [AppendCondition(Query.of_tags("2"))])
    assert store.compact() == (1, 7) and store.snapshot().ranges == ((1, 7),)
    assert types(store.read(Query.of_types("T", "W"), ReadOptions(after=pack_position(4, 0)))) == ["T", "W"]


def test_load_in_parallel(store, spark):
    store2 = store
    log = spark.createDataFrame([(v, i, "T", [f"v:{v}"], b"") for v in range(1, 9) for i in range(4)], "commit_version long, batch_index int, type_name string, tags array<string>, data binary")
    assert store2.load(log) == 8 and store2.version == 8
    assert unpack_position(store2.append([Event("U")]))[0] == 9
    assert store2.read(Query.of_tags("v:3")).count() == 4
    with pytest.raises(ValueError):
        store2.load(log)


def test_cursors(store):
    assert store.get_cursor("c") is None
    store.set_cursor("c", pack_position(9, 1))
    store.set_cursor("c", pack_position(2, 0))  # the last write holds
    assert store.get_cursor("c") == pack_position(2, 0) and store.get_cursor("d") is None
    with pytest.raises(CorruptRecord):
        store.set_cursor("c", b"short")
    store.files.write(store._cursor("bad"), b"123")
    with pytest.raises(CorruptRecord):
        store.get_cursor("bad")


def test_watch_fires_once_for_appends_after_arming(store):
    for _ in range(3):
        watch = store.watch()
        assert not watch.fired() and not watch.wait(0.05)
        store.append([Event("T")])
        assert watch.wait(5)
    with pytest.raises(AppendConditionFailed):
        watch = store.watch()
        store.append([Event("T")], [AppendCondition(Query.of_types("T"))])
    assert not watch.fired()
    told = threading.Event()
    store.watch().notify(told.set)
    store.append([Event("T")])
    assert told.wait(5)


def test_catch_up(store):
    for k in range(5):
        store.append([Event("T", (), bytes([k])), Event("U")])
    seen = []
    handle = lambda rows: seen.append([r.data[0] for r in rows.collect()])
    assert catch_up(store, "c", Query.of_types("T"), handle, page=2) == 5
    assert seen == [[0, 1], [2, 3], [4]] and catch_up(store, "c", Query.of_types("T"), handle) == 0


def test_catch_up_scans_the_log_once(store, monkeypatch):
    for k in range(5):
        store.append([Event("T", (), bytes([k])), Event("U")])
    handed, seen = counting(monkeypatch, store), []
    assert catch_up(store, "c", Query.of_types("T"), lambda rows: seen.append([r.data[0] for r in rows.collect()]), page=1) == 5
    assert handed.value == 10 and seen == [[0], [1], [2], [3], [4]]


@pytest.mark.parametrize("n", [4, 5])
def test_catch_up_sees_what_is_appended_meanwhile(store, n):
    """An append while the first pages are handled, by their handler; the short page before it isn't the last."""
    for k in range(n):
        store.append([Event("T", (), bytes([k]))])
    seen = []

    def handle(rows):
        seen.append([r.data[0] for r in rows.collect()])
        if len(seen) < 3:
            store.append([Event("T", (), bytes([n + len(seen)]))])

    assert catch_up(store, "c", Query.of_types("T"), handle, page=2) == n + 2
    assert seen == ([[0, 1], [2, 3], [5, 6]] if n == 4 else [[0, 1], [2, 3], [4, 6], [7]])
    assert unpack_position(store.get_cursor("c")) == (n + 2, 0)


def test_stream_resumes_from_its_checkpoint(store, tmp_path):
    batches = []

    def run():
        q = tail(store, Query.of_types("T"), lambda rows, _: batches.append([r.data[0] for r in rows.collect()]), str(tmp_path / "ck"), once=True)
        q.awaitTermination(60)

    for k in range(3):
        store.append([Event("T", (), bytes([k])), Event("U")])
    run()
    store.append([Event("T", (), b"\x07"), Event("T", (), b"\x08")])
    store.compact()
    run()
    run()
    assert [b for b in batches if b] == [[0, 1, 2], [7, 8]]


def test_hadoop_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = HadoopFiles(spark, root)
    for k, won in ((1, True), (2, False)):
        files.write(f"{root}/s{k}/x", b"data")
        assert files.publish(f"{root}/s{k}", f"{root}/t/commit_version=1") is won
    assert files.names(f"{root}/t") == ["commit_version=1"] and files.names(f"{root}/none") == []
    files.write(f"{root}/c", b"1")
    files.write(f"{root}/c", b"2")
    assert files.read(f"{root}/c") == b"2" and files.read(f"{root}/d") is None and abs(files.age(f"{root}/c") - time.time()) < 60
    files.remove(f"{root}/c")
    assert files.read(f"{root}/c") is None
    other = Store(spark, str(tmp_path), "hadoop")
    other.files, other.base = files, f"{root}/hadoop"
    assert unpack_position(other.append([Event("T")])) == (1, 0) and types(other.read_all()) == ["T"]
    with pytest.raises(AppendConditionFailed):
        other.append([Event("T")], [AppendCondition(Query.of_types("T"))])


def _log(spark, n):
    from tidelog.model import LOG

    return spark.createDataFrame([(k // 4 + 1, k % 4, "Old", [], b"") for k in range(n)], LOG)


def test_a_writer_between_the_check_and_the_publishing_of_a_load(spark, store, tmp_path):
    """The load loses, and what was appended stays."""
    other, publish = Store(spark, str(tmp_path), "ns"), store._publish

    def late(staged, version, txn):
        other.append([Event("First")])
        return publish(staged, version, txn)

    store._publish = late
    with pytest.raises(CommitContention):
        store.load(_log(spark, 16))
    assert types(store.read_all()) == ["First"] == types(other.read_all()) and os.listdir(store.base) == ["commit_version=1"]


def test_a_load_counts_from_when_it_has_its_version(spark, store, tmp_path):
    """It stops before its range is in its place: whoever comes next, to read, append or stream, finishes it."""
    store._finish_load = lambda: None
    assert store.load(_log(spark, 16)) == 4
    other = Store(spark, str(tmp_path), "ns")
    streamed = []
    from tidelog.streaming.source import _Reader

    assert _Reader({"path": store.base}).latestOffset() == {"version": 0}
    assert unpack_position(other.append([Event("New")], [AppendCondition(Query.of_types("New"))])) == (5, 0)
    assert types(other.read_all()) == ["Old"] * 16 + ["New"] == types(Store(spark, str(tmp_path), "ns").read_all())
    tail(other, Query.of_types("Old", "New"), lambda rows, _: streamed.extend(types(rows)), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert streamed == ["Old"] * 16 + ["New"]
    with pytest.raises(ValueError, match="commits"):
        other.load(_log(spark, 4))


def test_loads_race_with_appends(spark, tmp_path):
    for k in range(4):
        wins = []

        def run(what, call, wins=wins):
            try:
                call()
                wins.append(what)
            except (CommitContention, ValueError):
                pass

        ns = f"race{k}"
        calls = [("load", lambda ns=ns: Store(spark, str(tmp_path), ns).load(_log(spark, 8)))] * 2 + [("append", lambda ns=ns: Store(spark, str(tmp_path), ns).append([Event("A")]))] * 3
        threads = [threading.Thread(target=run, args=c) for c in calls]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert wins.count("append") == 3 and wins.count("load") <= 1
        assert sorted(types(Store(spark, str(tmp_path), ns).read_all())) == ["A"] * 3 + ["Old"] * (8 * wins.count("load"))


def test_both_ways_to_look_at_conditions_agree(store, monkeypatch):
    rng = random.Random(7)
    pick = lambda of, n: tuple(rng.choice(of) for _ in range(rng.randint(0, n)))
    for _ in range(8):
        store.append([Event(rng.choice("ABC"), pick("xyz", 3)) for _ in range(rng.randint(1, 3))])
    s, found = store.snapshot(), []
    for _ in range(30):
        items = tuple(QueryItem(t, g) for t, g in ((pick("ABD", 2), pick("xyzw", 2)) for _ in range(2)) if t or g) or (QueryItem(("A",)),)
        c = AppendCondition(Query(items), rng.choice([None, pack_position(rng.randint(1, 9), rng.randint(0, 2))]))
        by = []
        for direct in (0, 16):
            monkeypatch.setattr(store_module, "DIRECT", direct)
            by.append(store._violated(s, 0, [c]))
        assert by[0] == by[1]
        found.append(by[0])
    assert True in found and False in found


def test_conditions_read_only_what_is_after_them(store, monkeypatch):
    monkeypatch.setattr(store_module, "DIRECT", 0)
    at = [store.append([Event("T", (f"k:{k}",))]) for k in range(6)]
    read, log = [], Store.log

    def seen(self, snapshot=None, after=0):
        read.append([v for v in snapshot.commits if v > after])
        return log(self, snapshot, after)

    monkeypatch.setattr(Store, "log", seen)
    store.append([Event("X")], [AppendCondition(Query.of_types("None"), at[4])])
    store.append([Event("X")], [AppendCondition(Query.of_types("None"), at[4]), AppendCondition(Query.of_types("None"), at[2])])
    assert read == [[5, 6], [3, 4, 5, 6, 7]]
    with pytest.raises(AppendConditionFailed):
        store.append([Event("X")], [AppendCondition(Query.of_types("X"), at[5])])
    store.append([Event("X")], [AppendCondition(Query.of_types("T"), b"\xff" * 12)])
    assert len(read) == 3


def test_listing_is_extended_by_later_versions(store, spark, tmp_path):
    other = Store(spark, str(tmp_path), "ns")
    store.append([Event("A")], [AppendCondition(Query.of_types("A"))])
    other.append([Event("B")])
    other.compact()
    with pytest.raises(AppendConditionFailed):
        store.append([Event("C")], [AppendCondition(Query.of_types("B"))])
    assert unpack_position(store.append([Event("C")], [AppendCondition(Query.of_types("C"))]))[0] == 3


def test_streams_of_remote_folders_are_refused():
    from tidelog.streaming.source import _Reader

    with pytest.raises(ValueError, match="mounted"):
        _Reader({"path": "hdfs://nn/ns"})
