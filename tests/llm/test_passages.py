from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, substring

from .conftest import table, words


def grams(text, k=5):
    w = words((text or "").lower())
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def items(spark, rows):
    passage = rows[-1][1]
    w = passage.split()
    texts = [passage, " ".join(w[5:20]), " ".join([*w[:20], "changed", *w[21:]]), "two words", "one", None, " \n ", "not in any text at all of these", " ".join(w[:9]), " ".join(w[:9])]
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, n_found string")


def test_contamination(docs, rows, items):
    got = {tuple(r) for r in decontaminate.contained(docs, items).select("doc_id", "item_id", "n_shingles", "n_found").collect()}
    expected = set()
    for i, t, *_ in rows:
        for j, u in items.select("item_id", "text").collect():
            a, b = grams(t), grams(u)
            if b and 5 * len(a & b) >= 4 * len(b):
                expected.add((i, j, len(b), len(a & b)))
    assert got == expected and len({j for _, j, *_ in got}) >= 6


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_no_item_is_missed_at_any_threshold(spark, threshold):
    """The sketch is long enough: documents that lack as many shingles as they may are found."""
    rng = random.Random(int(threshold * 10))
    docs, items = [], []
    for k in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))]
        items.append((k, " ".join(w)))
        hurt = list(w)
        for _ in range(rng.randint(0, 4)):
            hurt[rng.randrange(len(w))] = "other"
        docs.append((k, " ".join([f"x{j}" for j in range(rng.randint(0, 300))] + hurt + ["end"] * 3)))
    found = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold)
    expected = {(i, j) for i, t in docs for j, u in items if len(grams(t) & grams(u)) >= threshold * len(grams(u)) - 1e-9}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and expected


def test_blocks_of_items(docs, items):
    one, many = (table(decontaminate.find(docs, items, block_rows=n, broadcast_rows=m).drop("_print"), "doc_id", "item_id", "n_found") for n, m in ((10**6, 10**6), (40, 0)))
    assert one == many


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_clean(docs, rows, items, broadcast_rows):
    bad = {(r.doc_id, r._print) for r in decontaminate.find(docs, items).collect()}
    out = decontaminate.clean(docs, items, broadcast_rows=broadcast_rows)
    expected = [r for r in rows if (r[0], hashlib.md5((r[1] or "").encode()).hexdigest()) not in bad]
    assert out.columns == docs.columns and table(out, "doc_id") == sorted(((r[0],) for r in expected), key=lambda t: (t[0] is None, t[0] or 0))


def test_contamination_of_nothing(docs, items, empty):
    assert decontaminate.contained(empty, items).count() == 0
    assert decontaminate.contained(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def test_decontamination_is_native(docs, items):
    plan = decontaminate.contained(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def cut(rows, n=20):
    """What is left of each document, by comparing all windows in order."""
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    assert len({r[0] for r in order}) == len(order), "brute force needs one text for each doc_id"
    first: dict = {}
    out = {}
    for i, t in order:
        w, gone = words(t), set()
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in first:
                gone.update(range(s, s + n))
            else:
                first[tuple(w[s : s + n])] = 1
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_words": 300}, {"chunk_words": 50, "max_bits": 1, "broadcast_spans": 0}, {"chunk_words": 50, "group": 2}, {"chunk_words": 300, "least_hot": 0, "max_hot": 10**9}], ids=str)
def test_substrings(docs, rows, options):
    """Also with places joined instead of marked, with groups that are too large, and with every anchor a hot one."""
    some = [r for r in rows if r[0] is not None]
    out = substring.cut_repeats(docs.where("doc_id IS NOT NULL").withColumn("kept", F.lit("old")), **options).collect()
    expected = cut(some)
    assert len(out) == len(some) and sum(x[1] for x in expected.values()) > 300
    for r in out:
        assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id]


def test_matches_are_extended_both_ways():
    """A seed in common is not enough, nor is one side: the words left and right of it are compared."""
    w = [b"w%d" % k for k in range(32)]
    place = lambda d, *changed: (d, 0, 100, [b"x%d" % d if k in changed else x for k, x in enumerate(w)])
    runs, _ = substring.extend([place(1), place(2), place(3, 11), place(4, 20), place(5, 11, 20), place(6, 5, 26), place(7, 6, 25)], 20)
    # seed at 12 to 19; what is equal to an earlier place and at least 20 words long
    assert runs == [(2, 0, 100, 132), (3, 0, 112, 132), (4, 0, 100, 120), (6, 0, 106, 126)]
    periodic = [b"a", b"b"] * 16
    runs, first = substring.extend([(1, 0, 0, periodic)], 20)
    assert runs == [(1, 0, 2, 32)] and len(first) == 2


def test_substrings_in_one_hot_passage(spark):
    """Many documents around one passage, in small chunks: edges of the passage have a context of their own each."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([word() for _ in range(rng.randint(0, 15))] + passage[rng.randint(0, 3) :] + [word() for _ in range(rng.randint(0, 15))])) for k in range(200)]
    expected = cut(rows)
    for options in ({}, {"chunk_words": 500, "group": 7}, {"chunk_words": 500, "least_hot": 50, "max_hot": 10**9}):
        out = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == expected


def test_substrings_without_ids_and_with_shared_ids(docs, rows):
    out = substring.cut_repeats(docs).collect()
    assert len(out) == len(rows)
    kept: dict = {}
    for r in out:
        kept.setdefault((r.doc_id, r.text), set()).add((r.n_words, r.n_removed, r.kept))
    assert all(len(v) == 1 for v in kept.values())
    # a document without an id comes after the one it repeats
    copy = next(r for r in out if r.doc_id is None and r.text == rows[7][1])
    assert copy.n_removed == copy.n_words


def test_substring_digest_and_nothing(docs, empty):
    r = next(r for r in substring.digest(docs).collect() if r.doc_id == 103)
    assert (r.n_words, r.n_removed, r.kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert substring.digest(empty).count() == 0
