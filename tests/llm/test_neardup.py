from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import linededup, simhash
from tidelog.llm.components import components

from .conftest import SCHEMA, lower, words


def union(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def brute_fingerprint(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randint(2000, 2080), rng.randint(2000, 2080)) for _ in range(50)] + [(7, 7), (3, 4), (4, 3), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union([e for e in edges if e[0] is not None and e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_join_only_edges_between_different_trees(spark, monkeypatch):
    """Paths, a star around the greatest node, and a dense group: what is joined shrinks with each round, to nothing."""
    from tidelog.llm import components as module

    fresh, sizes = module._fresh, []

    def counted(df):
        out = fresh(df)
        sizes.extend([out.count()] * (out.columns == ["u", "v"]))
        return out

    monkeypatch.setattr(module, "_fresh", counted)
    rng = random.Random(7)
    path = rng.sample(range(300), 300)
    edges = list(itertools.pairwise(path)) + [(k, k + 1) for k in range(400, 500)] + [(999, k) for k in range(600, 700)] + [tuple(rng.sample(range(1000, 1050), 2)) for _ in range(300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union(edges)
    assert sizes[-1] == 0 and sum(sizes) <= 2 * sizes[0] and len(sizes) < 10


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 63), max_size=4), max_size=60), st.integers(1, 4))
def test_close_pairs_are_all_pairs(seeds, flips, nodes):
    seeds = sorted(seeds)
    fps = set(seeds)
    for k, bits in enumerate(flips):
        x = seeds[k % len(seeds)]
        for b in bits:
            x ^= 1 << b
        fps.add(x)
    node = {x: x % nodes for x in fps}
    every = np.array(sorted(fps), np.uint64)
    a, b, _ = simhash.close_pairs(every, np.array([node[x] for x in sorted(fps)]), 2, fan=3)
    got = {tuple(sorted(p)) for p in zip(every[a].tolist(), every[b].tolist(), strict=True)}
    assert got == {p for p in itertools.combinations(sorted(fps), 2) if (p[0] ^ p[1]).bit_count() <= 2 and node[p[0]] == node[p[1]]} and len(a) == len(got)


def test_the_tree_prunes_groups():
    """One large node, and very many small ones: few pairs of groups are looked at."""
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    near = np.concatenate((fps, fps[:300] ^ np.uint64(1 << 40), fps[:300] ^ np.uint64(3 << 7)))
    for node in (np.zeros(len(near), np.int64), (near >> np.uint64(50)).astype(np.int64)):
        a, b, looked = simhash.close_pairs(near, node, 2)
        assert len(a) >= 600 and looked < len(near) ** 2 / 2 / (20 if node.any() else 2)


@pytest.mark.parametrize(("limit", "leaf"), [(2, 512), (2, 20), (3, 16), (0, 4)])
def test_links_at_every_depth_of_the_index(spark, limit, leaf):
    rng = random.Random(leaf)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for x in list(fps)[:4]:
        for _ in range(60):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = {p for p in itertools.combinations(sorted(fps), 2) if (p[0] ^ p[1]).bit_count() <= limit}
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = lambda **o: [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(distinct, limit, leaf, **o).collect()]
    every = found(few=10**9)
    assert len(every) == len(set(every)) and set(every) == pairs
    for options in ({}, {"few": 5, "stars": 3}):  # fewer pairs that connect the same
        some = found(**options)
        assert union(some) == union(pairs)
        assert len(some) < len(pairs) or leaf < 512


def test_links_of_many_bits_in_deep_nodes(spark):
    """At seven bits there are eight times as many patterns in each level, and they are cut level after level."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 40:
        y = base
        for _ in range(rng.randint(2, 9)):
            y ^= 1 << rng.randrange(64)
        fps.add(y)
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(distinct, 7, 12, few=10**9).collect()}
    assert found == {p for p in itertools.combinations(sorted(fps), 2) if (p[0] ^ p[1]).bit_count() <= 7}


def test_fingerprints_and_components(docs, rows):
    out = simhash.digest(docs.withColumn("fp", F.lit("old"))).collect()
    fp = {t: brute_fingerprint(t) for t in {r[1] for r in rows}}
    assert len(out) == len(rows)
    groups = union([(a, b) for a in set(fp.values()) for b in set(fp.values()) if (a ^ b).bit_count() <= 2])
    least: dict = {}
    for i, t, *_ in rows:
        g = groups[fp[t]]
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    expected = sorted((str(i), f"{fp[t]:016x}", str(least[groups[fp[t]]])) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == expected


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97} x{k % 89}" for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_keep_one(docs, rows, empty):
    kept = simhash.keep_one(docs.withColumn("fp", F.lit("old")))
    assert kept.columns == [*docs.columns, "fp"]
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and 100 not in ids and 101 not in ids and 102 not in ids and ids.count(5) == 1 and 112 not in ids
    assert simhash.keep_one(empty).count() == 0 and simhash.digest(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "leaf": 8}], ids=str)
def test_keep_one_against_all_pairs(spark, options):
    """Copies with some words changed: those that SimHash proposes and that have 0.8 in common go, and no others."""
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for k in range(8):
            w = list(base)
            for _ in range(rng.randint(0, k)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "a b", "a b", "A B", None, "", " "]
    rows = [(k, t, "x", "y", k % 3) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(0, texts[0], "x", "y", -1), (None, texts[0], "x", "y", 0), (None, "no id", "x", "y", 0), (None, "no id", "x", "y", 0)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    sets = {k: frozenset(simhash.shingle_set(t, 5).tolist()) for k, t in enumerate(texts)}
    fp = {k: simhash.fingerprint(t, 2) for k, t in enumerate(texts)}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    groups = union([(a, b) for a, b in itertools.combinations_with_replacement(range(len(texts)), 2) if alike(a, b) and (fp[a] ^ fp[b]).bit_count() <= 7])
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({g for g in groups.values()})
    assert len({a for a in groups if groups[a] != a}) > 20
    assert [r.text for r in kept if r.doc_id is None] == ["no id"] and next(r.n_chars for r in kept if r.doc_id == 0) == -1


@pytest.mark.parametrize("limit", [0, 7])
def test_keep_one_loses_no_link(spark, limit):
    """Chains and groups of copies whose fingerprints are further apart than ``limit``, or that are too large for all pairs
    to be proposed; short texts, whose shingles are few; a passage that very many texts share."""
    rng = random.Random(17)
    vocab = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for size in (3, 9, 30, 60, 300):
        for _ in range(4):
            w = [rng.choice(vocab) for _ in range(size)]
            texts.append(w)
            for _ in range(12):
                w = list(rng.choice(texts[-3:]))
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, max(1, size // 14))] = [rng.choice(vocab) for _ in range(rng.randint(0, max(1, size // 14)))]
                texts.append(w)
    texts += [passage + [rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    texts = [" ".join(w) for w in texts] + ["", " ", "one"]
    rows = [(k, t, "x", "y", 0) for k, t in enumerate(texts)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3), limit=limit).collect()
    sets = [frozenset(simhash.shingle_set(t, 5).tolist()) for t in texts]
    every = range(len(texts))
    alike = [(a, b) for a, b in itertools.combinations_with_replacement(every, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    fp = [simhash.fingerprint(t, 2) for t in texts]
    assert sum((fp[a] ^ fp[b]).bit_count() > 7 for a, b in alike) > 5
    assert sorted(r.doc_id for r in kept) == sorted(set(union(alike).values()))


@pytest.mark.parametrize("most", [4, 1 << 20])
def test_sets_that_meet(most):
    """The prefix filter loses no pair, whatever counts as frequent and however a long list is cut."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 25))) for _ in range(150)]
    sets += [np.setdiff1d(s, s[:1]) for s in sets[:60]]
    cls = rng.integers(0, 40, len(sets))
    frequent = np.arange(0, 60, 3)
    first = [simhash.prefix(s, 0.8, frequent, 1 + frequent % 7) for s in sets]
    many = [len(x) for x in first]
    columns = np.concatenate(first), np.repeat(np.arange(len(sets)), many), np.repeat(cls, many), np.repeat([len(s) for s in sets], many), np.concatenate([np.arange(m) for m in many])
    got = set(map(tuple, simhash._meeting(*columns, 0.8, most).tolist()))
    alike = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if cls[a] != cls[b] and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    assert len(alike) > 30 and alike <= {(min(p), max(p)) for p in got} and len(got) < len(sets) ** 2 / 4


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 900))) for _ in range(2))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], b[: rng.integers(0, 200)])))
        assert simhash.differing(simhash.parity(a), simhash.parity(b)) <= len(np.setxor1d(a, b))
    assert simhash.differing(simhash.parity(a), simhash.parity(a)) == 0


def test_chains_connect_what_all_pairs_connect():
    """At one token, with few rows: the sets that may be alike by their sizes and places."""
    rng = np.random.default_rng(11)
    for k in range(300):
        m = int(rng.integers(1, 40))
        n = rng.integers(1, (12, 60, 400)[k % 3], m)
        pos = (n * rng.random(m) * rng.choice([0.05, 0.2, 1], m)).astype(np.int64)
        may = lambda i, j: min(n[i] - pos[i], n[j] - pos[j]) >= 0.8 / 1.8 * (n[i] + n[j]) - 1e-6 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-6  # noqa: B023, E731
        a, b = simhash.chained(n, pos, 0.8)
        assert len(a) < m
        assert union(zip(a.tolist(), b.tolist(), strict=True)) == union([p for p in itertools.combinations(range(m), 2) if may(*p)])


def test_sets_that_meet_make_no_square_of_rows(spark):
    """400 sets of different classes at each of six tokens: all hang together, by one row for each at most."""
    rows = [(t, i, i, 100, t % 3) for t in range(6) for i in range(400)] + [(9, i, i % 2, 100, 0) for i in range(1000, 1005)]
    got = [tuple(r) for r in simhash.meeting(spark.createDataFrame(rows, "token long, id long, cls long, n int, pos int").repartition(3), 0.8).collect()]
    assert len(got) <= 6 * 400 and union(got) == union([(0, i) for i in range(400)] + [(1000, i) for i in range(1000, 1005)])


def test_alike_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for _ in range(12):
        base = rng.integers(0, 1 << 62, int(rng.integers(3, 80)))
        sets += [np.unique(np.where(rng.random(len(base)) < rng.random() / 5, rng.integers(0, 1 << 62, len(base)), base)) for _ in range(12)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    got = simhash.alike(sets, 0.8)
    assert len(pairs) > 100 and set(got) <= {p for a, b in pairs for p in ((a, b), (b, a))}
    assert union(got) == union(pairs) and len(got) < len(sets)


@pytest.mark.parametrize("options", [{"limit": 0}, {"limit": 0, "group": 7, "broadcast_rows": 0}], ids=str)
def test_a_group_of_near_copies_of_which_some_are_alike(spark, options):
    """One large group, more and less alike than 0.8, that SimHash proposes nothing of."""
    rng = random.Random(23)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(300), k % 10):
            w[at] = f"x{k}-{at}"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts)) + ["", " "]
    rows = [(k, t, "x", "y", 0) for k, t in enumerate(texts)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    sets = [frozenset(simhash.shingle_set(t, 5).tolist()) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations_with_replacement(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert sorted(r.doc_id for r in kept) == sorted(set(union(pairs).values())) and len(kept) > 10


def test_shared_shingles_are_frequent(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(90)) + " a b c" for _ in range(120)] + [None, "one"]
    often = simhash.Frequent.of(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 2, chunk=500)
    sets = [simhash.shingle_set(t, 2) for t in texts]
    s, n = np.unique(np.concatenate(sets), return_counts=True)
    level = often.level(s)
    assert (n >= 64).any() and all((level >= k + 1)[n >= least].all() for k, least in enumerate(often.LEAST))
    other = np.array([rng.getrandbits(62) for _ in range(2000)], np.int64)
    assert (often.level(other) > 0).mean() < 0.3


def line_groups(rows, k=8, threshold=0.8):
    """Lines kept and removed by comparing all pairs of lines."""
    def order(r):
        return (r[0] is None, r[0] or 0)

    seen, occ = set(), []
    for r in sorted(rows, key=order):
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            occ += [(r, n, x.strip(" \t\n\x0b\x0c\r").lower()) for n, x in enumerate((r[1] or "").split("\n"))]
    occ = [o for o in occ if o[2]]
    lines = sorted({o[2] for o in occ})
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in lines]
    groups = union([(lines[i], lines[j]) for i in range(len(lines)) for j in range(i, len(lines)) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9])
    return occ, groups


@given(st.text(alphabet="abcdé ü日", max_size=40))
def test_packed_shingles_are_as_many(x):
    packed = linededup.packed_shingles(x, 8)
    assert packed is None or len(packed) == len(linededup.shingles(x, 8))
    assert (packed is None) == (len(x) < 8 or "日" in x)


@pytest.mark.parametrize("options", [{}, {"chunk": 300, "group": 3, "max_bits": 1, "broadcast_rows": 0}], ids=str)
def test_lines(spark, options):
    """Also in small chunks, with bands cut into blocks, and with lines joined with the bands instead of marked."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    base = [" ".join(word() for _ in range(rng.randint(12, 40))) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(base)
            how = rng.randrange(4)
            if how == 1:
                x = x.upper() + " "
            elif how == 2:
                p = rng.randrange(len(x))
                x = x[:p] + word() + x[p:]
            elif how == 3:
                x = word()
            lines.append(x)
        rows.append((k, "\n".join([*lines, "", " "]), None, None, None))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "aaaaaaaaaaaaaaaaaaaa\nab\nab\nAB", None, None, None), (3, rows[3][1], "x", "y", 1)]
    out = {r.doc_id: r for r in linededup.digest(spark.createDataFrame(rows, SCHEMA).withColumn("removed", F.lit("old")), **options).collect()}
    occ, groups = line_groups(rows)
    first, gone = {}, {}
    for r, n, x in occ:
        if groups[x] in first:
            gone.setdefault(r[0], []).append(n)
        first.setdefault(groups[x], 1)
    assert len(gone) > 30
    for r in rows:
        assert out[r[0]].removed_lines == ",".join(map(str, gone.get(r[0], []))) and out[r[0]].n_lines == (r[1] or "").count("\n") + 1


def test_line_dedup_returns_texts(docs, empty, spark):
    df = spark.createDataFrame([(1, "one long line of text here\nshort\n\n", "n"), (2, "x\nOne long line of text here \n\nshort", "n"), (3, None, "n"), (None, "short", "n")], "doc_id long, text string, n_lines string")
    out = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert out == {1: "one long line of text here\nshort\n\n", 2: "x\n", 3: None, None: ""}
    assert linededup.dedup(docs).count() == docs.count()
    assert linededup.digest(empty).count() == 0 and linededup.dedup(empty).count() == 0


def test_line_dedup_keeps_columns_named_like_those_used_inside(docs):
    names = ["_d", "_t", "_lines", "_row", "lid", "line_no", "norm"]
    out = linededup.dedup(docs.withColumns({c: F.lit(f"own {c}") for c in names}))
    assert out.count() == docs.count() and all(r[c] == f"own {c}" for r in out.collect() for c in names)


def test_lines_of_large_and_mixed_bands(spark):
    """Many variants of one line: no pairs are formed in their component, and what differs stays apart."""
    rng = random.Random(1)
    w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    rows = []
    for k in range(150):
        x = list(w)
        for _ in range(k % 4):
            x[rng.randrange(40)] = "".join(rng.choice("klmnop") for _ in range(6))
        rows.append((k, " ".join(x), None, None, None))
    out = {r.doc_id: r.n_removed for r in linededup.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    occ, groups = line_groups(rows)
    assert sum(1 - v for v in out.values()) == len(set(groups.values()))


def test_lines_in_clusters_around_a_hub(spark):
    """One line, 400 clusters 0.7 alike to it, two lines in each: all share bands with the hub, few are linked to it."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hub = word(200)
    lines = [hub] * 1
    for _ in range(400):
        at = rng.randrange(170)
        x = hub[:at] + word(28) + hub[at + 28 :]
        at = rng.randrange(195)
        lines += [x, x[:at] + word(3) + x[at + 3 :]]
    rows = [(k, x, None, None, None) for k, x in enumerate(lines)]
    rng.shuffle(rows)
    removed = sum(r.n_removed for r in linededup.digest(spark.createDataFrame(rows, SCHEMA)).collect())
    occ, groups = line_groups(rows)
    assert len(occ) == 801 and removed >= 0.99 * (801 - len(set(groups.values()))) and len(set(groups.values())) > 300


def test_lines_of_templates_with_slots(spark):
    """Large bands whose lines are mostly not like their hub: all pairs count, not those with hubs alone."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    fixed, slots = [word(30) for _ in range(5)], [[word(9) for _ in range(8)] for _ in range(3)]
    lines = {" ".join(x for k in range(5) for x in (fixed[k], rng.choice(slots[k]) if k < 3 else "")) for _ in range(150)}
    rows = [(k, x, None, None, None) for k, x in enumerate(sorted(lines, key=lambda _: rng.random()))]
    out = {r.doc_id: r.n_removed for r in linededup.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    _, groups = line_groups(rows)
    assert len(set(groups.values())) < len(rows) / 2
    assert sum(1 - v for v in out.values()) == len(set(groups.values()))
