from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing, sharding

from .conftest import table, words


def test_targets():
    assert mixing.targets([100, 100], [1, 1]) == [150, 150]
    assert mixing.targets([100, 900], [5, 2]) == [200, 1300]  # 200 is the first one's bound
    assert mixing.targets([10, 10, 1000], [5, 2, 1]) == [20, 20, 1490]
    assert mixing.targets([0, 10], [5, 1]) == [0, 15] and mixing.targets([], []) == []


def quotients(shares, seats):
    got = [0] * len(shares)
    for _ in range(seats):
        k = max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


@pytest.mark.parametrize(("shares", "seats"), [([53, 24, 23], 7), ([1, 1, 1], 10), ([5.5, 0, 2.25, 1e-3], 101), ([7], 3), ([3, 1], 0), ([10, 10, 10, 10], 6)])
def test_sainte_lague(shares, seats):
    assert mixing.sainte_lague(shares, seats) == quotients(shares, seats)
    assert mixing.sainte_lague([0, 0], 5) == [0, 0] and mixing.sainte_lague([], 5) == []


def test_mix(docs, rows):
    out = mixing.digest(docs)
    found = out.collect()
    assert len(found) == len(rows) and table(out, *out.columns) == table(mixing.digest(docs.repartition(5)), *out.columns)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken: dict = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(32, 0.01 * goal[s])


def test_block_selection_by_brute_force(docs, rows, spark):
    """The whole mix computed anew, document by document and word by word."""
    seed, block, each = 11, 4, 256
    options = {"shard_words": each, "blocks": each // block}
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    h = {r.doc_id: (r.h, r.s) for r in some.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).withColumn("s", F.xxhash64(F.lit(seed + 1), "h")).collect()}
    size = {r.doc_id: len(words(r.text)) for r in some.collect()}
    source = {r.doc_id: r.source for r in some.collect()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    # targets by filling step by step
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, left, open_ = {}, 1.5 * sum(total.values()), [s for s in names if total[s]]
    while True:
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]
        if not full:
            break
        goal |= {s: 2 * total[s] for s in full}
        left -= sum(goal[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    goal |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    quota = quotients([goal.get(s, 0) for s in names], round(sum(goal.values()) / block))
    rng, expected = np.random.default_rng(seed), {}
    for s, q in zip(names, quota, strict=True):
        parts = max(1, total[s] // each)
        shards: dict = {}
        for d in sorted((d for d in size if source[d] == s), key=lambda d: (h[d][0], d)):
            shards.setdefault(h[d][1] % parts, []).append(d)
        n = {k: sum(size[d] for d in v) for k, v in sorted(shards.items())}
        for (k, words_), blocks in zip(n.items(), quotients(list(n.values()), q) if sum(n.values()) else [0] * len(n), strict=True):
            m = max(1, round(words_ / block))
            blocks = min(blocks, 2 * m)
            first = int(rng.integers(m))
            run = [(first + j) % m for j in range(blocks % m)]
            line = [d for d in shards[k] for _ in range(size[d])]
            expected |= {d: size[d] * (blocks // m) for d in shards[k]}
            for b in run:
                for d in line[b * words_ // m : (b + 1) * words_ // m]:
                    expected[d] += 1
    got = {r.doc_id: r.taken for r in mixing.digest(some, **options).collect()}
    assert got == expected and len({h[d][1] for d in h}) > 30


def test_columns_named_like_those_used_inside_stay(docs):
    names = ["_h", "_no", "_shard", "_size", "_in", "_end", "_bucket", "_stratum", "_slice", "_place", "_total", "_p", "_row", "_o0", "n"]
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    for out in (sharding.shard(clash, 4), mixing.mix(clash.withColumn("size", F.lit(3)))):
        assert all(r[c] == f"own {c}" for r in out.collect() for c in names)


def test_resample_gives_whole_documents(docs, empty):
    out = mixing.resample(docs.withColumn("size", F.lit("old")).withColumn("target", F.lit(1)))
    assert out.columns == [*docs.columns, "size", "target"]
    copies = {tuple(r) for r in out.select("doc_id", "text").collect()}
    assert copies <= {tuple(r) for r in docs.select("doc_id", "text").collect()} and (103, None) not in copies
    assert mixing.resample(empty).count() == 0 and mixing.digest(empty).count() == 0


def test_too_many_sources_are_refused(docs):
    with pytest.raises(ValueError, match="sources"):
        mixing.digest(docs, max_sources=2)


@pytest.mark.parametrize("shards", [1, 16, 200])
def test_shards(docs, rows, shards):
    out = sharding.digest(docs, shards).collect()
    assert len(out) == len(rows)
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out)
    assert got == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_every_shard_has_the_mixture(spark):
    df = spark.range(3200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise("c").alias("source"), F.lit("x").alias("text"))
    out = sharding.digest(df).groupBy("shard", "source").count().collect()
    assert {(r.source, r["count"]) for r in out} == {("a", 50), ("b", 50), ("c", 100)}


def test_interleaving_matches_a_plain_sort(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.sqrt("id") % 5).cast("string")).alias("source"))
    placed = sharding.interleave(df, "source", ["doc_id"], each=50).select("doc_id", "source", "_place").collect()
    h = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(10)).alias("b"), F.xxhash64(F.lit(7), "doc_id").alias("x")).select("doc_id", F.struct("b", "x").alias("h")).collect()}
    by: dict = {}
    for r in placed:
        by.setdefault(r.source, []).append(r.doc_id)
    at = {}
    for s, ids in by.items():
        for k, d in enumerate(sorted(ids, key=lambda d: tuple(h[d]))):
            at[d] = (2 * k + 1) / (2 * len(ids))
    order = [r.doc_id for r in sorted(placed, key=lambda r: r._place)]
    assert [r._place for r in sorted(placed, key=lambda r: r._place)] == list(range(1, 501))
    assert all(at[a] <= at[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))


def test_shard_keeps_columns(docs, empty):
    out = sharding.shard(docs.withColumn("slot", F.lit("old")), 4)
    assert set(out.columns) == {*docs.columns, "shard", "slot"} and out.count() == docs.count()
    assert sharding.digest(empty).count() == 0


def test_native(docs):
    plan = sharding.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
