from __future__ import annotations

import collections
import math
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import langid, lm
from tidelog.llm.queries import OP2_SQL

from .conftest import lower, words


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


@pytest.fixture(scope="module")
def letters(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        alphabet = ("abcdefg", "klmnopq", "äöüß")[k % 3]
        text = " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 6))) for _ in range(rng.integers(3, 40)))
        rows.append((k, text, ("aa", "kk", None)[k % 3] if k % 3 < 2 else ("uu" if k % 6 == 5 else None)))
    rows += [(1000, None, "aa"), (1001, "", "kk"), (1002, "123 ... !", "aa"), (1003, "x", None), (None, "abc dab gaf", "aa"), (1004, "abcdefg " * 20_000, None), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_language_of_held_out_texts(letters):
    out = langid.digest(letters.withColumn("score", F.lit("old")), per_lang=40).join(letters.select("doc_id", "text", "lang").distinct(), "doc_id", "left").collect()
    for r in out:
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in ("aa", "kk", "uu")
    known = [r for r in out if r.lang and r.held_out and r.lang_pred != "und"]
    assert len(known) > 40 and all(r.lang == r.lang_pred for r in known)
    assert next(r for r in out if r.doc_id == 1004).lang_pred == "aa"


def dense_vector(text, weigh):
    """The weighted n-gram vector of a text, string by string; None without a letter."""
    text = (text or "").lower()
    if not any(x.isalpha() for x in text):
        return None
    s = " " + "".join(x if x.isalpha() else "\0" for x in text) + "\0"
    while "\0\0" in s:
        s = s.replace("\0\0", "\0")
    s = s.replace("\0", " ")
    if not text[-1].isalpha():  # the run of others at the end, and the end
        s += " "
    n = collections.Counter()
    for size in (1, 2, 3):
        for i in range(len(s) - size + 1):
            h = 0
            for k, x in enumerate(s[i : i + size]):
                h = (h * 0xC2B2AE3D + ord(x) * 0x9E3779B1 + k) % 2**32
            h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
            n[(h ^ h >> 13) % langid.DIMS] += 1
    v = np.zeros(langid.DIMS)
    for at, x in n.items():
        v[at] = weigh(at, x)
    return v


def test_model_against_a_dense_one(letters):
    """Document frequencies of all labelled texts, centroids that are the means of what is nearest to them, and labels
    by the greatest cosine, computed anew."""
    rows = [r for r in letters.select("doc_id", "text", "lang").distinct().collect() if r.doc_id != 1004]
    docs = letters.where("doc_id <> 1004").dropDuplicates(["doc_id", "text"])
    model = langid.fit(docs, per_lang=10**6, centroids=3, rounds=100)
    learned = [r for r in rows if r.lang and r.doc_id is not None and dense_vector(r.text, lambda at, x: x) is not None]
    df = sum((dense_vector(r.text, lambda at, x: 1) for r in learned), np.zeros(langid.DIMS))
    idf = np.log((1 + len(learned)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf)
    unit = lambda text: (lambda v: v / np.linalg.norm(v))(dense_vector(text, lambda at, x: (1 + math.log(x)) * idf[at]))
    for k, lang in enumerate(model.langs):
        x = np.stack([unit(r.text) for r in learned if r.lang == lang])
        own = model.table[:, model.owner == k].T
        near = np.argmax(x @ own.T, axis=1)
        for c in range(len(own)):
            mean = x[near == c].sum(axis=0)
            assert np.allclose(own[c], mean / np.linalg.norm(mean), atol=1e-3)
    for r in rows:
        lang, score, _ = model.predict(r.text)
        if (v := dense_vector(r.text, lambda at, x: (1 + math.log(x)) * idf[at])) is None:
            assert (lang, score) == ("und", 0)
        else:
            cos = v @ model.table / np.linalg.norm(v)
            assert lang == model.langs[model.owner[int(np.argmax(cos))]] and score == pytest.approx(min(1, max(0, cos.max())), abs=1e-5)


def test_the_sample_is_bounded(letters):
    model = langid.fit(letters, per_lang=40, max_texts=9)
    assert len(model.langs) == 3 and model.table.shape[1] <= 9


def test_prediction_uses_the_text_alone(letters):
    model = langid.fit(letters, per_lang=30)
    plain = langid.predict(letters, model).select("doc_id", "text", "lang_pred", "score")
    other = langid.predict(letters.withColumns({"lang": F.lit("zz"), "lang_pred": F.lit("zz")}), model).select("doc_id", "text", "lang_pred", "score")
    assert sorted(map(str, plain.collect())) == sorted(map(str, other.collect()))


def test_far_texts_are_rejected_and_nothing_can_be_learned_from_nothing(letters, empty):
    model = langid.fit(letters, per_lang=50)
    assert model.predict("абвгд еёжз " * 5)[2] and not model.predict("abcdefg abc cad gfe")[2]
    assert langid.fit(letters.limit(0)).predict("abc") == ("und", 0.0, True)
    assert langid.digest(empty).count() == 0


def test_ngram_counts_in_pieces(monkeypatch):
    text = "Some text, with: ümlauts and 12 numbers " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_PIECE", 64)
    assert (langid.counts(text) == whole).all()
    n = 1 + 30 * len("some text with ümlauts and numbers ") + 1  # a space before and after
    assert whole.sum() == n + (n - 1) + (n - 2) and langid.counts("1 2") is None


def brute_lm(rows, priors):
    """The whole model, with every n-gram that training has, and each text's score by recursion."""
    tok = [["<s>", *words(lower(t or "")), None] for _, t, *_ in rows]
    train = [k for k, r in enumerate(rows) if fold(r[0], 10) != 0]
    c = collections.Counter()
    for k in train:
        for size in (1, 2, 3):
            c.update(tuple(tok[k][i : i + size]) for i in range(len(tok[k]) + 1 - size))
    n = sum(len(tok[k]) - 1 for k in train)
    vocabulary = {g[0] for g in c if len(g) == 1 and g != ("<s>",)}
    z = n + 0.1 * (len(vocabulary) + 1)

    @cache
    def p(w, h):
        if not h:
            return ((c[w,] if w != "<s>" else 0) + 0.1) / z
        k = priors[len(h) - 1]
        return (c[*h, w] + k * p(w, h[1:])) / (c[h] + k)

    score = [sum(math.log10(p(t[i], tuple(t[max(0, i - 2) : i]))) for i in range(1, len(t))) for t in tok]
    base = [sum(math.log10((c[w,] + 0.1) / z) for w in t[1:]) for t in tok]
    return [t[1:] for t in tok], c, n, base, score, p, vocabulary


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 300, "part_tokens": 700}, {"chunk_tokens": 40, "part_tokens": 100, "priors": (3.0, 0.5)}], ids=str)
def test_scores(docs, rows, options):
    """Also in small chunks and many parts."""
    got: dict = {}
    for r in lm.digest(docs.withColumns({"score": F.lit("old"), "rest": F.lit(1)}), **options).collect():
        got.setdefault((r.doc_id, r.n_tokens), []).append(r)
    tok, c, n, base, score, *_ = brute_lm(rows, options.get("priors", lm.PRIORS))
    for k, r in enumerate(rows):
        same = got[r[0], len(tok[k])]
        for x in same:
            assert x.train_tokens == n and x.held_out == (fold(r[0], 10) == 0) and x.n_known == sum(c[w,] > 0 for w in tok[k])
            assert x.base_score == pytest.approx(base[k], abs=1e-6) and x.score == pytest.approx(score[k], abs=1e-6)
    assert sum(map(len, got.values())) == len(rows)


def test_the_model_is_a_distribution(rows):
    """After any history, known or not, the probabilities of the words, the end and one unseen sum to one."""
    *_, p, vocabulary = brute_lm(rows, lm.PRIORS)
    for h in ((), ("<s>",), ("the",), ("of", "the"), ("never", "seen"), ("never", "the")):
        assert sum(p(w, h) for w in [*vocabulary, "unseen word"]) == pytest.approx(1)


def test_scores_keep_further_columns(docs, rows):
    out = lm.score(docs.withColumns({"n_known": F.lit("old"), "train": F.lit("x"), "chunk": F.array(F.lit(1))}), F.col("lang").isNull()).collect()
    assert sorted((str(r.doc_id), str(r.lang), str(r.source), r.n_chars or 0) for r in out) == sorted((str(r[0]), str(r[2]), str(r[3]), r[4] or 0) for r in rows)
    assert all(r.train == "x" and r.chunk == [1] and r.score < 0 for r in out)
    nothing = lm.score(docs, F.lit(False)).collect()
    assert len(nothing) == len(rows) and all(r.score == r.base_score == 0 and r.train_tokens == r.n_known == 0 for r in nothing)


def test_a_source_that_changes_is_an_error(spark):
    """Rows whose order changes between two reads, and with it the chunks."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 50, F.round(F.rand() * 1000)).alias("text"))
    docs = docs.withColumn("text", F.concat("text", F.lit(" "), F.expr("uuid()")))
    counter = spark.sparkContext.accumulator(0)
    with pytest.raises(Exception, match="settle them first"):
        lm.score(docs.mapInPandas(lambda it: (counter.add(1) or x.sample(frac=1) for x in it), "doc_id long, text string"), F.lit(True), chunk_tokens=100).collect()


@given(st.lists(st.integers(0, (1 << 64) - 1)))
def test_packed_numbers(x):
    assert lm._unpack(lm._pack(np.array(x, np.uint64))).tolist() == x


def test_lm_of_nothing(empty, docs):
    assert lm.digest(empty).count() == 0
    only = docs.where("doc_id = 103")
    assert lm.digest(only).first().n_tokens == 1


def test_pipeline(spark, docs, rows, tmp_path):
    """What each stage keeps, computed anew from what the stage before it kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mix", "shards"]
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    passage = docs.where("doc_id = 113").first().text
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    sf, at, kept = str(tmp_path / "sf"), docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf).cache()
        assert at.columns == docs.columns, name
        kept[name] = sorted(((r.doc_id, r.text) for r in at.collect()), key=str)

    @cache
    def grams(t):
        w = lower(t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


    # quality rules: the verdict of each row
    assert kept["quality rules"] == sorted(duckdb_kept(rows), key=str)
    # near-duplicates: of each group of texts connected by 0.8 of their shingles, the smallest doc_id
    left, groups = kept["quality rules"], []
    for d, t in left:
        near = [g for g in groups if any(len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u)) for _, u in g)]
        groups = [g for g in groups if g not in near] + [[(d, t), *(x for g in near for x in g)]]
    first = lambda g: min(g, key=lambda x: (x[0] is None, x[0] or 0))
    assert sorted((first(g)[0] for g in groups), key=str) == sorted((d for d, _ in kept["near-duplicates"]), key=str)
    # decontamination: those without 0.8 of the passage's shingles
    item = grams(passage)
    assert kept["decontamination"] == [(d, t) for d, t in kept["near-duplicates"] if len(grams(t) & item) < 0.8 * len(item)]
    assert len(kept["near-duplicates"]) > len(kept["decontamination"])
    # mix: whole documents, at most twice each
    copies = collections.Counter(kept["mix"])
    assert set(copies) <= set(kept["decontamination"]) and max(copies.values()) <= 2
    out = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, _ in kept["mix"])
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes[k] for k in range(16)) <= 1
    assert not list((tmp_path).glob("pipeline-*"))


def duckdb_kept(rows):
    """The rows that the quality rules' SQL keeps."""
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": [r[1] for r in rows]}))
    return [rows[r[0]][:2] for r in con.execute(f"SELECT doc_id FROM ({OP2_SQL}) WHERE kept").fetchall()]
