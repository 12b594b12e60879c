from __future__ import annotations

import random
import unicodedata
from collections import Counter
from types import SimpleNamespace

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelog.llm import quality, tokens

from .conftest import table, words


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counter_is_the_library(library):
    c = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert c.by_piece
    rng = random.Random(1)
    letters = [chr(i) for i in range(0x280)] + list("  \n\t'sttredll") * 20 + ["<|endoftext|>", "日", " ", "😀"]
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 15)))
        assert c.count(text) == len(library.encode(text, add_special_tokens=False)), repr(text)


def test_every_assigned_character_is_cut_as_in_the_library(library):
    c = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    known = [x for x in every if not c.foreign(x)]
    assert len(known) > 280_000 and all(unicodedata.category(x) == "Cn" for x in set(every) - set(known))
    for at in range(0, len(known), 20_000):
        s = "".join("a{0}1{0} {0}{0}x  {0}\n{0}".format(x) for x in known[at : at + 20_000])
        assert c.pieces(s) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)]


def test_both_tiers_serve_every_script(library):
    """Curly quotes, dashes, other scripts and pictures: no text is encoded as a whole."""
    c = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    whole, asked = c.whole, []
    c.whole = lambda x: asked.append(x) or whole(x)
    texts = ["It\u2019s \u201cquoted\u201d \u2013 and so on\u2026 ", "Съешь же ещё этих мягких булок. ", "東京都は日本の首都です。", "مرحبا بالعالم ", "\U0001f600\U0001f468\u200d\U0001f469 ok ", "e\u0301\u00a0x\u3000y\u2028z"]
    for text in texts:
        text *= 30
        assert c.count(text) == whole(text) and text not in asked
    assert c.count("\U000e0fff x") == whole("\U000e0fff x")


def test_counts(docs, library):
    out = tokens.count_tokens(docs.withColumn("n_tokens", F.lit("old")))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False))
    for r in out.collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n(r.text), n(r.text) > 1024)
    assert out.count() == docs.count() and "source" in out.columns


def test_cache_is_bounded_and_only_speeds_up(monkeypatch):
    monkeypatch.setattr(tokens, "_MAX_CACHED", 10)
    c = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"), {" the": 1})
    text = " ".join(f"word{k} the" for k in range(300))
    assert c.count(text) == c.whole(text) and len(c.cache) <= 12 and c.cache[" the"] == 1


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(docs, name):
    path = public_tokenizers.path(name)
    c = tokens.Counter(path)
    assert not c.by_piece
    out = tokens.count_tokens(docs.limit(5), path)
    assert all(r.n_tokens == c.count(r.text) for r in out.collect())


def test_token_counts_of_nothing(empty):
    assert tokens.count_tokens(empty).count() == 0


def figures_of(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen: set = set()
    dup = sum(1 for x in lines if x in seen or seen.add(x))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_figures_and_verdict(docs):
    out = quality.judge(docs.withColumn("quality", F.lit(1)).withColumn("copy", F.col("text")))
    assert out.count() == docs.count() and "source" in out.columns
    for r in out.collect():
        n, chars, symbols, dup, repeat = figures_of(r.copy)
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (n, chars, symbols, dup, repeat)
        failed = n < 50 or 100 * repeat > 50 * n
        assert r.base_failed == failed
        f = q.asDict()
        ok = not failed and 2 * n <= chars <= 20 * n and symbols <= 0.1 * n and f["n_stop_words"] >= 0.02 * n and dup <= 0.5 * f["n_lines"] and f["n_bullet_lines"] <= 0.9 * f["n_lines"] and f["n_ellipsis_lines"] <= 0.3 * f["n_lines"]
        assert r.kept == ok


def test_keep_returns_whole_rows(docs, empty):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()
    assert quality.keep(empty).count() == 0 and quality.judge(empty).count() == 0


def test_no_user_functions_and_no_shuffle(docs, spark):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)
    base = [rng.choice(["the", "of", "house", "river", "and", "walked", "slowly", "to", "a", "green", "mountain", "is", "in", "old", "winter"]) + rng.choice(["", "", "ly", "s"]) for _ in range(300)]
    prose = " ".join(base)
    junk = [" ".join(f"{w}%%%" for w in base), " | ".join(base), "spam " * 300, "\n".join(["the same line of text is here"] * 40), " ".join(base[:30]), " ".join(f"zx{k}q" for k in range(300))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([prose, *junk])], "doc_id long, text string")
    assert [r[0] for r in table(quality.keep(df), "doc_id")] == [0]


def test_unassigned_characters_are_looked_for_once_each(monkeypatch):
    """In texts of characters below U+0250, which are all assigned, not at all."""
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    asked: list[str] = []
    category = tokens.unicodedata.category
    monkeypatch.setattr(tokens, "unicodedata", SimpleNamespace(category=lambda c: asked.append(c) or category(c)))
    assert all(category(chr(c)) != "Cn" for c in range(0x250))
    for text in ("été à la façon de Zoë ɏ " * 50, "日本語 é " * 50, "a \u0378 b " * 50, "é \U0003fffe"):
        assert counter.count(text) == counter.whole(text)
        assert counter.foreign(text) == any(category(c) == "Cn" for c in text)
    assert len(asked) < 30 and "ɏ" not in asked and "日" in asked
