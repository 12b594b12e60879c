"""A small corpus with the awkward cases, and the reference computations in plain Python."""

from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WS.findall(text or "")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus() -> list[tuple]:
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(150)] + ["the", "of", "and", "to", "is", "in"] * 12
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    passage = text(45)
    docs: list[tuple] = []
    for k in range(40):
        t = text(rng.randint(5, 220))
        if k % 7 == 0:
            t += " " + passage + " " + text(20)
        docs.append((k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 9 else None, len(t)))
    long = text(20_000)
    docs += [(100, docs[3][1], "en", "s0", 1), (101, docs[3][1], "en", "s1", 1), (102, docs[3][1].replace("the", "The"), "en", "s1", 1)]
    docs += [(103, None, "en", "s0", None), (104, "", "en", None, 0), (105, " \n\t \x0b\n", None, "s1", 5), (106, "one", "en", "s0", 3), (107, "two words", "en", "s0", 9)]
    docs += [(108, "a b c d e " * 60, "en", "s2", 600), (109, long, "en", "s3", len(long)), (110, "é ü 12 <|endoftext|>日本語 #|% …\r\nX\x1cY\u0085z", "fr", "s2", 30)]
    docs += [(5, docs[5][1], *docs[5][2:]), (None, docs[7][1], "en", "s1", 2), (None, "a text without an id, " * 12, None, None, None)]
    docs += [(111, "line one is quite long here\nline two, another long one\nline one is quite long here", "en", "s0", 1)]
    docs += [(112, docs[2][1] + " tail", "en", "s0", 1), (113, passage, "en", "s9", 1)]
    return docs


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique(docs):
    """The corpus without rows that share a doc_id."""
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()


def table(df, *columns):
    """Rows as sorted tuples, nulls last."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
