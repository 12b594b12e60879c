"""Language identification by the nearest of several centroids per language.

A text is a vector of character n-grams (1 to 3, over lower-case letters with all else as single spaces), hashed
to ``DIMS`` places, weighted by 1 + ln(count) times inverse document frequency and normalised. The vectors of each
language are clustered by spherical k-means; a text gets the language of the centroid with the highest cosine.
``rejected`` tells that the text is farther from it than nearly all texts the language was learned from.

Document frequencies are of all labelled texts, counted where they are read. The centroids are fitted on at most
``per_lang`` texts of each language and ``max_texts`` in all (a stated, seeded sample); they are reduced to vectors where
they are read, so what the driver gets is bounded by ``max_texts`` vectors. More than ``max_langs`` languages are refused.
Every text is predicted whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when there is
nothing to learn from; rows without a language are not learned from; ties go to the language first in order;
repeated rows get equal predictions; a null doc_id counts as an empty one; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 13
DIMS = 1 << BITS
_PIECE = 1 << 20
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """The n-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(codes), _PIECE):  # in pieces, so that memory is bounded; they overlap by two
        x = codes[at : at + _PIECE + 2]
        n = len(x)
        own = min(_PIECE, n)
        h = np.zeros(n, np.uint32)
        for k in range(3):
            if n <= k:
                break
            h = (h[: n - k] if k else h) * _MULT[2] + x[k:] * _MULT[0] + np.uint32(k)
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * _MULT[1]
            out += np.bincount(((mixed ^ (mixed >> np.uint32(13))) & np.uint32(DIMS - 1))[:own], minlength=DIMS)
    return out


def _weights(n: np.ndarray) -> np.ndarray:
    return 1 + np.log(n)


class Model:
    """Centroids of all languages: ``table`` has a row for each n-gram place and a column for each centroid."""

    def __init__(self, langs: list[str], owner: np.ndarray, table: np.ndarray, idf: np.ndarray, least: np.ndarray) -> None:
        self.langs, self.owner, self.table, self.idf, self.least = langs, owner, table, idf, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        n = counts(text)
        if n is None or not self.langs:
            return "und", 0.0, True
        at = np.flatnonzero(n)
        v = _weights(n[at]) * self.idf[at]
        cos = (v @ self.table[at]) / np.sqrt(v @ v)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[self.owner[best]], score, bool(score < self.least[self.owner[best]])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means of unit rows; starts far apart."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        far = 1 - (x @ centres.T).max(axis=1)
        if far.max() < 1e-9:
            break
        centres = np.concatenate((centres, x[[int(np.argmax(far))]]))
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        new = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``texts (text)`` each n-gram place is, and how many have a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                n = counts(text.as_py())
                if n is not None:
                    total[:DIMS] += n > 0
                    total[DIMS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in texts.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def fit(labelled: DataFrame, per_lang: int = 1000, max_texts: int = 20_000, centroids: int = 4, rounds: int = 12, quantile: float = 0.002, max_langs: int = 500, seed: int = 5) -> Model:
    """A model from ``labelled (doc_id, text, lang)``; its centroids are of at most ``per_lang`` texts for each language and
    ``max_texts`` in all."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return Model([], np.zeros(0, np.int64), np.zeros((DIMS, 0), np.float32), np.zeros(DIMS), np.zeros(0))
    per_lang = max(1, min(per_lang, max_texts // len(sizes)))
    df, total = document_frequencies(labelled)
    # thinned to little more than the sample by a seeded hash, then cut exactly
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, (per_lang + 6 * per_lang**0.5 + 20) / v))))
    thin = labelled.withColumn("_u", u).where(F.col("_u") < rate[F.col("lang")])
    thin = thin.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))).where(F.col("_n") <= per_lang)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                n = counts(text.as_py())
                if n is not None:
                    at = np.flatnonzero(n)
                    rows.append({"lang": lang, "at": at.astype(np.uint16).tobytes(), "n": n[at].astype(np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

    by_lang: dict[str, list] = {}
    for r in thin.select("lang", "text").mapInArrow(vectors, "lang string, at binary, n binary").collect():
        by_lang.setdefault(r["lang"], []).append((r["at"], r["n"]))
    for rows in by_lang.values():
        rows.sort()
    idf = np.log((1 + total) / (1 + df)) + 1
    langs, owner, columns, least = sorted(by_lang), [], [], []
    rng = np.random.default_rng(seed)
    for k, lang in enumerate(langs):
        x = np.zeros((len(by_lang[lang]), DIMS), np.float32)
        for i, (at, n) in enumerate(by_lang[lang]):
            at = np.frombuffer(at, np.uint16)
            x[i, at] = _weights(np.frombuffer(n, np.float32)) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = _kmeans(x, centroids, rounds, rng)
        least.append(float(np.quantile((x @ centres.T).max(axis=1), quantile)) * 0.9)
        owner += [k] * len(centres)
        columns.append(centres)
    table = np.concatenate(columns).T.astype(np.float32) if columns else np.zeros((DIMS, 0), np.float32)
    return Model(langs, np.array(owner, np.int64), np.ascontiguousarray(table), idf, np.array(least))


def fold(doc_id: str | Column = "doc_id", folds: int = 3) -> Column:
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``. Nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out_type = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([dict(zip(("lang_pred", "score", "rejected"), shared.value.predict(t.as_py()), strict=True)) for t in batch], out_type)

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*rest, judge(F.col(f"`{text}`")).alias("_x")).select(*rest, "_x.*")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Learns from the documents outside fold 1 of 3 and predicts all."""
    model = fit(docs.where(fold() != 1).select("doc_id", "text", "lang"), **options)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")
