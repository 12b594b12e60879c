"""Token counts by a two-tier lookup on the map side.

First tier: a table of the token lengths of frequent pre-tokens, broadcast. Which are frequent is found over all
documents by mergeable sketches of fixed size, so no pre-token is shuffled; the table has ``frequent`` entries at
most. Second tier: each Python worker encodes what the table lacks, once, and keeps the length in a cache of
bounded size. Either tier holds what the tokenizer's own library returns, so the tiers affect only the speed.

A text is cut into pre-tokens here where that is as in the library: for a byte-level tokenizer with the usual pattern,
whatever the script, by the categories of Unicode. Only a text with a character that this Python's tables don't have
assigned (the library's may) is cut by the library, and any other tokenizer encodes whole texts.

Defined results: a null or empty text has 0 bytes and 0 tokens; whole texts of any length are counted, nothing is
cut or padded; special tokens are not added, their strings inside a text count as the library's default has it;
repeated rows and further columns stay (columns named like the results are replaced); no rows give no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Fixed value: the pattern of the sketch pass, for Java; it only proposes table entries.
JAVA_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern's white space is.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_MAX_CACHED = 300_000
_LONG = 128


@cache
def _classes(below: int = 0x110000) -> dict[str, str]:
    """Letters (L), numbers (N), white space (S) and unassigned code points (Cn) below a bound, as what stands between
    the brackets of a pattern."""
    ends: dict[str, list[list[int]]] = {"L": [], "N": [], "S": [], "Cn": []}
    for c in range(below):
        kind = unicodedata.category(chr(c))
        kind = "S" if c in WHITE_SPACE else kind if kind == "Cn" else kind[0] if kind[0] in "LN" else ""
        if kind:
            its = ends[kind]
            if its and its[-1][1] == c - 1:
                its[-1][1] = c
            else:
                its.append([c, c])
    return {kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in its) for kind, its in ends.items()}


def _pattern(below: int) -> re.Pattern:
    """The pattern for texts of characters below a bound: the shorter its classes, the faster it is."""
    letters, numbers, spaces = (_classes(below)[k] for k in "LNS")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Counter:
    """Counts tokens with one tokenizer file; ``frequent`` is the first tier."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None) -> None:
        self.frequent, self.cache, self.by_piece = frequent or {}, dict(frequent or {}), False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(model.encode(text, num_threads=1))
            return
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.whole = lambda text: len(self.tokenizer.encode(text, add_special_tokens=False))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        simple = not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip"))
        self.by_piece = bool(plain and byte_level and simple)
        if self.by_piece:
            self.ascii, self.latin, self.all = (_pattern(below).findall for below in (0x80, 0x250, 0x110000))
            self.beyond = re.compile("[^\\x00-\\u024f]").search
            names = sorted((a["content"] for a in added), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def pieces(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.all if self.beyond(text) else self.latin)(text)

    def foreign(self, text: str) -> bool:
        """Whether a character of a text isn't assigned; all below U+0250 are. A search by a pattern of all the ranges takes
        longer than all else."""
        return bool(self.beyond(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))

    def miss(self, piece: str) -> int:
        n = self.whole(piece)
        if len(piece) <= _LONG:
            if len(self.cache) >= _MAX_CACHED + len(self.frequent):
                self.cache = dict(self.frequent)
            self.cache[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_piece or not text.isascii() and self.foreign(text):
            return self.whole(text)
        if self.special is None:
            parts = [text]
        else:
            parts = self.special.split(text)
        total = len(parts) - 1
        for part in parts:
            found = [(self.cache.get(p) or self.miss(p)) for p in self.pieces(part)]
            total += sum(found)
        return total


def frequent_pieces(docs: DataFrame, text: str = "text", frequent: int = 8192, tracked: int = 32_768, groups: int = 64) -> list[str]:
    """At most ``frequent`` pre-tokens that sketches over all texts hold for the most frequent."""
    pieces = docs.select(F.spark_partition_id().alias("_p"), F.explode(F.regexp_extract_all(text, F.lit(JAVA_PIECES), F.lit(0))).alias("_piece"))
    pieces = pieces.select(F.pmod("_p", F.lit(groups)).alias("_g"), "_piece").where(F.length("_piece") <= _LONG)
    each = settle(pieces.groupBy("_g").agg(F.expr(f"approx_top_k_accumulate(_piece, {tracked})").alias("_s")))
    if each.isEmpty():
        return []
    # in one partition, as the function that combines can't start from a partition without rows
    top = each.repartition(1).agg(F.expr(f"approx_top_k_combine(_s, {tracked})").alias("_s")).select(F.expr(f"approx_top_k_estimate(_s, {frequent})").alias("_top"))
    return [r["item"] for r in (top.first()["_top"] or [])]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", frequent: int = 8192, limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``. ``path``: a .json or .model tokenizer file, at the
    same place on every machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    here = Counter(path)
    lengths: dict[str, int] = {}
    if here.by_piece and frequent:
        lengths = {p: here.whole(p) for p in frequent_pieces(docs, text, frequent) if not (here.special and here.special.search(p))}
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path, shared.value)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(f"`{text}`"))})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
