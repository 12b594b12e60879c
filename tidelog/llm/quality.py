"""Quality rules: a table of thresholds, compiled into one Spark projection over length, symbol, stop-word and
line figures of every whole text. No user functions; nothing is shuffled.

Defined results: a null or blank text has no words and no lines, and fails; a text of one word or two has no
three-word window; rows are judged one by one, so repeated rows get equal verdicts and an empty table gives an
empty result. Columns of the input with the name of a figure stay, as the figures are returned in one struct.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for with was on be as are by this from at an or not have has but "
    "der die das und in zu den von mit ist des nicht ein eine für auf im dem sich auch als es an "
    "le la les de des du et en un une que qui est dans pour par sur au pas avec ce il plus se "
    "el los las de del que y en un una por con no para es se lo su al como más"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a bound of None is open. Figures are names in ``FIGURES``."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def holds(self, figure) -> Column:
        top, bottom = figure(self.numerator), figure(self.denominator) if self.denominator else F.lit(1)
        checks = [F.lit(True)]
        if self.low is not None:
            checks.append(top >= self.low * bottom)
        if self.high is not None:
            checks.append(top <= self.high * bottom)
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return out


#: The base: it fails before the rules of the table are asked.
BASE = (
    Rule("enough_words", "n_words", low=50),
    Rule("repetition", "n_repeat_words", "n_words", high=0.5),
)
#: The table of thresholds. Ratios are against words, or against lines that hold a word.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("listed_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("cut_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words")


def _repeated(df: DataFrame, w: str, out: str) -> DataFrame:
    """Adds ``out``: words of array ``w`` that lie in a three-word window found twice or more in it.

    Windows are compared by hash: equal neighbours in the sorted hashes give the repeated values; a 64-bit mask of
    these sorts out nearly all other windows, and only what it leaves is sorted with its positions. All is linear
    but for the sorts, whatever the length of the text.
    """
    n = F.size(w)
    df = df.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.sort_array("_h"))
    df = df.withColumn("_d", F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1))))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    df = df.withColumn("_m", F.aggregate("_d", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x))))
    df = df.withColumn("_c", F.when(F.col("_m") == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.col("_m").bitwiseAND(bit(F.get("_h", i))) != 0)))
    df = df.withColumn("_c", F.sort_array(F.transform("_c", lambda i: F.struct(F.get("_h", i).alias("h"), i.alias("i")))))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_c", j)["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_c", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    gap = F.transform("_p", lambda x, j: F.coalesce(F.least(F.lit(3), F.get("_p", j + 1) - x), F.lit(3)))
    return df.withColumn(out, F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_h", "_s", "_d", "_m", "_c", "_p")


def figures(df: DataFrame, text: str = "text", stop_words: Sequence[str] = tuple(STOP_WORDS), into: str = "quality") -> DataFrame:
    """``df`` without its text, with a struct ``into`` of the counts in ``FIGURES`` (all long) of the whole text."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, into)]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = lambda x: F.btrim(x, F.lit(SPACES))
    lines = F.filter(F.split(t, "\n"), lambda x: bare(x) != "")
    plain = df.select(F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"), F.length(t).alias("_length"), F.regexp_replace(t, f"[{SYMBOLS}]", "").alias("_plain"), lines.alias("_lines"), words(t).alias("_w"))
    stop = set(stop_words)
    is_stop = lambda x: F.lower(F.btrim(x, F.lit(".,;:!?\"'()"))).isin(*sorted(stop))
    counted = plain.select(
        "_row",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.col("_length") - F.length("_plain")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: F.substring(bare(x), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: bare(x).endswith("...") | bare(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_w", is_stop)).cast("long").alias("n_stop_words"),
    )
    done = _repeated(counted, "_w", "n_repeat_words")
    # exploded, so that a filter on the figures isn't pushed down, which would compute them again inside each other
    return done.select(*(F.col("_row")[c].alias(c) for c in df.columns if c not in (text, into)), F.explode(F.array(F.struct(*FIGURES))).alias(into))


def verdict(into: str = "quality", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """``(base_failed, kept)`` as expressions over the struct that ``figures`` adds."""
    figure = lambda name: F.col(into)[name]

    def all_of(table: Sequence[Rule]) -> Column:
        out = F.lit(True)
        for r in table:
            out = out & r.holds(figure)
        return out

    return ~all_of(base), all_of(base) & all_of(rules)


def judge(df: DataFrame, text: str = "text", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` without ``text``, with ``quality`` (the figures), ``base_failed`` and ``kept``."""
    failed, kept = verdict("quality", base, rules)
    return figures(df, text).withColumns({"base_failed": failed, "kept": kept})


def keep(df: DataFrame, text: str = "text", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that the rules keep, with their columns."""
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_all"), F.col(f"`{text}`").alias("_text"))
    return judge(whole, "_text", base, rules).where("kept").select(*(F.col("_all")[c].alias(c) for c in df.columns))
