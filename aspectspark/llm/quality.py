"""Quality rules: a threshold table compiled into one projection.

DataFrame functions only; no shuffle, no user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectspark.llm.common import WORD_RUN, word_array

#: Fixed word lists: frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the and of to in is that it for was on are as with at this or be by from".split(),
    "de": "der die und das ist nicht ein eine zu von den mit sich des im als auf".split(),
    "fr": "le la les de des et un une que est en du dans pour ne avec sur".split(),
    "es": "el los las la de y que en un una por con del se es no para".split(),
}

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A document breaks the rule if ``metric`` lies outside ``[low, high]``
    and it has at least ``min_words`` words."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 0


#: Published web-corpus ranges, widened where clean text of one of the four
#: languages comes near them.
RULES = (
    Rule("length", "n_words", 10, None),
    Rule("mean_word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamations", "exclamation_ratio", None, 0.3),
    Rule("upper_case", "upper_ratio", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.01, None, 50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3, 50),
)


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in a regular expression's class."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more.

    Window hashes decide cheaply that no window repeats (all hashes
    differ); only other texts take the exact path, which sorts the windows
    themselves with their positions and adds up the words that windows with
    an equal neighbour cover.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[words[i + k] for k in range(5)]))

    def window(i: Column) -> Column:
        return F.struct(F.array(*[words[i + k] for k in range(5)]).alias("w"), i.alias("i"))

    def covered(order: Column) -> Column:
        near = F.transform(order, lambda e, k: F.struct(
            e["i"].alias("i"),
            (((k > 0) & (e["w"] == F.get(order, k - 1)["w"]))
             | F.coalesce(e["w"] == F.get(order, k + 1)["w"], F.lit(False))).alias("twice")))
        at = F.sort_array(F.transform(F.filter(near, lambda e: e["twice"]), lambda e: e["i"]))
        added = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")))
        return added["n"].cast("long")

    exact = F.transform(F.array(F.array_sort(F.transform(starts, window))), covered)[0]
    return (F.when(F.size(words) < 6, F.lit(0).cast("long"))
            .when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long"))
            .otherwise(exact))


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_RUN)))


def rule_metrics(text: Column, words: Column, lines: Column, stop_words: Sequence[str]) -> dict[str, Column]:
    """The metrics that rules can name; the ratios use the counts."""
    stop = sorted(set(stop_words))
    plain = F.split(F.lower(text), "[\\x20\\x09-\\x0D.,;:!?]+")
    n_words, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_upper": _count_of(text, "A-Z"),
        "n_exclamations": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "n_stop_words": F.size(F.filter(plain, lambda w: w.isin(stop))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rlike(x, F.lit("(\\.\\.\\.|…)\\s*$")))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "mean_word_length": F.col("word_chars") / n_words,
        "symbol_ratio": F.col("n_symbols") / n_words,
        "exclamation_ratio": F.col("n_exclamations") / n_words,
        "upper_ratio": F.col("n_upper") / letters,
        "stop_word_ratio": F.col("n_stop_words") / n_words,
        "dup_line_ratio": F.col("n_dup_lines") / n_lines,
        "ellipsis_line_ratio": F.col("n_ellipsis_lines") / n_lines,
    }


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean: some rule of the table is broken."""
    broken = F.lit(False)
    for rule in rules:
        value = F.col(rule.metric)
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        broken = broken | (out & (F.col("n_words") >= rule.min_words))
    return broken


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
            stop_words: Sequence[str] = tuple(w for ws in STOP_WORDS.values() for w in ws)) -> DataFrame:
    """Every row of ``docs`` as a struct column ``doc``, the counts, the
    ratios, ``base_failed`` and ``kept``.

    ``base_failed``: under 10 words, or over a fifth of the words lie in
    5-word windows that repeat within the text.  ``kept``: not that, and no
    rule of the table broken.  Null and empty texts have no words and fail.
    Rows are judged one by one, so ties, repeated rows and columns of any
    name do not matter.
    """
    metrics = rule_metrics(F.col("text"), F.col("words"), F.col("lines"), stop_words)
    counts = {k: v for k, v in metrics.items() if k.startswith("n_") or k == "word_chars"}
    ratios = {k: v for k, v in metrics.items() if k not in counts}
    base = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = base.select("doc", "text", word_array(F.col("text")).alias("words"),
                        filled_lines(F.col("text")).alias("lines"))
    counted = words.select("doc", *[v.alias(k) for k, v in counts.items()])
    rated = counted.select("*", *[v.alias(k) for k, v in ratios.items()])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rated.select("*", failed.alias("base_failed"), (~failed & ~compile_rules(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    The condition names a row number: a filter is not pushed below a
    projection that makes one.  Pushed down it would compute all metrics
    twice, and the word array again for each of its elements.
    """
    judged = quality(docs, rules, text_col).withColumn("row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("row") >= 0)).select("doc.*")
