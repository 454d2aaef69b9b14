"""Vocabulary and token-id encoding.

The reference runs a pretrained subword tokenizer per row.  Here whole words
are encoded against a distributed word count (``encode_tokens``), and
subwords against the piece table of such a tokenizer (``encode_subwords``):
the longest matches of every distinct word are found once, by a join with
that table, whatever the number of texts.  All of it runs in the JVM.  A
tokenizer of another kind can be plugged in through ``encode_with``
(Arrow-batched pandas UDF), loaded once per Python worker.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectspark.functions.text import tokens
from aspectspark.operators.sampling import materialized, ranked
from aspectspark.session import task_count

PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_ID = 4

#: A piece that goes on within a word begins with this; longer words are UNK.
#: Fixed values of the reference's tokenizers.
CONTINUES = "##"
MAX_WORD = 100

#: Most frequent words whose pieces are sent to every task; words of a text
#: that one task puts together again.
FREQUENT = 1 << 16
TASK_WORDS = 1 << 20

#: A piece table of at most so many rows is broadcast (some 30 MB); a larger
#: one meets the substrings in a shuffled join.
PIECES_SENT = 1 << 18


def build_vocab(texts: DataFrame, cols: list[str], size: int | None = None) -> DataFrame:
    """``token, id``: all whitespace tokens of the whole texts, or the
    ``size`` most frequent; ids from 4 by (count desc, md5 of the token).

    Counting is a partial aggregate; ids are two-level ranks, so no task
    holds the vocabulary, whatever its size.  The counts, a row per distinct
    token, are checkpointed: the rank reads them more than once, the texts
    only once."""
    toks = None
    for c in cols:
        t = texts.select(F.explode(tokens(c)).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg((-F.count(F.lit(1))).alias("_less"))
    counts = materialized(counts.withColumn("_okey", F.md5("token")))
    order = ranked(counts, "_okey", ["token"], lead=["_less"], name="_rank")
    if size is not None:
        order = order.filter(F.col("_rank") < size)
    return order.select("token", (F.col("_rank") + FIRST_ID).cast("int").alias("id"))


def encode_tokens(df: DataFrame, key: str, question: str, text: str, vocab: DataFrame,
                  max_len: int = 128, truncate: bool = False) -> DataFrame:
    """``key, window, input_ids, attention_mask`` with layout
    ``CLS question SEP text SEP``, ``max_len`` ids, padded with PAD.

    The words of a text follow each other over as many windows as they fill,
    each with the question in front (cut to leave room for a word), so every
    word is encoded.  ``truncate=True`` keeps the one window of a model's
    fixed input.  A NULL question or text has no words.
    """
    no_words = F.array().cast("array<string>")
    q = F.slice(F.coalesce(tokens(question), no_words), 1, max_len - 4)
    x = df.select(key, q.alias("_q"), F.coalesce(tokens(text), no_words).alias("_t"))
    room = F.lit(max_len - 3) - F.size("_q")
    n = F.lit(1) if truncate else F.greatest(F.lit(1), F.ceil(F.size("_t") / room).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda w: F.concat("_q", F.slice("_t", w * room + 1, room)))
    x = x.select(key, F.size("_q").alias("_nq"), F.posexplode(parts).alias("window", "_w"))
    x = x.select(key, "window", "_nq", F.posexplode_outer("_w").alias("_p", "token"))
    x = x.join(vocab.select("token", F.col("id").alias("_id")), "token", "left")
    item = F.when(F.col("_p").isNotNull(),
                  F.struct("_p", F.coalesce("_id", F.lit(UNK)).alias("id")))
    g = x.groupBy(key, "window", "_nq").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    ids = F.transform("_s", lambda s: s["id"])
    body = F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, F.col("_nq")), F.array(F.lit(SEP)),
                    F.slice(ids, F.col("_nq") + 1, max_len))
    g = g.select(key, "window", F.concat(body, F.array(F.lit(SEP))).alias("_b"))
    pad = F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size("_b"))
    return g.select(
        key, "window",
        F.concat("_b", pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_b")),
                 F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_b"))).alias("attention_mask"))


def _words(texts: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct words of some text columns, and how often each occurs."""
    found = None
    for c in cols:
        w = texts.select(F.explode(tokens(c)).alias("word"))
        found = w if found is None else found.unionByName(w)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _substrings(words: DataFrame, first: int, later: int) -> DataFrame:
    """word, start, len and the substrings that may be pieces: up to
    ``first`` characters from the word's start, up to ``later`` elsewhere."""
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("start"))
    room = F.char_length("word") - F.col("start") + 1
    longest = F.least(F.when(F.col("start") == 1, F.lit(first)).otherwise(F.lit(later)), room)
    each = starts.select("word", "start", F.explode(F.sequence(F.lit(1), longest)).alias("len"))
    part = F.substring(F.col("word"), F.col("start"), F.col("len"))
    return each.withColumn("piece", F.when(F.col("start") == 1, part).otherwise(F.concat(F.lit(CONTINUES), part)))


def build_pieces(texts: DataFrame, cols: list[str], first: int = 4, later: int = 3, min_words: int = 2) -> DataFrame:
    """``piece, id``: the substrings (up to ``first`` characters at the start
    of a word, ``later`` within) of at least ``min_words`` distinct words; ids
    from 4 by (number of words desc, md5 of the piece).  A stand-in for the
    piece table that comes with a pretrained tokenizer."""
    short = _words(texts, cols).filter(F.char_length("word") <= MAX_WORD)
    each = _substrings(short, first, later).select("word", "piece").distinct()
    counts = each.groupBy("piece").agg((-F.count(F.lit(1))).alias("_less")).filter(F.col("_less") <= -min_words)
    order = ranked(materialized(counts.withColumn("_okey", F.md5("piece"))), "_okey", ["piece"], lead=["_less"], name="_rank")
    return order.select("piece", (F.col("_rank") + FIRST_ID).cast("int").alias("id"))


def word_pieces(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``words`` with ``ids``: greedy longest match of every distinct ``word``
    by the pieces of ``vocab`` (piece, id); a word that they do not cover, or of more
    than ``MAX_WORD`` characters, is UNK.

    The substrings of a word, no longer than the longest pieces, meet the
    table in one join; the matches of a word, at most its length times that of
    the longest piece, are then walked from left to right.  With a table of up
    to ``PIECES_SENT`` pieces no substring is shuffled.
    """
    inner = F.col("piece").startswith(CONTINUES)
    size = vocab.agg(F.max(F.when(~inner, F.char_length("piece"))).alias("first"),
                     F.max(F.when(inner, F.char_length("piece") - len(CONTINUES))).alias("later"),
                     F.count(F.lit(1)).alias("n")).first()
    first, later = max(1, size["first"] or 1), max(1, size["later"] or 1)
    short = words.filter(F.char_length("word") <= MAX_WORD)
    table = vocab.select("piece", "id")
    matches = _substrings(short, first, later).join(F.broadcast(table) if size["n"] <= PIECES_SENT else table, "piece")
    match = F.struct("start", (-F.col("len")).alias("less"), "id")
    found = matches.groupBy("word").agg(F.array_sort(F.collect_list(match)).alias("found"))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"), F.lit(False).alias("gap"))

    def step(held, m):      # longer matches of a start come first
        here = (m["start"] == held["at"]) & ~held["gap"]
        return F.struct(F.when(here, held["at"] - m["less"]).otherwise(held["at"]).alias("at"),
                        F.when(here, F.concat(held["ids"], F.array(m["id"]))).otherwise(held["ids"]).alias("ids"),
                        (held["gap"] | (m["start"] > held["at"])).alias("gap"))

    walked = found.select("word", F.aggregate("found", begin, step).alias("walk"))
    whole = ~F.col("walk.gap") & (F.col("walk.at") == F.char_length("word") + 1)
    ids = walked.filter(whole).select("word", F.col("walk.ids").alias("ids"))
    return words.join(ids, "word", "left").select(*words.columns, F.coalesce("ids", F.array(F.lit(UNK))).alias("ids"))


def encode_subwords(df: DataFrame, key: str, question: str, text: str, vocab: DataFrame, max_len: int = 128,
                    truncate: bool = False) -> DataFrame:
    """``key, window, input_ids, attention_mask`` as :func:`encode_tokens`,
    in pieces of words: ``CLS question SEP text SEP``, ``max_len`` ids, over as
    many windows as the pieces of the text fill.  ``key`` names a row.

    The vocabulary work is per distinct word; a word of a text is then one
    row that meets its pieces by a join.  The ``FREQUENT`` most frequent words
    are broadcast for that, so only the others are shuffled by word; all are
    shuffled once by row, in the order of the text, to as many tasks as there
    are words for.
    """
    sides = [F.struct(F.lit(i).alias("side"), F.coalesce(tokens(c), F.array().cast("array<string>")).alias("w"))
             for i, c in enumerate((question, text))]
    x = df.select(key, F.explode(F.array(*sides)).alias("s")).select(key, "s.side", F.posexplode_outer("s.w").alias("pos", "word"))
    pieces = materialized(word_pieces(_words(df, [question, text]), vocab).withColumnRenamed("ids", "_ids"))
    often = F.broadcast(pieces.orderBy(F.desc("n"), "word").limit(FREQUENT).drop("n"))
    known = x.join(often, "word", "left")
    rare = known.filter(F.col("word").isNotNull() & F.col("_ids").isNull()).drop("_ids")
    x = known.filter(F.col("word").isNull() | F.col("_ids").isNotNull()).unionByName(rare.join(pieces.drop("n"), "word"))
    x = x.select(key, "side", "pos", "_ids")
    tasks = task_count(df.sparkSession, pieces.agg(F.sum("n")).first()[0] or 0, TASK_WORDS)
    x = x.repartition(tasks, key) if tasks else x
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "_ids"))
    of = lambda side: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, item))), lambda s: s["_ids"]))
    g = x.groupBy(key).agg(of(0).alias("_q"), of(1).alias("_t")).withColumn("_q", F.slice("_q", 1, max_len - 4))
    room = F.lit(max_len - 3) - F.size("_q")
    n = F.lit(1) if truncate else F.greatest(F.lit(1), F.ceil(F.size("_t") / room).cast("int"))
    one = lambda i: F.array(F.lit(i))
    bodies = F.transform(F.sequence(F.lit(0), n - 1), lambda w: F.concat(
        one(CLS), F.col("_q"), one(SEP), F.slice("_t", w * room + 1, room), one(SEP)))
    g = g.select(key, F.posexplode(bodies).alias("window", "_b"))
    used = F.size("_b")
    return g.select(key, "window", F.concat("_b", F.array_repeat(F.lit(PAD), F.lit(max_len) - used)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_len) - used)).alias("attention_mask"))


def encode_with(df: DataFrame, text: str, fn, max_len: int = 128, pad_id: int = PAD) -> DataFrame:
    """Tokenizer hook: ``fn(list[str], max_len) -> list[list[int]]`` (e.g. a
    pretrained fast tokenizer, which adds its own special tokens), run once
    per Arrow batch in a pandas UDF.  Adds ``input_ids``, padded with
    ``pad_id`` to ``max_len`` (longer lists are cut: the model's fixed
    input), and ``attention_mask``."""
    import pandas as pd

    from aspectspark.session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf("array<int>")
    def _enc(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.tolist(), max_len))

    real = df.withColumn("_ids", F.slice(_enc(F.col(text)), 1, max_len))
    n = F.size("_ids")
    return real.withColumn(
        "input_ids", F.concat("_ids", F.array_repeat(F.lit(pad_id), F.lit(max_len) - n))).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), n),
                                   F.array_repeat(F.lit(0), F.lit(max_len) - n))).drop("_ids")
