"""Line dedup by a log-template tree.

A line's tokens with a digit are variable fields.  The tree has a fixed
depth: token count, then leading tokens.  In a leaf, lines that agree with
its most frequent line in most tokens share one template, whose differing
tokens are variable too; of the lines left, the most frequent one leads
next, until no two of them agree.  Templates that recur across documents are
dropped but for their first line.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectspark.llm.common import bloom_filter, materialize, might_contain, spread_keys, text_key

#: Leading tokens that, with the token count, lead to a leaf.
DEPTH = 3

#: A line belongs to its leaf's template if so many of its tokens agree.
SIMILARITY = 0.8

#: A template recurs from this number of documents on; one of so many tokens
#: or more is no chance match and recurs from two on.
MIN_DOCS = 3
LONG = 8
MIN_DOCS_LONG = 2

#: First lines of a block that are compared in the first round, and at most
#: (up to this number Spark limits a ranking before the shuffle).
FIRST_FRONT = 32
FRONT = 1000

VARIABLE = "<*>"

#: A token with a digit.  It is tried at token starts alone, so a long token
#: without a digit is read once.
FIELD = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def line_tokens(line: Column) -> Column:
    """The line with single blanks between tokens and variable fields marked."""
    plain = F.when(F.rlike(line, F.lit("[\\x09\\x0B-\\x0D]")), F.translate(line, "\t\u000b\f\r", "    ")).otherwise(line)
    flat = F.trim(F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain))
    return F.when(F.rlike(flat, F.lit("[0-9]")), F.regexp_replace(flat, FIELD, VARIABLE)).otherwise(flat)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), *text_key(text), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """id, t1, t2, number, and template of each line with a word: a digest of
    its tokens, their count, and the leaf."""
    split = rows.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    tokens = split.where(F.rlike("raw", F.lit("[^\\x20\\x09-\\x0D]"))).select(
        "id", "t1", "t2", "line", line_tokens(F.col("raw")).alias("tokens"))
    size = F.char_length("tokens") - F.char_length(F.replace("tokens", F.lit(" "), F.lit(""))) + 1
    return tokens.select("id", "t1", "t2", "line", F.unhex(F.md5("tokens")).alias("own"), size.alias("size"),
                         F.xxhash64(F.substring_index("tokens", " ", DEPTH)).alias("leaf"), "tokens")


def _agree(tokens: str, lead: str, similarity: float) -> Column:
    """Whether so many of the tokens agree."""
    same = F.zip_with(F.split(tokens, " "), F.split(lead, " "), lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) >= similarity * F.size(same)


def _blocks(left: DataFrame, similarity: float) -> DataFrame:
    """own, place and block of the lines that may agree with another one.

    Tokens at their places behind the leading ones are ordered by the number
    of lines that have them, rarest first.  Lines that agree have one of
    their rarest in common, where one more is taken than tokens may differ;
    words that many lines share make blocks only where a line has no others.
    """
    words, size = F.split("tokens", " "), F.col("size")
    placed = left.select(
        "own", F.struct((-F.col("n")).alias("n"), "own").alias("place"), "size", "leaf",
        (size - F.ceil(similarity * size) + 1).cast("int").alias("part"),
        F.posexplode(F.slice(words, F.lit(DEPTH + 1), F.greatest(size - DEPTH, F.lit(0)).cast("int"))).alias("at", "word")
    ).select("own", "place", "part", F.xxhash64("size", "leaf", "at", "word").alias("block"))
    often = placed.groupBy("block").agg(F.count("*").alias("kinds"))
    counted = placed.join(spread_keys(often, [F.xxhash64("block", F.lit(3))]), "block")
    rarest = counted.groupBy("own", "place", "part").agg(F.sort_array(F.collect_list(F.struct("kinds", "block"))).alias("all"))
    return rarest.select("own", "place", F.explode(F.slice("all", F.lit(1), F.col("part"))).alias("one")).where(
        "one.kinds > 1").select("own", "place", "one.block")


def _agreeing(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (own, leader) whose lines stand in one leaf and agree."""
    lead = texts.select(F.col("own").alias("leader"), F.col("size").alias("s"), F.col("leaf").alias("l"),
                        F.col("tokens").alias("lead"))
    both = pairs.join(texts, "own").join(spread_keys(lead, [F.xxhash64("lead")]), "leader")
    same = (F.col("size") == F.col("s")) & (F.col("leaf") == F.col("l"))
    return both.where(same & _agree("tokens", "lead", similarity)).select("own", "leader", "ahead")


def _ahead(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of a line of ``blocks`` as leader, and each line behind it that
    shares a block."""
    lead = blocks.select("block", F.col("own").alias("leader"), F.col("place").alias("ahead"))
    return lines.join(spread_keys(lead, [F.xxhash64("block", "leader")]), "block").where("ahead < place").select(
        "own", "leader", "ahead").distinct()


def _later_leaders(left: DataFrame, similarity: float) -> DataFrame | None:
    """own -> template, for the lines of ``left`` (own, n, size, leaf,
    tokens) that agree with an earlier leader.

    In a round the first lines of every block are compared with each other.
    One that is among them in all its blocks, and agrees with none before
    it, leads; the lines that agree with it leave.  The number of first
    lines doubles from round to round, up to ``FRONT``, so a block of lines
    that do not agree takes few rounds, and a family is gone, but for its
    leader, before many of its lines are compared.
    """
    blocks = materialize(_blocks(left, similarity), "line-blocks")
    texts = left.select("own", "size", "leaf", "tokens")
    waiting, front, found, turn = blocks, FIRST_FRONT, [], 1
    while not waiting.isEmpty():
        turn += 1
        order = Window.partitionBy("block").orderBy("place")
        first = materialize(waiting.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= front)
                            .drop("rank"), f"line-front-{turn}")
        behind = _agreeing(_ahead(first, first), texts, similarity).select("own").distinct()
        missing = waiting.select("own", F.lit(1).alias("w")).unionByName(first.select("own", F.lit(-1).alias("w")))
        ready = missing.groupBy("own").agg(F.sum("w").alias("w")).where("w = 0").select("own")
        leads = materialize(ready.join(behind, "own", "left_anti"), f"line-leads-{turn}")
        same = materialize(_agreeing(_ahead(blocks.join(leads, "own", "left_semi"), blocks), texts, similarity),
                           f"line-round-{turn}")
        found.append(same)
        gone = leads.unionByName(same.select("own")).distinct()
        waiting = materialize(waiting.join(gone, "own", "left_anti"), f"line-waiting-{turn}")
        front = min(2 * front, FRONT)
    if not found:
        return None
    # a line that left may agree with an earlier line that led later
    return reduce(DataFrame.unionByName, found).groupBy("own").agg(F.min("ahead").alias("lead")).select(
        "own", F.col("lead.own").alias("template"))


def _generalised(lines: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """own -> template, for the lines whose template is another line's."""
    kinds = materialize(lines.groupBy("own", "size", "leaf").agg(
        F.count("*").alias("n"), F.min(F.struct("t1", "t2", "line")).alias("place")), "line-kinds")
    # the most frequent line of a leaf leads it; leaves with one kind are done
    leaders = kinds.groupBy("size", "leaf").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("least"), F.count("*").alias("kinds")).where(
        "kinds > 1").select(F.col("size").alias("s"), F.col("leaf").alias("l"), F.col("least.own").alias("leader"))
    led = materialize(kinds.join(spread_keys(leaders, [F.col("leader")]), (F.col("size") == F.col("s")) & (
        F.col("leaf") == F.col("l"))).select("own", "leader", "place", "n", "size", "leaf"), "line-leaves")
    # one line of each such kind is read again, from one document that has it
    asked = materialize(led.groupBy("place.t1", "place.t2").agg(
        F.collect_list(F.struct("own", "place.line")).alias("asked")), "line-places")
    some = might_contain(rows.select("t1", "t2", "text"), bloom_filter(asked, "t1"), F.col("t1"), "maybe").where("maybe")
    found = some.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(asked, ["t1", "t2"]).select(
        "asked", F.split("text", "\n").alias("lines"))
    pairs = found.select(F.explode(F.transform("asked", lambda a: F.struct(
        a["own"].alias("own"), F.col("lines")[a["line"]].alias("raw")))).alias("one"))
    texts = materialize(pairs.select("one.own", line_tokens(F.col("one.raw")).alias("tokens")), "line-texts")
    lead = spread_keys(texts.select(F.col("own").alias("leader"), F.col("tokens").alias("lead")), [F.xxhash64("lead")])
    pairs = led.drop("place").join(texts, "own").join(lead, "leader").where("own <> leader")
    judged = pairs.withColumn("same", _agree("tokens", "lead", similarity))
    # no line can agree with one that may differ in no token
    open_ = F.col("size") > F.ceil(similarity * F.col("size"))
    judged = materialize(judged.where(F.col("same") | open_).select(
        "own", "n", "size", "leaf", "leader", "same", F.when(~F.col("same"), F.col("tokens")).alias("tokens")), "line-round-1")
    out = judged.where("same").select("own", F.col("leader").alias("template"))
    later = _later_leaders(judged.where("NOT same").select("own", "n", "size", "leaf", "tokens"), similarity)
    return out if later is None else out.unionByName(later)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                  similarity: float = SIMILARITY, long: int = LONG, min_docs_long: int = MIN_DOCS_LONG) -> DataFrame:
    """id, t1, t2 (key of the text) and ``drop``, the numbers of the lines to
    drop, of the documents with any."""
    rows = _documents(docs, id_col, text_col).drop("doc")
    lines = materialize(_lines(rows).drop("tokens"), "lines")
    other = materialize(_generalised(lines, rows, similarity), "line-templates")
    joined = materialize(
        lines.select("id", "t1", "t2", "line", "size", "own").join(spread_keys(other, [F.xxhash64("own", F.lit(3))]), "own", "left")
        .select("id", "t1", "t2", "line", "size", F.coalesce("template", "own").alias("template")), "line-joined")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2", "line")
    # a document counts once for a template; both steps add up before they shuffle
    once = joined.groupBy("template", "size", "id", "t1", "t2").agg(F.min("line").alias("line"))
    bound = F.when(F.col("size") >= long, min_docs_long).otherwise(min_docs)
    recurring = materialize(once.groupBy("template", "size").agg(F.count("*").alias("docs"), F.min(place).alias("first"))
                            .where(F.col("docs") >= bound).drop("docs", "size"), "line-recurring")
    maybe = might_contain(joined, bloom_filter(recurring, "template"), F.col("template"), "maybe").where("maybe")
    hits = maybe.join(spread_keys(recurring, [F.xxhash64("template", F.lit(3))]), "template")
    return hits.where(place != F.col("first")).groupBy("id", "t1", "t2").agg(F.collect_set("line").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row as a struct ``doc``, n_lines, n_dropped and ``kept``, its
    text without the lines whose template stands in ``min_docs`` documents
    or more (``min_docs_long``, if it has ``long`` tokens or more); the first
    line of a template (smallest id, null last, then text and line) stays.

    Lines without a word are never dropped and have no template; a null text
    has no lines and stays null.  Equal rows are one document here and lose
    the same lines.  An empty table gives an empty result.
    """
    drops = materialize(dropped_lines(docs, id_col, text_col, **options), "line-drops")
    rows = might_contain(_documents(docs, id_col, text_col), bloom_filter(drops, "t1"), F.col("t1"), "maybe")
    # texts that lose nothing are not shuffled
    rest = rows.where("NOT maybe").withColumn("drop", F.lit(None).cast("array<int>"))
    keyed = spread_keys(drops.select(F.col("id").alias("i"), F.col("t1").alias("a"), F.col("t2").alias("b"), "drop"),
                        [F.col("a")])
    on = F.col("id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b"))
    hit = rows.where("maybe").join(keyed, on, "left").drop("i", "a", "b")
    both = rest.unionByName(hit).select("doc", "text", "drop", F.split("text", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")
    text = F.col(f"doc.{text_col}")
    return both.select(
        "doc", F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), text).otherwise(kept).alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their own columns, the text without dropped lines."""
    deduped = dedup_lines(docs, id_col, text_col, **options)
    return deduped.select([(F.col("kept") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
