"""Mixing sources to target weights, as a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectspark.llm.common import WORD_RUN, materialize, rest_key, shuffle_partitions, spread_keys, text_key

#: A source's words are taken at most so often.
MAX_REPEATS = 3

#: Weight schedules by rank of the source, repeating: density of the
#: source's demand at the start of training; it changes linearly to two
#: minus that at the end, so every schedule integrates to 1.
SCHEDULES = (1.5, 1.0, 0.5)


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RUN)).cast("long")


def _ranked_sources(base: DataFrame, weights: Sequence[float], schedules: Sequence[float]) -> DataFrame:
    """One row per source: source, source_size, weight and start_weight by
    its rank in the order of code points, null last.

    Names are dealt out by range, so a task ranks its range alone and adds
    the number of names before it.
    """
    name = F.col("source").asc_nulls_last()
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = materialize(sizes.repartitionByRange(shuffle_partitions(base.sparkSession), name).withColumn(
        "range", F.spark_partition_id()), "mix-sources")
    # one row per partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(name)) - 1

    def repeating(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod("rank", F.lit(len(values))) + 1).cast("int"))

    return materialize(ranged.join(starts, "range").withColumn("rank", rank).select(
        "source", "source_size", repeating(weights).alias("weight"), repeating(schedules).alias("start_weight")), "mix-ranks")


def shares(base: DataFrame, weights: Sequence[float], schedules: Sequence[float] = SCHEDULES,
           max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target and start_weight of each source of
    ``base`` (source, size), sizes added up.

    All sizes are shared by weight; a source stops at ``max_repeats`` times
    its size, and the excess is shared by weight among the others until none
    is above its limit.  A round is one aggregate over the sources: what the
    full ones take and the weight of the others, so the driver sees a few
    numbers, whatever the number of sources.
    """
    ranked = _ranked_sources(base, weights, schedules)
    limit, empty = max_repeats * F.col("source_size"), F.col("source_size") == 0
    unit, full = 0.0, -1
    while True:
        above = empty | (F.lit(unit) * F.col("weight") > limit)
        # decimals, so the sums do not depend on the order of the rows
        got = ranked.agg(
            F.sum("source_size").alias("total"), F.count_if(above).alias("full"), F.sum(F.when(above, limit)).alias("taken"),
            F.sum(F.when(~above, F.col("weight").cast("decimal(28,12)"))).alias("free")).first()
        if got["full"] == full or not got["free"]:
            break
        unit, full = max(unit, (got["total"] - (got["taken"] or 0)) / float(got["free"])), got["full"]
    goal = F.when(empty, 0.0).otherwise(F.least(F.lit(unit) * F.col("weight"), limit.cast("double")))
    return ranked.select("source", "source_size", goal.alias("target"), "start_weight")


def _offsets(base: DataFrame) -> DataFrame:
    """Words that come before each document in its source's order.

    The order is by a hash of the document.  Sums run in two levels: per
    hash bucket of a source, then inside a bucket, so a source with a third
    of all rows is many tasks' work.  Equal documents are one row with a
    count ``n`` first and apart again at the end (``k`` of ``n``).
    """
    keys = ["source", "doc_id", "size", "t1", "t2", "rest"]
    distinct = base.groupBy(*keys).agg(F.count("*").alias("n")).withColumn(
        "o", F.xxhash64("doc_id", "t1", "t2", F.lit(5)))
    # about as many buckets per source as rows in a bucket: both levels grow
    # with the root of the table
    bits = (base.count().bit_length() + 1) // 2
    bucketed = distinct.withColumn("bucket", F.shiftrightunsigned("o", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))
    inner = Window.partitionBy("source", "bucket").orderBy("o", "doc_id", "t1", "t2", "rest", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    within = bucketed.withColumn("inner", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inner), F.lit(0)))
    joined = within.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        *keys, "o", "k", (F.col("bucket_start") + F.col("inner") + F.col("k") * F.col("size")).alias("start"))


def _passes() -> Column:
    """The passes over the source that take the document: those whose
    demand reaches its middle word."""
    middle = F.col("start") + F.col("size") / 2
    return F.filter(F.array(*[F.lit(p) for p in range(MAX_REPEATS)]),
                    lambda p: p * F.col("source_size") + middle < F.col("target"))


def _settle(taken: DataFrame) -> DataFrame:
    """Per source, one more pass for, or one pass less of, the document
    whose size best closes the gap between words taken and target."""
    words = F.col("size") * F.size("passes")
    gaps = taken.groupBy("source").agg(F.sum(words).alias("words"), F.max("target").alias("goal"))
    gap = F.col("goal") - F.col("words")
    sided = taken.join(gaps.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("gap", gap)
    room = F.when(F.col("gap") > 0, F.size("passes") < MAX_REPEATS).otherwise(F.size("passes") > 0)
    after = F.abs(F.abs("gap") - F.col("size"))
    best = (sided.where(room & (after < F.abs("gap")) & (F.col("size") > 0))
            .groupBy("source").agg(
                F.min_by(F.struct("o", "doc_id", "t1", "t2", "rest", "k", F.signum("gap").cast("int").alias("step")),
                         F.struct(after.alias("a"), F.col("o"), F.col("doc_id"), F.col("rest"), F.col("k"))).alias("best"),
            ).select(F.col("source").alias("bs"), "best"))
    same = F.lit(True)
    for c in ("o", "doc_id", "t1", "t2", "rest", "k"):
        same = same & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    step = F.when(same, F.col("best.step")).otherwise(0)
    used = F.col("passes")
    unused = F.array_except(F.array(*[F.lit(p) for p in range(MAX_REPEATS)]), used)
    return taken.join(best, F.col("source").eqNullSafe(F.col("bs")), "left").withColumn("step", step).withColumn(
        "passes", F.when(F.col("step") > 0, F.concat(used, F.slice(unused, 1, 1)))
        .when(F.col("step") < 0, F.slice(used, 1, F.greatest(F.size(used) - 1, F.lit(0)))).otherwise(used),
    ).drop("bs", "best", "step")


def _position() -> Column:
    """Training position in [0, 1] of each pass that takes the document: the
    time at which the source's cumulative demand, the integral
    a t + (1 - a) t^2 of its schedule, reaches the document's middle word."""
    middle = F.col("start") + F.col("size") / 2

    def at(p: Column) -> Column:
        y = F.least(F.lit(1.0), (p * F.col("source_size") + middle) / F.greatest(F.col("target"), F.lit(1e-9)))
        a = F.col("start_weight")
        bent = (F.sqrt(a * a + 4 * (1 - a) * y) - a) / (2 * (1 - a))
        return F.when(F.abs(1 - a) < 1e-9, y).otherwise(bent)

    return F.transform(F.col("passes"), at)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (1, 2, 3), schedules: Sequence[float] = SCHEDULES, rest: Column | None = None) -> DataFrame:
    """The mix, one row per document: doc_id, size, source, source_size,
    target, passes (of the source that take it), positions (a training
    position for each), taken, and the document's key t1, t2.

    Rows come range-sorted in training order: by the first position that
    takes the document, those that none takes last."""
    mixed = placed(docs, id_col, text_col, source_col, weights, schedules, rest)
    order = [F.array_min("positions").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("t1"), F.col("t2"), F.col("rest")]
    return mixed.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[float] = (1, 2, 3), schedules: Sequence[float] = SCHEDULES, rest: Column | None = None) -> DataFrame:
    """The rows of :func:`mix` in no order.

    Sources in order of code point, null last, weigh ``weights``, repeating.
    A null text has size 0; a document of size 0 takes no words but is
    placed like any other.  Ties in the hash order are broken by id and
    text; equal rows are placed one after another.  An empty table gives an
    empty mix; columns beyond the three named are not read, unless ``rest``,
    a hash of them, tells rows of one id and text apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"),
                        (F.lit(0).cast("long") if rest is None else rest).alias("rest"))
    base = materialize(named.select("doc_id", "source", n_words(F.col("text")).alias("size"), *text_key(text), "rest"), "mix-sizes")
    goals = shares(base, weights, schedules).withColumnRenamed("source", "ss")
    offset = _offsets(base).join(goals, F.col("source").eqNullSafe(F.col("ss"))).drop("ss")
    settled = _settle(materialize(offset.withColumn("passes", _passes()), "mix-placed"))
    return settled.withColumn("positions", _position()).withColumn(
        "taken", (F.col("size") * F.size("passes")).cast("long")).select(
        "doc_id", "size", "source", "source_size", "target", "passes", "positions", "taken", "t1", "t2", "rest")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, sorted by training
    position (ranges of positions, each sorted).  Rows of one id and text
    that differ elsewhere are documents of their own; other columns may have
    any type."""
    rest = rest_key(docs, [id_col, text_col, source_col])
    mixed = placed(docs, id_col, text_col, source_col, rest=rest, **options).groupBy("doc_id", "source", "t1", "t2", "rest").agg(
        F.flatten(F.collect_list("positions")).alias("positions"))
    mixed = spread_keys(mixed.where(F.size("positions") > 0).select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("t1").alias("a"), F.col("t2").alias("b"),
        F.col("rest").alias("r"), "positions"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       *text_key(F.coalesce(F.col(text_col), F.lit(""))), rest.alias("rest"))
    keys = ["doc_id", "source", "t1", "t2", "rest"]
    # rows equal in all columns are one row here: their positions are one list
    one = rows.groupBy(*keys).agg(F.first("doc").alias("doc"))
    on = (F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s"))
          & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b")) & (F.col("rest") == F.col("r")))
    each = one.join(mixed, on).select("doc", F.explode("positions").alias("position"))
    ranged = each.repartitionByRange(shuffle_partitions(docs.sparkSession), "position", F.col(f"doc.{id_col}"))
    return ranged.sortWithinPartitions("position", f"doc.{id_col}").select("doc.*")
