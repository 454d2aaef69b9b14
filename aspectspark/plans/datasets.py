"""Training-set builds (C1-C4) from encoded, exploded annotations
(``id, sentence_form, pos, aspect, polarity, topic, category, pol``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import CATEGORIES, HEAD, name_of
from aspectspark.operators.labels import (
    coarse_fine_split, drop_all_zero, topics_per_category)
from aspectspark.operators.sampling import sample_exact
from aspectspark.operators.unions import sentiment_pools

SENTIMENT_SIZES = {0: 804, 1: 400, 2: 250}


def category_sets(flat: DataFrame) -> DataFrame:
    """C1 in one pass: ``set ('3way'|'5way'), id, input, label``.  One
    aggregate builds both vectors, one explode tags them, each set drops its
    own all-zero rows (F1).  Write both outputs with one job via
    ``write.partitionBy("set")``."""
    agg = coarse_fine_split(flat, ["id", "sentence_form"], "category")
    both = agg.select("id", F.col("sentence_form").alias("input"), F.explode(F.array(
        F.struct(F.lit("3way").alias("set"), F.col("coarse").alias("label")),
        F.struct(F.lit("5way").alias("set"), F.col("fine").alias("label")))).alias("x"))
    return drop_all_zero(both.select("x.set", "id", "input", "x.label"))


def build_category_sets(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(3-way, 5-way) category sets ``id, input, label`` as two frames
    (filters of :func:`category_sets`)."""
    both = category_sets(flat)
    pick = lambda n: both.filter(F.col("set") == n).drop("set")
    return pick("3way"), pick("5way")


def build_topic_set(flat: DataFrame) -> DataFrame:
    """Per (record, category) the topic vector: ``id, input, entity,
    label`` with entity = category name."""
    t = topics_per_category(flat)
    return drop_all_zero(t.select("id", F.col("sentence_form").alias("input"),
                                  name_of("category", CATEGORIES).alias("entity"),
                                  "label"))


def build_sentiment_dev(flat: DataFrame) -> DataFrame:
    """C4: every annotation: ``id, pos, input, entity (aspect), label``."""
    return flat.select("id", "pos", F.col("sentence_form").alias("input"),
                       F.col("aspect").alias("entity"), F.col("pol").alias("label"))


def set_counts(flat: DataFrame) -> DataFrame:
    """A4 of the sets: ``stage, n``, the rows of C1, C2 and C4, counted
    without building them, in one pass over the annotations: per (record,
    category), then per record, then in all."""
    per = flat.groupBy("id", "sentence_form", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count("topic").alias("topics"))
    known = F.col("category").isNotNull()
    record = per.groupBy("id", "sentence_form").agg(
        F.sum("n").alias("n"), F.count_if(F.col("topics") > 0).alias("topics"),
        F.max(known.cast("int")).alias("coarse"), F.max((known & (F.col("category") >= HEAD)).cast("int")).alias("fine"))
    sums = record.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in (
        ("category_3way", "coarse"), ("category_5way", "fine"), ("topic", "topics"), ("sentiment_dev", "n"))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n"))
                                           for c in sums.columns])).alias("x")).select("x.*")


def build_sentiment_train(legacy: DataFrame, flat: DataFrame,
                          sizes: dict = SENTIMENT_SIZES, seed=42, compat: bool = False,
                          on_short: str = "fail") -> DataFrame:
    """Legacy recode (F2) + pools (U1, or U2 with ``compat``) + exact
    per-class sample (W1): ``input, entity, label, key``."""
    pools = sentiment_pools(legacy, flat, compat=compat)
    return sample_exact(pools, "label", sizes, ["key"], seed=seed, on_short=on_short)
