"""Record alignment and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectspark.session import dealt


def align_gold_pred(gold: DataFrame, pred: DataFrame, on: str = "id",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Pair each gold record with its prediction record by id (the
    reference zips two files by line position; an id join is the stable
    form).  A record missing from ``pred`` gets an empty prediction list.
    ``carry``: columns of ``pred`` to keep (such as the member, one row each)."""
    p = pred.select(on, *carry, F.col("annotation").alias("pred_annotation"))
    return (gold.withColumnRenamed("annotation", "gold_annotation")
                .join(p, on, "left")
                .withColumn("pred_annotation",
                            F.coalesce("pred_annotation", F.array().cast(
                                pred.schema["annotation"].dataType))))


def first_match(left: DataFrame, right: DataFrame, keys: list[str],
                value: str = "polarity", order: str = "pos",
                prefix: str = "match_", rows: int | None = None,
                by: str | None = None) -> DataFrame:
    """For each left row the *first* right row (smallest ``order``) with
    equal ``keys``: adds ``match_<value>`` and ``match_pos`` (NULL when
    there is none).  The right side is reduced to one row per key with a
    partial aggregate before the join, so duplicates never multiply rows.
    ``rows``: rows of the left side, if known; the join then has as many tasks
    as they need.
    ``by``: the one of ``keys`` that both sides are dealt by already.  They
    then join by it alone and shuffle nothing: the first rows of each of its
    values are a map by the other keys (for a record, the label space bounds
    it), in which every left row looks up its own."""
    firsts = right.groupBy(*keys).agg(
        F.min_by(value, order).alias(prefix + value),
        F.min(order).alias(prefix + order))
    if by is not None:
        others = [k for k in keys if k != by]
        found = [prefix + value, prefix + order]
        for k in others:        # a NULL key equals none
            firsts = firsts.filter(F.col(k).isNotNull())
        maps = firsts.groupBy(by).agg(F.map_from_entries(F.collect_list(
            F.struct(F.struct(*others), F.struct(*found)))).alias("_firsts"))
        own = F.try_element_at("_firsts", F.struct(*others))
        # both sides lie as a merge needs them, so neither is broadcast
        return left.join(maps.hint("merge"), by, "left").select(
            *keys, *[c for c in left.columns if c not in keys], *[own[c].alias(c) for c in found])
    if rows is not None:    # both sides: a join keeps the number of one that is dealt already
        left, firsts = dealt(left, keys, rows), dealt(firsts, keys, rows)
    return left.join(firsts, keys, "left")


def attach_predictions(corpus: DataFrame, preds: DataFrame,
                       key: str = "sentence_key", text: str = "sentence_form",
                       also: tuple[str, ...] = ()) -> DataFrame:
    """Predictions keyed by sentence -> every record with that sentence.

    Both sides join on a fixed-width ``md5(sentence)`` key, so long texts are
    never hashed or compared in the shuffle.  Missing -> empty list.
    ``also``: further key columns that both sides have (such as the member).
    """
    c = corpus if key in corpus.columns else corpus.withColumn(key, F.md5(text))
    ann_type = preds.schema["annotation"].dataType
    return (c.join(preds.select(key, *also, F.col("annotation").alias("_p")),
                   [key, *also], "left")
             .withColumn("annotation", F.coalesce("_p", F.array().cast(ann_type)))
             .drop("_p", key))


def vote_lookup(corpus: DataFrame, votes: DataFrame, on: str = "id",
                on_missing: str = "empty") -> DataFrame:
    """Corpus records -> their voted annotation by id.

    ``on_missing='empty'`` gives an empty list, ``'fail'`` raises."""
    ann_type = votes.schema["annotation"].dataType
    v = votes.select(on, F.col("annotation").alias("_v"), F.lit(True).alias("_hit"))
    out = corpus.select(on, "sentence_form").join(v, on, "left")
    if on_missing == "fail":
        ann = F.when(F.col("_hit").isNull(),
                     F.raise_error(F.concat(F.lit("no votes for id "),
                                            F.col(on).cast("string")))).otherwise(F.col("_v"))
    else:
        ann = F.coalesce("_v", F.array().cast(ann_type))
    return out.select(on, "sentence_form", ann.cast(ann_type).alias("annotation"))


def expand_members(df: DataFrame, members) -> DataFrame:
    """One copy of every row per ensemble member.

    ``members`` is a count or a list of member ids; rows are multiplied with
    ``explode`` (a narrow, per-row operation) instead of a cross join.
    """
    ids = list(range(members)) if isinstance(members, int) else list(members)
    return df.withColumn("member", F.explode(F.array(*[F.lit(m) for m in ids])))
