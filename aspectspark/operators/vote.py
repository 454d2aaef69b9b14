"""Ensemble hard vote (V1-V5).

Input: exploded member predictions ``member, <key>, pos, aspect, polarity``.
Aspect and polarity votes are tallied in one partial (map-side) aggregate
per (record, kind, value); the per-record decision then works on arrays
whose length is bounded by the label space (aspects + polarities), never by
the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASPECT_THRESHOLD = 2


def vote_tallies(members: DataFrame, key: str) -> DataFrame:
    """One aggregate for both vote tables: every annotation casts an aspect
    vote (kind 0) and a polarity vote (kind 1).  ``n`` = votes, ``first`` =
    (member, pos) where the value was first seen, packed by
    :func:`first_seen` -- the reference's dict insertion order.  Partial aggregation merges repeated votes map-side."""
    votes = members.select(key, first_seen("member", "pos").alias("_f"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("aspect").alias("value")),
        F.struct(F.lit(1).alias("kind"), F.col("polarity").alias("value")))).alias("v"))
    return votes.groupBy(key, F.col("v.kind").alias("kind"), F.col("v.value").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("_f").alias("first"))


def first_seen(member, pos):
    """(member, pos) packed into one bigint with the same order, so the
    first-seen minimum is a fixed-width hash aggregate (a struct minimum
    would fall back to a sort-based aggregate)."""
    return F.shiftleft(F.col(member).cast("bigint"), 32) + F.col(pos).cast("bigint")


def first_member(first):
    return F.shiftright(F.col(first), 32).cast("int")


def first_pos(first):
    return (F.col(first) % F.lit(1 << 32)).cast("int")


def vote_counts(members: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """V1: (aspect counts, polarity counts) per record.  Every annotation of
    every member counts (duplicates too)."""
    t = vote_tallies(members, key)
    aspects = t.filter(F.col("kind") == 0).select(key, F.col("value").alias("aspect"),
                                                  "n", "first")
    polarities = t.filter(F.col("kind") == 1).select(key, F.col("value").alias("polarity"),
                                                     "n", "first")
    return aspects, polarities


def _per_record(tallies: DataFrame, key: str) -> DataFrame:
    """Per record: the aspect and polarity tallies as two arrays, bounded by
    the label space."""
    item = F.struct("first", "value", "n")
    return tallies.groupBy(key).agg(
        F.collect_list(F.when(F.col("kind") == 0, item)).alias("aspects"),
        F.collect_list(F.when(F.col("kind") == 1, item)).alias("polarities"))


def _keep_aspects(aspects_col, threshold: int):
    mx = F.array_max(F.transform(aspects_col, lambda x: x["n"]))
    kept = F.filter(aspects_col, lambda x: x["n"] >= F.least(mx, F.lit(threshold)))
    return F.array_sort(kept)          # by first-seen (member, pos)



def _record_polarity(pols_col):
    ordered = F.array_sort(F.transform(pols_col, lambda x: F.struct(
        (-x["n"]).alias("neg_n"), x["first"].alias("first"), x["value"].alias("polarity"))))
    return F.get(ordered, 0)["polarity"]


def vote_aspects(aspects: DataFrame, threshold: int = ASPECT_THRESHOLD,
                 key: str = "id") -> DataFrame:
    """V2: aspects with ``n >= min(max_n, threshold)`` per record."""
    per = aspects.groupBy(key).agg(
        F.collect_list(F.struct("first", F.col("aspect").alias("value"), "n")).alias("a"))
    return (per.select(key, F.explode(_keep_aspects(F.col("a"), threshold)).alias("x"))
               .select(key, F.col("x.value").alias("aspect"), "x.n"))


def vote_polarity(polarities: DataFrame, key: str = "id") -> DataFrame:
    """V3: the record's polarity: highest count, ties to the first seen
    (the threshold of the reference never changes this choice)."""
    per = polarities.groupBy(key).agg(
        F.collect_list(F.struct("first", F.col("polarity").alias("value"), "n")).alias("p"))
    return per.select(key, _record_polarity(F.col("p")).alias("polarity"))


def hard_vote(members: DataFrame, key: str = "id",
              threshold: int = ASPECT_THRESHOLD) -> DataFrame:
    """V4 core: ``key, annotation array<struct<aspect,polarity>>`` for every
    record with at least one member annotation.  Kept aspects appear in
    first-seen order and all carry the one record polarity.  Join the
    result to the corpus with :func:`vote_lookup` (records without votes get
    an empty list)."""
    per = _per_record(vote_tallies(members, key), key)
    pol = _record_polarity(F.col("polarities"))
    kept = _keep_aspects(F.col("aspects"), threshold)
    ann = F.transform(kept, lambda x: F.struct(x["value"].alias("aspect"),
                                                pol.alias("polarity")))
    return per.select(key, ann.alias("annotation"))


def annotation_histogram(df: DataFrame) -> DataFrame:
    """V5: number of records per annotation-list length."""
    return (df.groupBy(F.size("annotation").alias("n_annotations"))
              .agg(F.count(F.lit(1)).alias("n_records")))
