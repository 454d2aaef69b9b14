"""Folding and counting (A3, A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectspark.session import dealt


def fold_annotations(flat: DataFrame, key: str | list[str], order: list[str],
                     items: tuple[str, ...] = ("aspect", "polarity"),
                     rows: int | None = None, within: str | None = None) -> DataFrame:
    """A3: ``key -> annotation``: the distinct ``items`` of every key as an
    ordered list, first-seen order by ``order``.

    Duplicates are removed by a partial aggregate on (key, items) before the
    per-key collect, so the collected list is bounded by the number of
    distinct items (the label space), not by how often they repeat.
    ``rows``: rows of the table that ``flat`` derives from, if known; both
    steps then have as many tasks as they need (:func:`aspectspark.session.dealt`).
    The first deals by items too: a key of many rows goes to several tasks.
    ``within``: the first of two columns of ``order``, where ``flat`` is dealt by
    it already (the record).  What a key has in it then goes to the key's task as
    one row, with the items as one list each, instead of a row for each item.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if within is not None:
        return _fold_packed(flat, keys, order, items, rows, within)
    first = F.min(F.struct(*order)).alias("_first")
    if rows is not None:
        flat = dealt(flat.select(*keys, *items, *order), [*keys, *items], rows)
    d = flat.groupBy(*keys, *items).agg(first)
    if rows is not None:
        d = dealt(d, keys, rows)
    ann = F.transform(F.array_sort(F.collect_list(F.struct("_first", *items))),
                      lambda x: F.struct(*[x[i].alias(i) for i in items]))
    return d.groupBy(*keys).agg(ann.alias("annotation"))


def _fold_packed(flat: DataFrame, keys: list[str], order: list[str], items: tuple[str, ...],
                 rows: int | None, within: str) -> DataFrame:
    """:func:`fold_annotations` with ``within``.  The packed lists are in
    order, so the place in them stands for the second column of ``order``.
    NULLs come first, which a plain minimum (fixed-width, a hash aggregate)
    skips."""
    if len(order) != 2 or order[0] != within:
        raise ValueError(f"order must be {within!r} and one more column, got {order}")

    def least(col):
        return F.when(F.count(col) == F.count(F.lit(1)), F.min(col))

    p = flat.groupBy(*keys, within, *items).agg(least(order[1]).alias("_second"))
    p = p.groupBy(*keys, within).agg(
        F.sort_array(F.collect_list(F.struct("_second", *items))).alias("_rows"))
    p = p.select(*keys, within, *[F.col("_rows")[i].alias(i) for i in items])
    if rows is not None:
        p = dealt(p, keys, rows)
    d = p.select(*keys, within, F.posexplode(F.arrays_zip(*items)).alias("_place", "_item"))
    d = d.select(*keys, within, "_place", *[F.col("_item")[i].alias(i) for i in items])
    # an item is at most once in a packed row, so its least ``within`` has one place
    d = d.groupBy(*keys, *items).agg(
        least(within).alias("_within"),
        F.coalesce(F.min(F.when(F.col(within).isNull(), F.col("_place"))),
                   F.min_by("_place", within)).alias("_place"))
    ann = F.transform(F.sort_array(F.collect_list(F.struct("_within", "_place", *items))),
                      lambda x: F.struct(*[x[i].alias(i) for i in items]))
    return d.groupBy(*keys).agg(ann.alias("annotation"))


def stage_counts(frames: dict[str, DataFrame], stage_col: str | None = None) -> DataFrame:
    """A4: row count of every named stage frame, as one small table.  A
    frame that already carries a ``stage_col`` (several stages tagged in one
    pass) is counted per tag instead of under its dict name."""
    parts = [df.select(F.col(stage_col).alias("stage")) if stage_col and stage_col in df.columns
             else df.select(F.lit(name).alias("stage")) for name, df in frames.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
