"""Deterministic sampling, folds and batches.

Every pseudo-random order is ``md5('seed:key...')`` followed by the key, so
results depend only on the data -- not on partitioning, retries or lost
executors -- and an independent SQL engine can reproduce them exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import seeded_md5


#: Hex digits by which a class is counted at a time, and rows of a bucket
#: that one task ranks.
PREFIX = 3
MAX_BUCKET = 1 << 20


#: Walks of a cycle before a permuted index counts as lost: a chance of 2^-128.
WALKS = 128


def _digits(n: int) -> int:
    """Hex digits that make about as many buckets as rows in a bucket."""
    return max(1, -(-n.bit_length() // 8))


def ranked(df: DataFrame, okey: str, tiebreak: list[str], lead: list[str] = (),
           partition: list[str] = (), prefix_len: int | None = None, name: str = "rank") -> DataFrame:
    """0-based rank of every row ordered by ``(*lead, okey, *tiebreak)``
    within ``partition`` (or globally), computed in levels.

    A plain ``row_number()`` over a whole class (or the whole table) runs in
    one task.  Here rows are bucketed by the first ``prefix_len`` hex digits
    of the md5 order key (default: from the row count, about as many buckets
    as rows in a bucket), bucket sizes are counted with a partial aggregate,
    and the row number inside each (lead, bucket) runs in parallel.  The
    running start of a bucket is summed within its lead value; only the
    totals of the lead values, one row each, are summed in one window (without
    ``lead``, the bucket counts).  NULL
    is a value like any other, in ``lead`` and in ``partition``.

    The input is read more than once (row and bucket counts, then the rows).
    Over a file scan the count passes read only the order-key columns; a
    derived input (an aggregate, a join) should be materialized first.
    """
    lead, partition = list(lead), list(partition)
    digits = prefix_len or _digits(df.count())
    x = df.withColumn("_b", F.substring(F.col(okey), 1, digits))
    own = [*partition, *lead]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(*own, "_b").agg(F.count(F.lit(1)).alias("_n"))
    in_lead = counts.withColumn("_in", F.coalesce(
        F.sum("_n").over(before(Window.partitionBy(*own).orderBy("_b"))), F.lit(0)))
    if lead:
        totals = counts.groupBy(*own).agg(F.sum("_n").alias("_n"))
        totals = totals.withColumn("_start", F.coalesce(
            F.sum("_n").over(before(Window.partitionBy(*partition).orderBy(*lead))), F.lit(0))
        ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*partition))).drop("_n")
        starts = null_safe_join(in_lead.drop("_n"), totals, own)
    else:
        starts = in_lead.withColumn("_start", F.lit(0)).withColumn(
            "_total", F.sum("_n").over(Window.partitionBy(*partition))).drop("_n")
    w_local = Window.partitionBy(*own, "_b").orderBy(okey, *tiebreak)
    local = x.withColumn("_rn", F.row_number().over(w_local) - 1)
    return (null_safe_join(local, starts, [*own, "_b"])
            .withColumn(name, (F.col("_start") + F.col("_in") + F.col("_rn")).cast("bigint"))
            .drop("_b", "_rn", "_start", "_in"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, NULL equal to NULL; keys once."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, on).drop(*[f"_k{i}" for i in range(len(keys))])


def sample_exact(df: DataFrame, class_col: str, sizes: dict, keys: list[str],
                 seed=42, on_short: str = "fail", prefix_len: int | None = None) -> DataFrame:
    """Exactly ``sizes[c]`` rows of class ``c``, without replacement,
    the rows with the smallest ``md5('seed:key')``.

    A distributed order statistic: the rows of a class are counted by md5
    prefix (a partial aggregate), the prefix in which the sample ends is
    found from these counts, and rows beyond it are filtered out before
    anything is shuffled.  What is left, the sample and the rest of one
    bucket, is ranked by (class, bucket); a bucket of more than ``MAX_BUCKET``
    rows is counted by a longer prefix first.  ``on_short='fail'`` raises when
    a class has fewer rows than requested (also when it has none);
    ``'take_all'`` keeps what there is.  One row per requested class reaches
    the driver.
    """
    if on_short not in ("fail", "take_all"):
        raise ValueError("on_short must be 'fail' or 'take_all'")
    wanted = df.filter(F.col(class_col).isin(*sizes)) if sizes else df.limit(0)
    x = wanted.withColumn("_okey", seeded_md5(seed, *keys))
    cuts, totals = _cuts(x, class_col, dict(sizes), prefix_len or PREFIX)
    short = {c: totals.get(c, 0) for c, n in sizes.items() if totals.get(c, 0) < n}
    if short and on_short == "fail":
        raise ValueError(f"sample_exact: class too small: {short} of {sizes}")
    if not cuts:
        return x.drop("_okey")
    last = _of_class(class_col, {c: prefix for c, (prefix, _) in cuts.items()})
    left = _of_class(class_col, {c: n for c, (_, n) in cuts.items()})
    own = F.coalesce(F.substring(F.col("_okey"), F.lit(1), F.length(last)), F.lit(""))
    near = x.withColumn("_b", own).filter(last.isNull() | (F.col("_b") <= last))
    rank = F.row_number().over(Window.partitionBy(class_col, "_b").orderBy("_okey", *keys))
    return (near.withColumn("_rn", rank)
            .filter(last.isNull() | (F.col("_b") < last) | (F.col("_rn") <= left))
            .drop("_okey", "_b", "_rn"))


def _of_class(class_col: str, values: dict):
    return F.try_element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), F.col(class_col))


def _cuts(x: DataFrame, class_col: str, need: dict, digits: int) -> tuple[dict, dict]:
    """Per class with more rows than it needs: the prefix of ``_okey`` in
    which the sample ends, and how many rows of that bucket belong to it; and
    the rows of every class."""
    cuts, totals, length, prefix = {}, {}, 0, {c: "" for c in need}
    while prefix:
        length += digits
        rows = x.filter(F.col(class_col).isin(*prefix) & F.col("_okey").startswith(_of_class(class_col, prefix)))
        counts = rows.groupBy(class_col, F.substring("_okey", 1, length).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(class_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        ends = counts.withColumn("_upto", upto)
        reached = F.col("_upto") >= _of_class(class_col, {c: need[c] for c in prefix})
        found = ends.groupBy(class_col).agg(
            F.sum("_n").alias("total"), F.min(F.when(reached, F.col("_b"))).alias("b"),
            F.min(F.when(reached, F.col("_upto"))).alias("upto"),
            F.min(F.when(reached, F.struct("_b", "_n")))["_n"].alias("n")).collect()
        prefix = {}
        for r in found:
            c = r[class_col]
            if length == digits:
                totals[c] = r["total"]
                if r["total"] <= need[c]:
                    continue
            need[c] -= r["upto"] - r["n"]       # what the buckets before it leave
            cuts[c] = (r["b"], need[c])
            if r["n"] > MAX_BUCKET and length < 32:
                prefix[c] = r["b"]
    return cuts, totals


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's checkpoint directory (reliable,
    survives lost executors) and read it back: the two-level rank reads its
    input twice, which must not mean computing a derived input twice."""
    from aspectspark.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stratified_kfold(df: DataFrame, label: str, keys: list[str], k: int = 5,
                     seed=42, prefix_len: int | None = None, materialize: bool = False) -> DataFrame:
    """Adds ``fold`` in 0..k-1, stratified by the label value.

    Rows are ranked by (label, md5 order); ``fold = rank % k``.  Consecutive
    ranks of one class cycle through the folds, so every class's fold sizes
    differ by at most one, and so do the fold totals.  Rows with a NULL
    label are a class of their own.  ``materialize``:
    checkpoint a derived input first (see :func:`ranked`).
    """
    if materialize:
        df = materialized(df)
    x = df.withColumn("_okey", seeded_md5(seed, *keys))
    r = ranked(x, "_okey", list(keys), lead=[label], prefix_len=prefix_len, name="_rank")
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop(
        "_okey", "_rank", "_total")


def fold_split(df: DataFrame, fold: int, col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid) of one fold."""
    return df.filter(F.col(col) != fold), df.filter(F.col(col) == fold)


def fold_tag(df: DataFrame, fold: int, col: str = "fold", name: str = "split") -> DataFrame:
    """W3 in one pass: ``split`` = 'valid' for the fold, else 'train'."""
    return df.withColumn(name, F.when(F.col(col) == fold, "valid").otherwise("train"))


def epoch_batches(df: DataFrame, keys: list[str], batch_size: int, seed=42,
                  epoch: int = 0, drop_last: bool = True, prefix_len: int | None = None,
                  materialize: bool = False) -> DataFrame:
    """Shuffled fixed-size batches for one epoch: adds ``batch`` and
    ``slot``.  The order is md5('seed:epoch:key'); the global rank is the
    two-level rank, so no single task sorts the table.  ``drop_last``
    removes the final partial batch (training); keep it for validation.
    ``materialize``: checkpoint a derived input first (see :func:`ranked`)."""
    if materialize:
        df = materialized(df)
    x = df.withColumn("_okey", seeded_md5(f"{seed}:{epoch}", *keys))
    r = ranked(x, "_okey", list(keys), prefix_len=prefix_len, name="_rank")
    r = r.withColumn("batch", (F.col("_rank") / batch_size).cast("bigint")) \
         .withColumn("slot", (F.col("_rank") % batch_size).cast("int"))
    if drop_last:
        r = r.filter(F.col("batch") < (F.col("_total") / batch_size).cast("bigint"))
    return r.drop("_okey", "_rank", "_total")


def permuted(index, n: int, seed=42, epoch: int = 0):
    """Place of a dense ``index`` (0 .. n - 1) in the epoch's order: a keyed
    bijection of these numbers, as a column expression.

    Four alternating Feistel rounds (md5 of seed, epoch, round and one half)
    permute the numbers of as many bits as n - 1 has; those at n or beyond
    are permuted again until they fall below it (cycle walking, each time
    with a chance of over a half; an index that did not in ``WALKS`` is an
    error).
    """
    bits = max(2, (n - 1).bit_length())
    low = bits - bits // 2
    masks = [(1 << (bits - low)) - 1, (1 << low) - 1]

    def mixed(i: int, half):
        text = F.concat(F.lit(f"{seed}:{epoch}:{i}:"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint").bitwiseAND(F.lit(masks[i % 2]))

    def turn(i: int):
        if i % 2 == 0:
            return lambda h: F.array(h[0].bitwiseXOR(mixed(i, h[1])), h[1])
        return lambda h: F.array(h[0], h[1].bitwiseXOR(mixed(i, h[0])))

    def once(x):
        halves = F.array(F.shiftright(x, low), x.bitwiseAND(F.lit(masks[1])))
        for i in range(4):      # one lambda per round, so that no half is computed twice
            halves = F.transform(F.array(halves), turn(i))[0]
        return F.transform(F.array(halves), lambda h: F.call_function("shiftleft", h[0], F.lit(low)).bitwiseOR(h[1]))[0]

    start = once(index.cast("bigint"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    lost = F.raise_error(F.lit(f"permuted: no place in {WALKS} walks")).cast("bigint")
    return F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(lost))[0]


def dense_ids(df: DataFrame, keys: list[str], seed=42, materialize: bool = False) -> DataFrame:
    """Adds ``row_id`` (0, 1, ...; by ``md5('seed:key')``) and ``n_rows``:
    written once, they serve the batches of all epochs."""
    if materialize:
        df = materialized(df)
    r = ranked(df.withColumn("_okey", seeded_md5(seed, *keys)), "_okey", list(keys), name="row_id")
    return r.withColumnRenamed("_total", "n_rows").drop("_okey")


def later_batches(ids: DataFrame, n: int, batch_size: int, epoch: int, seed=42, drop_last: bool = True) -> DataFrame:
    """W4 for any further epoch: ``batch`` and ``slot`` of rows with
    ``row_id`` 0 .. n - 1, by :func:`permuted`: a narrow map, without a sort or
    a shuffle."""
    x = ids.withColumn("_at", permuted(F.col("row_id"), n, seed, epoch))
    x = x.withColumn("batch", F.floor(F.col("_at") / batch_size).cast("bigint")).withColumn(
        "slot", (F.col("_at") % batch_size).cast("int"))
    if drop_last:
        x = x.filter(F.col("batch") < n // batch_size)
    return x.drop("_at")


def write_batches(batches: DataFrame, path: str, files: int) -> None:
    """Lay batches out for a trainer that reads them in order: ranges of
    batches per file, sorted by batch and slot inside, so a batch lies in one
    stretch of one file."""
    batches.repartitionByRange(files, "batch").sortWithinPartitions("batch", "slot").write.parquet(path)
