"""Evaluation operators (E1-E11) and the report rows.

All metrics are global aggregates built from per-row expressions with
partial (map-side) aggregation; only the final one-row results reach the
driver, and only when the caller collects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT_COLS = ["ce_tp", "ce_fn", "ce_fp", "ce_fp_sticky",
              "pi_tp", "pi_fn", "pi_fp", "pi_fp_sticky"]


def set_match_counts(gold: DataFrame, pred: DataFrame, key: str = "id") -> DataFrame:
    """E1 + E2: set-match counts of (aspect, polarity) annotations.

    ``gold`` and ``pred`` are exploded annotations: ``key, pos, aspect,
    polarity`` with dense 0-based ``pos`` per record (what
    :func:`explode_annotations` yields).

    * gold row: the *first* prediction of the record with the same aspect
      decides: exists -> aspect TP else FN; equal polarity -> pipeline TP
      else FN.
    * prediction row: the *first* gold row with the same aspect decides the
      hit flags; exact FP = rows without a hit.  The sticky variant (the
      reference's unreset flags) counts only predictions before the
      record's first hit; with dense positions that is
      ``coalesce(first_hit_pos, n_pred)`` per record -- an aggregate, no
      window and no join back.

    One pass over each input: both sides are unioned and reduced to
    ``(record, aspect, side, polarity) -> n, min pos`` (partial, map-side),
    then per (record, aspect) the few stats (at most 2 x #polarities) are
    combined with array functions, then per record, then globally.  Every
    shuffle moves pre-aggregated rows, so a hot record or aspect is merged
    before it reaches a task.  Returns one row with ``COUNT_COLS``.
    """
    cols = [key, "aspect", "polarity", "pos"]
    u = gold.select(*cols, F.lit(0).alias("side")).unionByName(
        pred.select(*cols, F.lit(1).alias("side")))
    st = u.groupBy(key, "aspect", "side", "polarity").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("mpos"))
    per_aspect = st.groupBy(key, "aspect").agg(
        F.collect_list(F.struct("side", "mpos", "polarity", "n")).alias("st"))

    g = F.filter("st", lambda x: x["side"] == 0)
    p = F.filter("st", lambda x: x["side"] == 1)

    def total(arr):
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])

    def first_pol(arr):   # polarity of the row with the smallest position
        return F.get(F.array_sort(F.transform(arr, lambda x: F.struct(
            x["mpos"].alias("m"), x["polarity"].alias("pol")))), 0)["pol"]

    ng, np_, gf, pf = total(g), total(p), first_pol(g), first_pol(p)
    pi_tp = total(F.filter(g, lambda x: x["polarity"] == pf))
    pi_hit = total(F.filter(p, lambda x: x["polarity"] == gf))
    pi_pos = F.array_min(F.transform(F.filter(p, lambda x: x["polarity"] == gf),
                                     lambda x: x["mpos"]))
    ce_pos = F.array_min(F.transform(p, lambda x: x["mpos"]))
    a = per_aspect.select(
        key,
        F.when(np_ > 0, ng).otherwise(0).alias("ce_tp"),
        F.when(np_ > 0, 0).otherwise(ng).alias("ce_fn"),
        F.when(ng > 0, 0).otherwise(np_).alias("ce_fp"),
        pi_tp.alias("pi_tp"), (ng - pi_tp).alias("pi_fn"),
        (np_ - pi_hit).alias("pi_fp"),
        np_.alias("n_pred"),
        F.when(ng > 0, ce_pos).alias("ce_first"),
        pi_pos.alias("pi_first"))
    s = lambda c: F.sum(c).cast("bigint")
    per_rec = a.groupBy(key).agg(
        s("ce_tp").alias("ce_tp"), s("ce_fn").alias("ce_fn"), s("ce_fp").alias("ce_fp"),
        s("pi_tp").alias("pi_tp"), s("pi_fn").alias("pi_fn"), s("pi_fp").alias("pi_fp"),
        s("n_pred").alias("n_pred"),
        F.min("ce_first").alias("ce_first"), F.min("pi_first").alias("pi_first"))
    per_rec = per_rec.withColumn(
        "ce_fp_sticky", F.coalesce(F.col("ce_first").cast("bigint"), F.col("n_pred"))
    ).withColumn(
        "pi_fp_sticky", F.coalesce(F.col("pi_first").cast("bigint"), F.col("n_pred")))
    return per_rec.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                         for c in COUNT_COLS])


def prf1(tp, fp, fn, zero_division=None):
    """(precision, recall, f1) columns.  Zero denominators give NULL
    (the reference raises) unless ``zero_division`` is a number."""
    tp, fp, fn = [F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn)]
    p = F.try_divide(tp.cast("double"), (tp + fp).cast("double"))
    r = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    f = F.try_divide(2 * p * r, p + r)
    if zero_division is not None:
        z = F.lit(float(zero_division))
        p, r, f = F.coalesce(p, z), F.coalesce(r, z), F.coalesce(f, z)
    return p, r, f


def evaluation_report(counts: DataFrame, modes: tuple[str, ...] = ("exact",),
                      zero_division=None) -> DataFrame:
    """Per FP mode (``exact`` and/or ``sticky``) the two report
    rows, 'category extraction result' (aspect only) and 'entire pipeline
    result' (aspect and polarity).  All rows come from the one counts row,
    so the counts are computed once whatever the number of modes."""
    rows = []
    for mode in modes:
        sfx = "_sticky" if mode == "sticky" else ""
        for name, pre in (("category extraction result", "ce"),
                          ("entire pipeline result", "pi")):
            p, r, f = prf1(f"{pre}_tp", f"{pre}_fp{sfx}", f"{pre}_fn", zero_division)
            rows.append(F.struct(F.lit(name).alias("result"), p.alias("precision"),
                                 r.alias("recall"), f.alias("f1"), F.lit(mode).alias("mode")))
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Single-label accuracy.  A NULL label or prediction is a miss, in
    the count and in the mean."""
    hit = F.coalesce(F.col(y) == F.col(p), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_correct"),
                  F.avg(hit.cast("double")).alias("accuracy"))


def subset_accuracy(df: DataFrame, label: str = "label", hot: str = "hot") -> DataFrame:
    """E5: multi-label exact-match ratio (whole vector equal).  A NULL vector
    is a miss."""
    eq = F.coalesce(F.col(label) == F.col(hot), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(eq).alias("n_exact"),
                  F.avg(eq.cast("double")).alias("accuracy"))


def checked_code(code: str, n: int):
    """The code, or an error if it lies outside ``0 .. n - 1`` (NULL: none)."""
    c = F.col(code)
    err = F.raise_error(F.concat(F.lit(f"class code outside 0..{n - 1}: "), c.cast("string")))
    return F.when((c < 0) | (c >= n), err).otherwise(c).cast("int")


def one_hot(code: str, n: int):
    """0/1 vector of a code (NULL: all zero)."""
    c = checked_code(code, n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.coalesce(i == c, F.lit(False)).cast("int"))


def class_counts(df: DataFrame, label: str, hot: str) -> DataFrame:
    """Per class TP/FP/FN from 0/1 vectors (multi-label) -- the class index
    is exploded and grouped; only n_classes groups exist, so the map-side
    partial aggregate is all that is shuffled."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(label).alias("l"),
                                            F.col(hot).alias("h"))).alias("cls", "z"))
    l, h = F.col("z.l") == 1, F.col("z.h") == 1
    return z.groupBy("cls").agg(F.count_if(l & h).alias("tp"),
                                F.count_if(~l & h).alias("fp"),
                                F.count_if(l & ~h).alias("fn"))


def f1_per_class(df: DataFrame, y: str = None, p: str = None, n_classes: int = None,
                 label: str = None, hot: str = None) -> DataFrame:
    """Per-class F1.  Either single-label codes (``y``, ``p``,
    ``n_classes``) or multi-label vectors (``label``, ``hot``).  A class with
    no positives at all has F1 0 (sklearn's zero_division default)."""
    if label is None:
        df = df.select(one_hot(y, n_classes).alias("_l"), one_hot(p, n_classes).alias("_h"))
        label, hot = "_l", "_h"
    c = class_counts(df, label, hot)
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"),
                                 (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")),
                    F.lit(0.0))
    return c.withColumn("f1", f1)


def f1_macro(per_class: DataFrame) -> DataFrame:
    """Unweighted mean of per-class F1."""
    return per_class.agg(F.avg("f1").alias("f1_macro"))


def f1_micro(per_class: DataFrame) -> DataFrame:
    """F1 of the pooled TP/FP/FN."""
    s = per_class.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                      F.sum("fn").alias("fn"))
    return s.select(F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"),
                                            (2 * F.col("tp") + F.col("fp") + F.col("fn"))
                                            .cast("double")), F.lit(0.0)).alias("f1_micro"))


def prediction_distribution(df: DataFrame, p: str = "p", n_classes: int = 3) -> DataFrame:
    """Percent of predictions per class, one global aggregate.  A code
    outside the classes is an error; NULL predictions count in the total."""
    df = df.withColumn(p, checked_code(p, n_classes))
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 F.array(*[F.count_if(F.col(p) == i) for i in range(n_classes)]).alias("_c"))
    return agg.select(F.posexplode("_c").alias("cls", "n"), "_n").select(
        "cls", "n", (F.col("n") * 100.0 / F.col("_n")).alias("pct"))


def _clamped_log(x):
    return F.when(x <= 0, F.lit(-100.0)).when(x > 0, F.greatest(F.log(x), F.lit(-100.0)))


def bce_loss(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Mean binary cross-entropy over every cell (logs clamped at -100,
    as torch's BCELoss does).  Summed per row with ``aggregate``, then one
    global average -- no explode.  A row with a NULL vector or component
    counts neither in the sum nor in the divisor."""
    cells = F.zip_with(F.col(label), F.col(prob), lambda y, q: -(
        y * _clamped_log(q) + (1 - y) * _clamped_log(1 - q)))
    row_sum = F.aggregate(cells, F.lit(0.0), lambda a, v: a + v)
    s = df.select(row_sum.alias("_s"), F.size(label).alias("_n")).where("_s IS NOT NULL").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return s.select((F.col("_s") / F.col("_n")).alias("bce"))


def cross_entropy_loss(df: DataFrame, y: str = "y", scores: str = "scores") -> DataFrame:
    """Mean softmax cross-entropy ``logsumexp(s) - s[y]``; the
    reference feeds sigmoid outputs, so ``scores`` are probabilities.  A row
    with a NULL class or score takes no part; a class without a score is an
    error."""
    s = F.col(scores)
    err = F.raise_error(F.concat(F.lit("class code without a score: "), F.col(y).cast("string")))
    own = F.when((F.col(y) < 0) | (F.col(y) >= F.size(s)), err).otherwise(F.get(s, F.col(y)))
    lse = F.log(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v)))
    return df.agg(F.avg(F.when(s.isNotNull(), lse - own)).alias("ce"))
