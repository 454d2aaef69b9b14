"""Head training and cross-validation (M2, M3), re-aimed on Spark ML.

The reference fine-tunes transformer encoders on GPUs; what a Spark user
runs at scale is the head on precomputed features: one logistic regression
per stage -- multinomial for single-label stages, one binary model per
label for multi-label stages (independent sigmoids, like BCE heads).
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.functions.text import tokens
from aspectspark.functions.vectors import argmax, hot_text, linear_head, sigmoid, threshold_decode
from aspectspark.operators.metrics import one_hot
from aspectspark.operators.sampling import null_safe_join, stratified_kfold
from aspectspark.plans import fitting
from aspectspark.session import shared_dir


def vector_features(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))


def text_features(df: DataFrame, text: str, n_features: int = 1 << 18,
                  out: str = "features") -> DataFrame:
    """Hashed bag of whitespace tokens (no vocabulary pass needed)."""
    x = df.withColumn("_tok", tokens(text))
    return HashingTF(inputCol="_tok", outputCol=out, numFeatures=n_features) \
        .transform(x).drop("_tok")


def hashed_counts(text, dim: int):
    """Token counts by hash bucket, an array of ``dim`` doubles: features
    that the same expression gives in training and in scoring."""
    bucket = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.size(F.filter(bucket, lambda x: x == i)).cast("double"))


class LinearHead:
    """A fitted head: ``n_out x dim`` weights and biases, with a softmax over
    the outputs (``multiclass``) or a sigmoid for each (``multilabel``)."""

    def __init__(self, weights: list[list[float]], bias: list[float] | None = None,
                 kind: str = "multiclass"):
        if kind not in ("multiclass", "multilabel"):
            raise ValueError(f"kind: {kind!r}")
        self.weights, self.kind = weights, kind
        self.bias = bias or [0.0] * len(weights)

    def scores(self, vec):
        """Probabilities of a feature array."""
        logits = linear_head(vec, self.weights, self.bias)
        if self.kind == "multilabel":
            return sigmoid(logits)

        def softmax(x):
            e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
            return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

        return F.transform(F.array(logits), softmax)[0]

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``prob`` and ``prediction`` (multiclass) or ``hot``."""
        vec = F.col(features)
        if df.schema[features].dataType.typeName() != "array":
            vec = vector_to_array(vec)
        out = df.withColumn("prob", self.scores(vec))
        if self.kind == "multiclass":
            return out.withColumn("prediction", argmax("prob"))
        return out.withColumn("hot", threshold_decode("prob"))

    __call__ = predict

    def save(self, spark: SparkSession, path: str) -> None:
        row = json.dumps({"kind": self.kind, "weights": self.weights, "bias": self.bias})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearHead:
        return cls(**json.loads(spark.read.text(path).first()["value"]))


class HeadScorer:
    """A fitted head over hashed token counts as a stage scorer."""

    def __init__(self, head: LinearHead):
        self.head, self.n_labels = head, len(head.weights)

    def column(self, prompt, mask=None):
        s = self.head.scores(hashed_counts(prompt, len(self.head.weights[0])))
        return s if mask is None else F.when(mask, s)


def train_head(df: DataFrame, label: str | list[str], kind: str = "multiclass",
               features: str = "features", max_iter: int = 50, reg: float = 0.0) -> LinearHead:
    """M2: fit a head.  ``kind='multiclass'``: one multinomial model on
    integer ``label``; ``'multilabel'``: one binary model per label column.
    The result scores, saves and loads without Spark ML."""
    def fit(column: str, family: str):
        return LogisticRegression(featuresCol=features, labelCol=column, family=family,
                                  maxIter=max_iter, regParam=reg).fit(
            df.withColumn(column, F.col(column).cast("double")))

    if kind == "multiclass":
        m = fit(label, "multinomial")
        return LinearHead(m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist(), kind)
    models = [fit(c, "binomial") for c in ([label] if isinstance(label, str) else label)]
    return LinearHead([m.coefficients.toArray().tolist() for m in models],
                      [float(m.intercept) for m in models], kind)


def targets(df: DataFrame, label: str | list[str], kind: str, n_classes: int | None = None):
    """0/1 per output (NULL if a label is), and the number of outputs."""
    if kind == "multilabel":
        labels = [label] if isinstance(label, str) else list(label)
        known = F.lit(True)
        for c in labels:
            known = known & F.col(c).isNotNull()
        return F.when(known, F.array(*[F.col(c).cast("int") for c in labels])), len(labels)
    # one number reaches the driver, never rows
    n = n_classes or df.agg(F.max(label)).first()[0] + 1
    return F.when(F.col(label).isNotNull(), one_hot(label, n)), n


def fold_metrics(pred: DataFrame, n: int, kind: str, by: str = "fold") -> DataFrame:
    """One row per fold from ``label`` and ``hot`` (0/1 vectors of width
    ``n``) and ``prob``, in one aggregate: n_valid, per class support, number
    predicted and F1, exact-match accuracy, macro and micro F1, and the loss
    (binary cross-entropy over all cells, or -log of the true class).

    A row without a label or without probabilities is a miss; the loss is
    the mean over the rows that have both."""
    y, h, q = (lambda i: F.get("label", F.lit(i))), (lambda i: F.get("hot", F.lit(i))), F.col("prob")
    safe = lambda x: F.when(x.isNotNull(), F.greatest(F.log(F.greatest(x, F.lit(1e-300))), F.lit(-100.0)))
    if kind == "multilabel":
        cells = F.zip_with("label", q, lambda a, p: -(a * safe(p) + (1 - a) * safe(1 - p)))
        loss = F.aggregate(cells, F.lit(0.0), lambda a, v: a + v) / n
    else:
        loss = -safe(F.get(q, F.array_position("label", 1).cast("int") - 1))
    per_class = lambda name, cell: F.array(*[F.coalesce(F.sum(cell(i)), F.lit(0)) for i in range(n)]).alias(name)
    sums = pred.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.avg(F.coalesce(F.col("label") == F.col("hot"), F.lit(False)).cast("double")).alias("accuracy"),
        F.avg(loss).alias("loss"), per_class("support", y), per_class("predicted", h),
        per_class("tp", lambda i: y(i) * h(i)))
    # tp + fp = predicted, tp + fn = support
    f1 = F.transform(F.arrays_zip("tp", "support", "predicted"), lambda x: F.coalesce(
        F.try_divide(2.0 * x["tp"], (x["support"] + x["predicted"]).cast("double")), F.lit(0.0)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    out = sums.withColumn("f1", f1)
    return out.select(
        by, "n_valid", "support", "predicted", "f1", "accuracy", "loss",
        (F.aggregate("f1", F.lit(0.0), lambda a, v: a + v) / n).alias("f1_macro"),
        F.coalesce(F.try_divide(2.0 * total("tp"), (total("support") + total("predicted")).cast("double")),
                   F.lit(0.0)).alias("f1_micro"))


def fold_rows(df: DataFrame, label: str | list[str], keys: list[str], k: int, n_classes: int | None, features: str,
              seed=42) -> tuple[DataFrame, int]:
    """features, target and fold of every row, and the number of outputs.

    Only the keys and folds are checkpointed; the features are read again
    and joined with them.  ``keys`` name a row: equal ones are an error.
    """
    shared_dir(df.sparkSession)          # the cluster's checkpoint dir (set in tests only)
    many = not isinstance(label, str)
    stratum = hot_text(F.array(*label)) if many else F.col(label)
    ranked = stratified_kfold(df.select(*keys, stratum.alias("_stratum")), "_stratum", keys, k=k, seed=seed)
    folds = ranked.select(*keys, "fold").checkpoint(eager=True)
    if not folds.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows with equal {keys}: folds are given by key")
    target, n = targets(df, label, "multilabel" if many else "multiclass", n_classes)
    vec = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(F.col(features))
    rows = null_safe_join(df.select(*keys, vec.alias("features"), target.alias("target")), folds, keys)
    return rows.select("features", "target", "fold"), n


def cross_validate(df: DataFrame, label: str | list[str], keys: list[str], k: int = 5,
                   n_classes: int | None = None, features: str = "features",
                   seed=42, max_iter: int = 50, reg: float = 0.0, dim: int | None = None) -> DataFrame:
    """M3: stratified k-fold (W2), a head per fold on the rows of the others
    (W3), and its scores on the fold: ``fold, n_train`` and
    :func:`fold_metrics`.

    ``label``: one integer column (single-label stage), or a list of 0/1
    columns (multi-label stage, stratified by their combination).  Train and
    dev rows go in together, as one frame (``unions.concat_splits``).
    ``features``: vectors, or the buckets of the tokens (array<int>) with
    their number ``dim``.

    All folds are fitted together, one scan per step for all of them, and
    scored in one more (:mod:`aspectspark.plans.fitting`).  The rows are kept
    in the executors' memory or on their disks for that; a lost executor
    costs a read of its part of the source and of the checkpointed folds.
    """
    kind = "multiclass" if isinstance(label, str) else "multilabel"
    rows, n = fold_rows(df, label, keys, k, n_classes, features, seed)
    rows = rows.persist()
    total = rows.count()
    if dim is None:
        dim = rows.agg(F.max(F.size("features"))).first()[0] or 0
    problems = fitting.problems_of(list(range(k)), n, kind)
    fits = fitting.fit_problems(rows, problems, dim, kind, max_iter, reg)
    pred = fitting.scored(rows, fitting.stacked(problems, fits), dim, kind)
    hot = threshold_decode("prob") if kind == "multilabel" else F.when(F.col("prob").isNotNull(), one_hot("_p", n))
    pred = pred.withColumn("_p", argmax("prob")).select("fold", F.col("target").alias("label"), hot.alias("hot"), "prob")
    found = fold_metrics(pred, n, kind)
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    out = every.join(found, "fold", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("bigint")))
    out = out.select("fold", (F.lit(total) - F.col("n_valid")).alias("n_train"), *found.columns[1:]).checkpoint(eager=True)
    rows.unpersist()
    return out
