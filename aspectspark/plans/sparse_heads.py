"""Heads over hashed tokens at real widths (M1, M2): a weight table by bucket.

A text's logits are the bias and the sum of the weight rows of its tokens'
buckets, so scoring costs as much as the text has tokens, whatever the width.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import hash6
from aspectspark.functions.text import tokens
from aspectspark.functions.vectors import argmax, sigmoid, threshold_decode
from aspectspark.plans import fitting
from aspectspark.plans.scorers import PandasScorer

#: Buckets by default, as wide as hashed text features usually are.
WIDTH = 1 << 18

#: Weights that are sent to every worker at most (32 MB); a wider head scores
#: by a shuffled join (:meth:`SparseHead.predict`).
MAX_SENT = 1 << 22


def bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: md5, so SQL and Python agree."""
    return (hash6(token) % dim).cast("int")


def token_buckets(text: Column | str, dim: int = WIDTH) -> Column:
    """Bucket of every whitespace token of a text (NULL: NULL)."""
    return F.transform(tokens(text), lambda t: bucket(t, dim))


def _buckets_py(text: str, dim: int) -> list[int]:
    import hashlib
    import re

    # the JVM's token split (functions.text)
    return [int(hashlib.md5(t.encode("utf-8")).hexdigest()[:6], 16) % dim
            for t in re.split("[ \t\n\r\f\x0b]+", text) if t]


class SparseHead:
    """``table``: bucket int, weights array<double> (one per output); a
    bucket without a row weighs nothing."""

    def __init__(self, table: DataFrame, bias: list[float], dim: int = WIDTH, kind: str = "multiclass"):
        if kind not in ("multiclass", "multilabel"):
            raise ValueError(f"kind: {kind!r}")
        self.table, self.bias, self.dim, self.kind = table, [float(b) for b in bias], dim, kind

    @classmethod
    def of(cls, spark: SparkSession, weights: np.ndarray, kind: str) -> SparseHead:
        """From fitted weights, outputs x (dim + 1)."""
        import pyarrow as pa

        used = np.flatnonzero(np.abs(weights[:, :-1]).sum(axis=0))
        rows = pa.table({"bucket": pa.array(used, pa.int32()), "weights": pa.array(list(weights[:, used].T), pa.list_(pa.float64()))})
        return cls(spark.createDataFrame(rows), weights[:, -1].tolist(), weights.shape[1] - 1, kind)

    def save(self, path: str) -> None:
        """The table as Parquet, and a line with the rest."""
        self.table.select("bucket", "weights").write.mode("overwrite").parquet(f"{path}/table")
        about = json.dumps({"bias": self.bias, "dim": self.dim, "kind": self.kind})
        self.table.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseHead:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        return cls(spark.read.parquet(f"{path}/table"), **about)

    def logits(self, df: DataFrame, keys: list[str], text: str) -> DataFrame:
        """``keys`` and logits of every row.

        Tokens meet the weights by a join on the bucket.  A table of at most
        ``MAX_SENT`` weights is broadcast, so only the sums are shuffled, a
        row per text and task; for a larger one the tokens of a text are
        counted by bucket first, and these counts are shuffled.
        """
        outputs = range(len(self.bias))
        small = len(self.bias) * (self.dim + 1) <= MAX_SENT
        weights = self.table.select("bucket", *[F.get("weights", F.lit(j)).alias(f"_w{j}") for j in outputs])
        each = df.select(*keys, F.explode_outer(token_buckets(text, self.dim)).alias("bucket")).withColumn("_n", F.lit(1))
        if not small:
            each = each.groupBy(*keys, "bucket").agg(F.sum("_n").alias("_n"))
        joined = each.join(F.broadcast(weights) if small else weights, "bucket", "left")
        sums = joined.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col("_n") * F.col(f"_w{j}"), F.lit(0.0))).alias(f"_s{j}") for j in outputs])
        return sums.select(*keys, F.array(*[F.col(f"_s{j}") + F.lit(self.bias[j]) for j in outputs]).alias("logits"))

    def predict(self, df: DataFrame, keys: list[str], text: str) -> DataFrame:
        """``keys``, logits, prob and prediction (multiclass) or hot; rows of
        one key are one text.  A text without tokens scores the bias."""
        out = self.logits(df, keys, text)
        if self.kind == "multilabel":
            return out.withColumn("prob", sigmoid("logits")).withColumn("hot", threshold_decode("prob"))
        e = F.transform("logits", lambda v: F.exp(v - F.array_max("logits")))
        prob = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
        return out.withColumn("prob", prob).withColumn("prediction", argmax("logits"))

    def scorer(self) -> PandasScorer:
        """The head as a stage scorer: the weights travel once per worker."""
        n, dim, kind = len(self.bias), self.dim, self.kind
        if n * (dim + 1) > MAX_SENT:
            raise ValueError(f"{n * (dim + 1)} weights; a scorer sends {MAX_SENT} at most: use predict")
        weights = np.zeros((n, dim + 1))
        for r in self.table.toLocalIterator():
            weights[:, r["bucket"]] = r["weights"]
        weights[:, -1] = self.bias
        held = self.table.sparkSession.sparkContext.broadcast(weights)

        def load():
            w = held.value

            def score(prompts: list[str]) -> np.ndarray:
                found = [_buckets_py(p, dim) for p in prompts]
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = np.array([b for f in found for b in f], dtype=np.int64)
                sums = [np.bincount(row, weights=w[j][flat], minlength=len(found)) + w[j, -1] for j in range(n)]
                return fitting.probabilities(np.stack(sums, axis=1), kind)

            return score

        return PandasScorer(n, load)


def train_sparse_head(df: DataFrame, text: str, label: str | list[str], kind: str = "multiclass", n_classes: int | None = None,
                      dim: int = WIDTH, max_iter: int = 50, reg: float = 0.0) -> tuple[SparseHead, list[fitting.Fit]]:
    """M2 over hashed tokens: the head, and the fits (loss, gradient, steps).

    ``label``: an integer column of ``n_classes`` classes, or 0/1 columns.
    """
    from aspectspark.plans.training import targets

    target, n = targets(df, label, kind, n_classes)
    rows = df.select(token_buckets(text, dim).alias("features"), target.alias("target"), F.lit(0).alias("fold")).persist()
    problems = fitting.problems_of([-1], n, kind)
    fits = fitting.fit_problems(rows, problems, dim, kind, max_iter, reg)
    rows.unpersist()
    return SparseHead.of(df.sparkSession, fitting.stacked(problems, fits)[-1], kind), fits
