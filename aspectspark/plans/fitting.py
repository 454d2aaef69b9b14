"""Logistic heads by L-BFGS, any number of them in one pass per step (M2, M3).

A *problem* is a weight vector of its own: a fold's softmax over the classes,
or one label's sigmoid of a fold.  All problems are evaluated together: one
aggregate over the rows adds each row's loss and gradient to the problems
that train on it (those of the other folds).  So a step costs one scan,
whatever the number of folds and labels, and a problem's result does not
depend on the problems beside it.

The weights of all problems live on the driver and travel to the tasks; their
number is bounded by ``MAX_CELLS``, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectspark.session import ship_package

#: Weights of all problems together, at most: 32 MB of doubles, and twenty
#: times that in the driver's memory of the last steps.
MAX_CELLS = 1 << 22

#: Gradients of a problem that one task adds up at a time.
FAN = 16

HISTORY = 10


class Rows:
    """A batch of feature rows: dense vectors, or buckets of tokens."""

    def __init__(self, features: pa.Array, dim: int):
        # the buckets or components of all rows, one after another
        self.n, self.dim = len(features), dim
        sizes = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = features.flatten().to_numpy(zero_copy_only=False)
        self.dense = pa.types.is_floating(features.type.value_type)
        if self.dense:
            if (sizes != dim).any():
                raise ValueError(f"a feature vector has not {dim} components")
            self.matrix = flat.astype(np.float64).reshape(self.n, dim)
        else:
            self.buckets, self.row = flat.astype(np.int64), np.repeat(np.arange(self.n), sizes)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """``weights``: outputs x (dim + 1), the bias last."""
        if self.dense:
            return self.matrix @ weights[:, :-1].T + weights[:, -1]
        sums = [np.bincount(self.row, weights=w[self.buckets], minlength=self.n) for w in weights[:, :-1]]
        return np.stack(sums, axis=1) + weights[:, -1]

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        """Sum over the rows of their features times their errors."""
        if self.dense:
            sums = errors.T @ self.matrix
        else:
            sums = np.stack([np.bincount(self.buckets, weights=e[self.row], minlength=self.dim) for e in errors.T])
        return np.concatenate([sums, errors.sum(axis=0)[:, None]], axis=1)


def probabilities(logits: np.ndarray, kind: str) -> np.ndarray:
    if kind == "multilabel":
        return 0.5 * (1 + np.tanh(0.5 * logits))
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def losses(logits: np.ndarray, target: np.ndarray, kind: str) -> np.ndarray:
    """Per row: one loss (softmax), or one for every label (sigmoids)."""
    if kind == "multilabel":
        return np.logaddexp(0, logits) - target * logits
    top = logits.max(axis=1, keepdims=True)
    return (top[:, 0] + np.log(np.exp(logits - top).sum(axis=1)) - (target * logits).sum(axis=1))[:, None]


class Problem(NamedTuple):
    """``fold`` is left out of training (-1: none is); ``outputs`` are the
    labels that the vector covers."""

    fold: int
    outputs: tuple[int, ...]


class Fit(NamedTuple):
    weights: np.ndarray     # outputs x (dim + 1)
    loss: float
    gradient: float         # its largest component at the end
    steps: int


def _packed(gradient: np.ndarray) -> tuple[bytes, bytes]:
    """The columns that are not all zero, a bit for each, and what they hold."""
    used = gradient.any(axis=0)
    return np.packbits(used).tobytes(), gradient[:, used].tobytes()


def _add(total: np.ndarray, columns: bytes, values: bytes) -> None:
    used = np.unpackbits(np.frombuffer(columns, dtype=np.uint8), count=total.shape[1]).astype(bool)
    total[:, used] += np.frombuffer(values).reshape(len(total), -1)


def problems_of(folds: list[int], n_out: int, kind: str) -> list[Problem]:
    if kind == "multilabel":
        return [Problem(f, (j,)) for f in folds for j in range(n_out)]
    return [Problem(f, tuple(range(n_out))) for f in folds]


def _evaluate(rows: DataFrame, problems: list[Problem], points: list[np.ndarray], dim: int, kind: str):
    """Rows, loss and gradient of every problem at its point, in one scan of
    ``rows`` (features, target, fold).

    The tasks' gradients are added by tasks, ``FAN`` of them and then the sums
    of a problem, so the driver gets one gradient per problem: eight bytes a
    weight at most, whatever the number of rows and tasks."""
    held = rows.sparkSession.sparkContext.broadcast((problems, points))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems, points = held.value
        sums = [[0, 0.0, np.zeros_like(p)] for p in points]
        for batch in batches:
            if not batch.num_rows:
                continue
            data = Rows(batch.column(0), dim)
            target = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(data.n, -1)
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for problem, point, s in zip(problems, points, sums):
                own = fold != problem.fold
                logits, wanted = data.logits(point), target[:, problem.outputs]
                s[0] += int(own.sum())
                s[1] += float(losses(logits, wanted, kind)[own].sum())
                s[2] += data.gradient((probabilities(logits, kind) - wanted) * own[:, None])
        packed = [_packed(s[2]) for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([s[0] for s in sums], pa.int64()),
             pa.array([s[1] for s in sums], pa.float64()), pa.array([c for c, _ in packed], pa.binary()),
             pa.array([v for _, v in packed], pa.binary())], names=["problem", "n", "loss", "columns", "values"])

    shapes = [p.shape for p in points]

    def add(frame):
        import pandas as pd

        problem = int(frame["problem"].iloc[0])
        total = np.zeros(shapes[problem])
        frame = frame.sort_values("part")       # sums do not depend on the order of arrival
        for columns, values in zip(frame["columns"], frame["values"]):
            _add(total, columns, values)
        columns, values = _packed(total)
        return pd.DataFrame({"problem": [problem], "n": [frame["n"].sum()], "loss": [frame["loss"].sum()],
                             "columns": [columns], "values": [values], "part": [int(frame["part"].iloc[0]) // FAN]})

    schema = "problem int, n long, loss double, columns binary, values binary"
    parts = rows.mapInArrow(scan, schema).withColumn("part", F.spark_partition_id())
    fans = parts.groupBy("problem", F.expr(f"part div {FAN}").alias("fan")).applyInPandas(add, f"{schema}, part int")
    found = fans.groupBy("problem").applyInPandas(add, f"{schema}, part int").drop("part").collect()
    held.unpersist()
    out = [[0, 0.0, np.zeros_like(p)] for p in points]
    for r in sorted(found, key=lambda r: (r["problem"], r["n"], r["loss"])):
        s = out[r["problem"]]
        s[0] += r["n"]
        s[1] += r["loss"]
        _add(s[2], r["columns"], r["values"])
    return out


class _Search:
    """L-BFGS of one problem with a backtracking line search; it is told the
    value and gradient at ``trial`` and moves on."""

    def __init__(self, shape: tuple[int, int], reg: float, max_iter: int, tol: float):
        self.point, self.trial = np.zeros(shape), np.zeros(shape)
        self.value, self.gradient, self.direction, self.step = None, None, None, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.reg, self.max_iter, self.tol, self.steps, self.done = reg, max_iter, tol, 0, False

    def tell(self, n: int, loss: float, gradient: np.ndarray) -> None:
        inner = self.trial.copy()
        inner[:, -1] = 0            # the bias is not held down
        value = loss / max(n, 1) + self.reg / 2 * float((inner * inner).sum())
        gradient = gradient / max(n, 1) + self.reg * inner
        if self.value is not None:
            slope = float((self.gradient * self.direction).sum())
            if not value <= self.value + 1e-4 * self.step * slope:
                self.step /= 2
                self.done = self.step < 1e-10
                self.trial = self.point + self.step * self.direction
                return
            moved, bent = self.trial - self.point, gradient - self.gradient
            if float((moved * bent).sum()) > 1e-12:
                self.pairs = [*self.pairs[-HISTORY + 1:], (moved, bent)]
            self.steps += 1
            self.done = self.value - value <= self.tol * max(1.0, abs(value)) or self.steps >= self.max_iter
        self.point, self.value, self.gradient = self.trial, value, gradient
        if not np.abs(gradient).max(initial=0) > self.tol:
            self.done = True
        self._turn()

    def _turn(self) -> None:
        d, alphas = -self.gradient, []
        for s, y in reversed(self.pairs):
            a = float((s * d).sum() / (s * y).sum())
            alphas.append(a)
            d = d - a * y
        if self.pairs:
            s, y = self.pairs[-1]
            d = d * float((s * y).sum() / (y * y).sum())
        for (s, y), a in zip(self.pairs, reversed(alphas)):
            d = d + s * (a - float((y * d).sum() / (s * y).sum()))
        self.direction = d
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(1e-12, float(np.abs(self.gradient).sum())))
        self.trial = self.point + self.step * d


def fit_problems(rows: DataFrame, problems: list[Problem], dim: int, kind: str, max_iter: int = 50, reg: float = 0.0,
                 tol: float = 1e-9) -> list[Fit]:
    """Fit every problem over ``rows``: features (vectors of ``dim`` doubles,
    or the buckets of the tokens), target (0/1 per output) and fold.

    The objective is the mean loss and ``reg / 2`` times the squared weights
    without the biases.  Rows without features or target take no part.
    """
    cells = sum(len(p.outputs) for p in problems) * (dim + 1)
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} weights in all; at most {MAX_CELLS} fit a run: fit fewer folds or labels at once")
    ship_package(rows.sparkSession)
    rows = rows.select("features", "target", "fold").where(F.col("features").isNotNull() & F.col("target").isNotNull())
    searches = [_Search((len(p.outputs), dim + 1), reg, max_iter, tol) for p in problems]
    while True:
        at = [i for i, s in enumerate(searches) if not s.done]
        if not at:
            break
        told = _evaluate(rows, [problems[i] for i in at], [searches[i].trial for i in at], dim, kind)
        for i, (n, loss, gradient) in zip(at, told):
            searches[i].tell(n, loss, gradient)
    return [Fit(s.point, s.value, float(np.abs(s.gradient).max(initial=0)), s.steps) for s in searches]


def stacked(problems: list[Problem], fits: list[Fit]) -> dict[int, np.ndarray]:
    """The weights (outputs x (dim + 1)) of each fold."""
    out: dict[int, list[np.ndarray]] = {}
    for p, f in zip(problems, fits):
        out.setdefault(p.fold, []).append(f.weights)
    return {fold: np.concatenate(parts) for fold, parts in out.items()}


def scored(rows: DataFrame, weights: dict[int, np.ndarray], dim: int, kind: str, name: str = "prob") -> DataFrame:
    """Adds the probabilities of a row by the weights of its ``fold``, in one
    pass for all folds; NULL where the features are."""
    ship_package(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            features, fold = batch.column("features"), batch.column("fold").to_numpy(zero_copy_only=False)
            known = np.flatnonzero(features.is_valid().to_numpy(zero_copy_only=False))
            out: list = [None] * batch.num_rows
            data, own = Rows(features.take(pa.array(known)), dim), fold[known]
            for f in np.unique(own):
                found = probabilities(data.logits(held.value[int(f)]), kind)
                for i in np.flatnonzero(own == f):
                    out[known[i]] = found[i]
            yield batch.append_column(name, pa.array(out, pa.list_(pa.float64())))

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(scan, schema)
