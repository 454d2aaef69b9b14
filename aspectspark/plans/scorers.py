"""Pluggable stage scorers (M1).

A scorer turns a prompt column into a probability vector of fixed length.
Two kinds exist:

* :class:`Md5Scorer` -- a deterministic stand-in model written as a JVM
  expression (md5 of ``prompt:label[:member]``); exact in SQL, so the
  cascade can be checked end to end.
* :class:`PandasScorer` -- any Python model (onnxruntime, numpy, ...), run
  on Arrow batches by an iterator Arrow UDF.  The model is loaded once per
  Python worker by ``loader()`` and stays for later tasks; only rows that
  need a score are sent to it, those of like length together.

``SCORERS`` is the registry by name, like the reference's model loader.
"""


import hashlib
import uuid
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import hash6


class Md5Scorer:
    """score_i = H(prompt ':' i [':' member]) % 1000 / 1000.

    ``member`` names a column with the member id; ``salt`` is a fixed one."""

    def __init__(self, n_labels: int, member: str | None = None, salt: int | None = None):
        self.n_labels = n_labels
        self.tail = [] if member is None else [F.lit(":"), F.col(member).cast("string")]
        if salt is not None:
            self.tail.append(F.lit(f":{salt}"))

    def column(self, prompt: Column, mask: Column | None = None) -> Column:
        parts = lambda i: [prompt, F.lit(f":{i}"), *self.tail]
        s = F.array(*[(hash6(F.concat(*parts(i))) % 1000) / 1000.0
                      for i in range(self.n_labels)])
        return s if mask is None else F.when(mask, s)


def md5_scores_py(prompts: list[str], n_labels: int, members=None) -> np.ndarray:
    """The same md5 model in plain Python (used through PandasScorer)."""
    out = np.empty((len(prompts), n_labels))
    for r, p in enumerate(prompts):
        sfx = "" if members is None else f":{members[r]}"
        for i in range(n_labels):
            h = hashlib.md5(f"{p}:{i}{sfx}".encode("utf-8")).hexdigest()[:6]
            out[r, i] = (int(h, 16) % 1000) / 1000.0
    return out


#: Models that a Python worker keeps; beyond that the one unused for longest goes.
KEPT_MODELS = 8
_MODELS: dict[str, Callable] = {}


def worker_model(key: str, loader: Callable[[], Callable]) -> Callable:
    """The model of ``key`` in this Python worker, loaded if it has none."""
    model = _MODELS.pop(key, None)
    if model is None:
        model = loader()
    _MODELS[key] = model            # last in order: used last
    while len(_MODELS) > KEPT_MODELS:
        del _MODELS[next(iter(_MODELS))]
    return model


#: Bytes of prompts that go to the model at a time.
SCORE_BYTES = 1 << 20


def score_batch(model: Callable, prompts: pa.Array, n: int) -> pa.Array:
    """The ``n`` scores of every prompt of a batch (NULL: NULL)."""
    known = np.flatnonzero(prompts.is_valid().to_numpy(zero_copy_only=False))
    sizes = pc.utf8_length(prompts).fill_null(0).to_numpy(zero_copy_only=False)
    todo = known[np.argsort(sizes[known], kind="stable")]
    taken = np.cumsum(pc.binary_length(prompts).fill_null(0).to_numpy(zero_copy_only=False)[todo]) // SCORE_BYTES
    scores = np.zeros((len(prompts), n))
    for rows in np.split(todo, np.flatnonzero(np.diff(taken)) + 1) if len(todo) else ():
        found = np.asarray(model(prompts.take(pa.array(rows)).to_pylist()), dtype=np.float64)
        scores[rows] = found.reshape(-1, n)
    # as many values as known rows have; a NULL row has none
    ends = np.concatenate([[0], np.cumsum(np.isin(np.arange(len(prompts)), known, assume_unique=True) * n)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(scores[known].ravel()),
                                    mask=prompts.is_null() if prompts.null_count else None)


class PandasScorer:
    """Python model on Arrow batches.  ``loader()`` returns a callable
    ``model(list[str]) -> array (n, n_labels)``; it runs once per Python
    worker and ``key`` (by default the scorer's own).

    A batch goes to the model in order of length, so a model that pads its
    input pads little; the scores come back in the order of the rows.  The
    prompts of a batch become Python strings ``SCORE_BYTES`` at a time (one
    prompt at least), the rest stays in Arrow: a worker holds one batch and
    that, whatever the number of rows."""

    def __init__(self, n_labels: int, loader: Callable[[], Callable], key: str | None = None):
        self.n_labels = n_labels
        self.loader = loader
        self.key = key or uuid.uuid4().hex

    def column(self, prompt: Column, mask: Column | None = None) -> Column:
        from aspectspark.session import ship_package

        ship_package(SparkSession.getActiveSession())
        loader, n, key = self.loader, self.n_labels, self.key

        @F.arrow_udf("array<double>")
        def _score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from aspectspark.plans.scorers import score_batch, worker_model

            model = worker_model(key, loader)
            for prompts in batches:
                yield score_batch(model, prompts, n)

        p = prompt if mask is None else F.when(mask, prompt)
        return _score(p)


def _md5_python(n_labels: int, salt: int | None = None) -> PandasScorer:
    def load():
        return lambda prompts: md5_scores_py(
            prompts, n_labels, None if salt is None else [salt] * len(prompts))

    return PandasScorer(n_labels, load)


SCORERS = {"md5": Md5Scorer, "md5_python": _md5_python}


def load_scorer(name: str, n_labels: int, **kw):
    """Registry lookup, e.g. ``load_scorer('md5', 3)``; an option that the
    scorer does not have is a TypeError."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}")
    return SCORERS[name](n_labels, **kw)
