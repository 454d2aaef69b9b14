"""Score-vector and id-vector column functions.

All are higher-order built-ins (``transform``/``aggregate``/``zip_with``),
evaluated in the JVM per row; none needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def hot_text(arr: Column | str, sep: str = ",") -> Column:
    """Array of numbers -> ``'1,0,1'`` (flat text for checks and CSV)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)


def sigmoid(logits: Column | str) -> Column:
    """Element-wise logistic function."""
    return F.transform(_c(logits), lambda x: 1.0 / (1.0 + F.exp(-x)))


def threshold_decode(scores: Column | str, threshold: float = 0.5) -> Column:
    """Strict ``score > threshold`` -> 0/1 vector, no fallback."""
    return F.transform(_c(scores), lambda x: (x > F.lit(threshold)).cast("int"))


def argmax(scores: Column | str) -> Column:
    """0-based index of the first maximum."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def threshold_decode_or_top1(scores: Column | str, threshold: float = 0.5) -> Column:
    """As P13, but when no score passes, the first argmax slot is set."""
    s = _c(scores)
    none_pass = ~F.exists(s, lambda x: x > F.lit(threshold))
    top = argmax(s)
    return F.transform(
        s, lambda x, i: ((x > F.lit(threshold)) | (none_pass & (i == top))).cast("int"))


def linear_head(vec: Column | str, weights: list[list[float]],
                bias: list[float] | None = None) -> Column:
    """``W @ vec + b`` for a small head, one JVM dot product per output.

    ``weights`` is ``n_out x dim``.  For heads with thousands of outputs use
    :func:`aspectspark.operators.heads.linear_head_wide` (numpy in a pandas
    UDF) instead; literal arrays that large would bloat the generated code.
    """
    v = _c(vec).cast("array<double>")
    bias = bias or [0.0] * len(weights)
    outs = []
    for row, b in zip(weights, bias):
        w = F.array(*[F.lit(float(x)) for x in row])
        prod = F.zip_with(v, w, lambda x, y: x * y)
        outs.append(F.aggregate(prod, F.lit(0.0), lambda acc, y: acc + y) + F.lit(float(b)))
    return F.array(*outs)


def segment_ids(ids: Column | str, sep_id: int = 3) -> Column:
    """P10: 1 for positions after the first SEP up to and including the
    second, else 0.  Fewer than two SEPs -> all zeros.

    Three runs of equal values, laid end to end: nothing is looked up again
    for each position."""
    x = _c(ids)
    n, s1 = F.size(x), F.array_position(x, sep_id)          # 1-based, 0: none
    between = F.array_position(F.slice(x, (s1 + 1).cast("int"), n), sep_id)
    ones = F.when((s1 > 0) & (between > 0), between).otherwise(0).cast("int")
    before = F.when(ones > 0, s1).otherwise(0).cast("int")
    return F.when(x.isNotNull(), F.concat(F.array_repeat(F.lit(0), before), F.array_repeat(F.lit(1), ones),
                                          F.array_repeat(F.lit(0), n - before - ones)))
