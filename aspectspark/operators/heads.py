"""Linear heads over vectors (P11 wide variant)."""


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_head_wide(df: DataFrame, vec: str, weights, bias=None,
                     out: str = "logits") -> DataFrame:
    """``W @ vec + b`` with numpy on Arrow batches, for heads too wide for
    JVM literals.  ``W`` (n_out x dim) travels once per task in the closure."""
    import pandas as pd

    from aspectspark.session import ship_package

    ship_package(df.sparkSession)

    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def _head(s: pd.Series) -> pd.Series:
        m = np.stack(s.map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        return pd.Series(list(m @ w.T + b))

    return df.withColumn(out, _head(F.col(vec)))
