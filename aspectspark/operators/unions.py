"""Pool and split unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectspark.operators.labels import recode_legacy


def sentiment_pools(legacy: DataFrame, corpus_flat: DataFrame,
                    compat: bool = False) -> DataFrame:
    """Sentiment training pools ``input, entity, label, key``.

    Legacy rows go through F2 (positives dropped).  Corpus annotations keep
    their polarity code.  ``compat=True`` reproduces the reference's
    if/if-else slip: positive annotations *also* enter the neutral pool with
    label 2.  ``key`` identifies the source row for seeded sampling.
    """
    old = recode_legacy(legacy).withColumn(
        "key", F.concat_ws(":", F.lit("L"), "input", "entity"))
    new = corpus_flat.select(
        F.col("sentence_form").alias("input"), F.col("aspect").alias("entity"),
        F.col("pol").alias("label"),
        F.concat_ws(":", F.lit("C"), F.col("id").cast("string"),
                    F.col("pos").cast("string")).alias("key"))
    if compat:
        copies = F.when(F.col("label") == 0, F.array(F.lit(0), F.lit(2))) \
                  .otherwise(F.array(F.col("label")))
        new = new.withColumn("label", F.explode(copies)).withColumn(
            "key", F.concat_ws(":", "key", F.col("label").cast("string")))
    return old.unionByName(new)


def concat_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Row concat of named splits with a ``split`` column."""
    out = None
    for name, df in parts.items():
        x = df.withColumn("split", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def merge_stage_outputs(direct: DataFrame, routed: DataFrame | None = None) -> DataFrame:
    """U4: direct stage-0 categories plus categories routed through the
    fine stage, in one frame.  The cascade tags both in one pass
    (``routed``); such a frame alone is merged already."""
    return direct if routed is None else direct.unionByName(routed)
