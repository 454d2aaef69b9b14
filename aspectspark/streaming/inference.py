"""Incremental cascade inference over arriving corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aspectspark.plans.cascade import cascade_predict
from aspectspark.sources.corpus import RAW_CORPUS, write_predictions


def stream_predictions(spark: SparkSession, source_dir: str, sink_dir: str,
                       checkpoint_dir: str, scorers: dict,
                       max_files_per_trigger: int | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """Watch ``source_dir`` for corpus JSONL files; every micro-batch runs
    the cascade (C5) and writes predictions to ``sink_dir/epoch=<n>``.

    The sink path is a function of the epoch id and is overwritten on
    replay, so a batch re-run after a failure replaces its own output: each
    record's predictions land exactly once.  Progress is tracked in
    ``checkpoint_dir``, which must outlive the application and belong to this
    source and sink alone: a restart goes on from it.
    """
    reader = spark.readStream.schema(RAW_CORPUS).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.json(source_dir).select("id", "sentence_form")
    sink = sink_dir.rstrip("/")

    def _batch(df: DataFrame, epoch: int) -> None:
        write_predictions(cascade_predict(df, scorers), f"{sink}/epoch={epoch}",
                          mode="overwrite")

    w = src.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
