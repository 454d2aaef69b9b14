"""File-to-file jobs: the reference's four entry points as one call each.

* :func:`build_stage_sets`  -- dataset build (corpus JSONL -> stage CSVs)
* :func:`fit_stage`, :func:`cross_validate_stage` -- training (stage CSV -> saved head, fold scores)
* :func:`predict_file`   -- cascade inference (corpus -> prediction JSONL)
* :func:`vote_files`     -- ensemble hard vote (member predictions -> submission)
* :func:`evaluate_files` -- set-match report (gold + predictions -> 2 rows)

All heavy work stays in Spark; only the report rows reach the driver.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.operators.joins import vote_lookup
from aspectspark.operators.labels import encode_annotations, explode_annotations, quarantine
from aspectspark.operators.metrics import evaluation_report, set_match_counts
from aspectspark.operators.vote import ASPECT_THRESHOLD, hard_vote
from aspectspark.functions.text import build_prompt
from aspectspark.operators.sampling import materialized
from aspectspark.plans.cascade import STAGE_LABELS, cascade_predict
from aspectspark.plans.datasets import (
    SENTIMENT_SIZES, build_sentiment_dev, build_sentiment_train, build_topic_set, category_sets)
from aspectspark.plans.sparse_heads import WIDTH, SparseHead, token_buckets, train_sparse_head
from aspectspark.plans.training import cross_validate
from aspectspark.sources.corpus import (
    read_corpus, read_legacy_polarity, read_members, read_predictions, read_stage_csv,
    write_predictions, write_stage_csv)


def _flat(spark: SparkSession, path: str, on_invalid: str) -> tuple[DataFrame, DataFrame | None]:
    """(encoded annotations, invalid ones if these are to be set apart)."""
    flat = encode_annotations(explode_annotations(read_corpus(spark, path)), on_invalid)
    return quarantine(flat) if on_invalid in ("keep", "quarantine") else (flat, None)


def build_stage_sets(spark: SparkSession, train_path: str, dev_path: str, legacy_path: str,
                  out_dir: str, sizes: dict = SENTIMENT_SIZES, seed=42, compat: bool = False,
                  on_invalid: str = "fail") -> dict[str, str]:
    """Write the eight stage sets (3-way / 5-way category, topic, sentiment;
    train and dev) as header CSVs under ``out_dir``; returns name -> path.

    ``on_invalid='quarantine'`` (or ``'keep'``): annotations with an unknown
    name stay out of the sets and are written as ``invalid_<split>.csv``.

    Each corpus is parsed once: its encoded annotations are persisted for
    the few writes that read them and released at the end (a lost executor
    recomputes its blocks from the files)."""
    out = out_dir.rstrip("/")
    paths = {}

    def write(name: str, df: DataFrame) -> None:
        p = f"{out}/{name}.csv"
        write_stage_csv(df, p)
        paths[name] = p

    split = {s: _flat(spark, p, on_invalid) for s, p in (("train", train_path), ("dev", dev_path))}
    for s, (_, invalid) in split.items():
        if invalid is not None:
            write(f"invalid_{s}", invalid.select("id", "sentence_form", "aspect", "polarity"))
    flats = {s: valid.persist(StorageLevel.MEMORY_AND_DISK) for s, (valid, _) in split.items()}
    try:
        for split, flat in flats.items():
            cats = category_sets(flat)
            for tag, prefix in (("3way", "0_category_3way"), ("5way", "1_category_5way")):
                write(f"{prefix}_{split}",
                      cats.filter(F.col("set") == tag).select("input", "label"))
            write(f"2_topic_{split}", build_topic_set(flat).select("input", "entity", "label"))
        legacy = read_legacy_polarity(spark, legacy_path)
        train = build_sentiment_train(legacy, flats["train"], sizes, seed, compat)
        write("3_sentiment_train", train.select("input", "entity", "label"))
        write("3_sentiment_dev",
              build_sentiment_dev(flats["dev"]).select("input", "entity", "label"))
    finally:
        for f in flats.values():
            f.unpersist()
    return paths


def _stage_rows(spark: SparkSession, csv_path: str, stage: str) -> tuple[DataFrame, str | list[str]]:
    """``row, prompt`` and the labels of a stage CSV, and the names of the
    label columns: one class code (sentiment), or a 0/1 column per output."""
    if stage not in STAGE_LABELS:
        raise ValueError(f"unknown stage {stage!r}; known: {sorted(STAGE_LABELS)}")
    entity = "entity" if stage in ("topic", "sentiment") else None
    columns = ("input", "entity", "label") if entity else ("input", "label")
    one_class = stage == "sentiment"
    df = read_stage_csv(spark, csv_path, "int" if one_class else "array", columns)
    names = [f"label{i}" for i in range(STAGE_LABELS[stage])]
    labels = [F.col("label")] if one_class else [F.get("label", F.lit(i)).alias(n) for i, n in enumerate(names)]
    rows = df.select(F.monotonically_increasing_id().alias("row"), build_prompt(stage, "input", entity).alias("prompt"), *labels)
    return materialized(rows), "label" if one_class else names


def fit_stage(spark: SparkSession, csv_path: str, stage: str, out_path: str, dim: int = WIDTH, max_iter: int = 50,
              reg: float = 0.01) -> dict:
    """Fit the head of a stage on its CSV and save it; rows, mean loss and
    steps of the fit."""
    rows, label = _stage_rows(spark, csv_path, stage)
    kind = "multiclass" if isinstance(label, str) else "multilabel"
    head, fits = train_sparse_head(rows, "prompt", label, kind, STAGE_LABELS[stage], dim, max_iter, reg)
    head.save(out_path)
    return {"stage": stage, "rows": rows.count(), "loss": sum(f.loss for f in fits) / len(fits),
            "steps": max(f.steps for f in fits)}


def cross_validate_stage(spark: SparkSession, csv_path: str, stage: str, k: int = 5, dim: int = WIDTH, max_iter: int = 50,
                         reg: float = 0.01) -> list[dict]:
    """Scores of the ``k`` folds of a stage CSV."""
    rows, label = _stage_rows(spark, csv_path, stage)
    buckets = rows.withColumn("features", token_buckets("prompt", dim))
    out = cross_validate(buckets, label, ["row"], k, STAGE_LABELS[stage], max_iter=max_iter, reg=reg, dim=dim)
    return [r.asDict() for r in out.orderBy("fold").collect()]


def load_heads(spark: SparkSession, folder: str) -> dict:
    """The stage scorers of heads saved as ``folder/<stage>``."""
    return {s: SparseHead.load(spark, f"{folder.rstrip('/')}/{s}").scorer() for s in STAGE_LABELS}


def predict_file(spark: SparkSession, corpus_path: str, out_path: str,
                 scorers: dict, threshold: float = 0.5) -> None:
    """Cascade inference over a corpus file (gold annotations ignored)."""
    c = read_corpus(spark, corpus_path).select("id", "sentence_form")
    write_predictions(cascade_predict(c, scorers, threshold), out_path)


def vote_files(spark: SparkSession, members_dir: str, corpus_path: str, out_path: str,
               threshold: int = ASPECT_THRESHOLD, layout: str = "dirs") -> None:
    """Hard vote of every member under ``members_dir``; one output record per
    corpus record (empty list when no member voted)."""
    m = read_members(spark, members_dir, layout=layout)
    flat = m.select("member", "id", F.posexplode("annotation").alias("pos", "a")).select(
        "member", "id", "pos", "a.aspect", "a.polarity")
    corpus = read_corpus(spark, corpus_path).select("id", "sentence_form")
    write_predictions(vote_lookup(corpus, hard_vote(flat, "id", threshold)), out_path)


def evaluate_files(spark: SparkSession, gold_path: str, pred_path: str,
                   modes: tuple[str, ...] = ("exact",)) -> list[dict]:
    """The two report rows per FP mode, as plain dicts."""
    gold = explode_annotations(read_corpus(spark, gold_path)).select(
        "id", "pos", "aspect", "polarity")
    pred = explode_annotations(read_predictions(spark, pred_path)).select(
        "id", "pos", "aspect", "polarity")
    rep = evaluation_report(set_match_counts(gold, pred), modes)
    return [r.asDict() for r in rep.collect()]
