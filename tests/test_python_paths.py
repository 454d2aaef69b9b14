"""Python-side paths: tokenizer hook, wide head, multi-label head training."""

import numpy as np
from pyspark.sql import functions as F

from aspectspark.functions.vectors import linear_head
from aspectspark.operators.heads import linear_head_wide
from aspectspark.operators.tokens import encode_with
from aspectspark.plans import cascade, training
from aspectspark.plans.scorers import PandasScorer, load_scorer
from aspectspark.sources import fixtures as fx
from tests.conftest import SF001


def test_tokenizer_hook(spark):
    def fake_tokenizer(texts, max_len):   # local: pickled by value for the workers
        return [[len(w) for w in t.split()][:max_len] for t in texts]

    df = spark.createDataFrame([("ab cde f",), ("",)], "text string")
    got = [(r.input_ids, r.attention_mask) for r in encode_with(df, "text", fake_tokenizer, 4).collect()]
    assert got == [([2, 3, 1, 0], [1, 1, 1, 0]), ([0] * 4, [0] * 4)]


def test_wide_head_equals_jvm_head(spark):
    e = fx.table(spark, SF001, "embeddings")
    w = [[((j * 64 + k) % 7) - 3 for k in range(64)] for j in range(10)]
    b = [0.5 * j for j in range(10)]
    a = e.select("vec_id", linear_head("embedding", w, b).alias("jvm"))
    c = linear_head_wide(e.select("vec_id", "embedding"), "embedding", w, b, "np")
    j = {r.vec_id: r.jvm for r in a.collect()}
    for r in c.collect():
        assert np.allclose(r.np, j[r.vec_id], rtol=1e-9, atol=1e-9)


def test_pandas_scorer_masks_rows(spark):
    calls = []

    def loader():
        def model(prompts):
            calls.append(len(prompts))
            return np.tile([0.1, 0.9], (len(prompts), 1))
        return model

    sc = PandasScorer(2, loader)
    df = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "p string, m boolean")
    got = {r.p: r.s for r in df.select("p", sc.column(F.col("p"), F.col("m")).alias("s"))
           .collect()}
    assert got["b"] is None and got["a"] == [0.1, 0.9]


def test_md5_scorers_agree(spark):
    d = fx.table(spark, SF001, "documents").select("text")
    jvm, py = load_scorer("md5", 3), load_scorer("md5_python", 3)
    rows = d.select(jvm.column(F.col("text")).alias("a"), py.column(F.col("text")).alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_multilabel_head(spark):
    docs = fx.table(spark, SF001, "documents").join(fx.table(spark, SF001, "labels"), "doc_id")
    feats = training.vector_features(
        docs.withColumn("counts", training.hashed_counts("text", 64)), "counts")
    head = training.train_head(feats, ["quality", "toxic"], "multilabel", max_iter=10)
    out = head.predict(feats).select("doc_id", "hot", "prob")
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(len(r.hot) == 2 and all(0.0 <= p <= 1.0 for p in r.prob) for r in rows)


def test_head_fits_saves_loads_and_scores_the_cascade(spark, tmp_path):
    docs = fx.table(spark, SF001, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("sentence_form"),
        (F.col("doc_id") % 3).cast("int").alias("y"))
    feats = training.vector_features(
        docs.withColumn("counts", training.hashed_counts("sentence_form", 16)), "counts")
    head = training.train_head(feats, "y", "multiclass", max_iter=5)
    head.save(spark, str(tmp_path / "head"))
    again = training.LinearHead.load(spark, str(tmp_path / "head"))
    assert (again.weights, again.bias, again.kind) == (head.weights, head.bias, head.kind)
    scorers = {s: training.HeadScorer(training.LinearHead(
        [again.weights[i % 3] for i in range(n)], [again.bias[i % 3] for i in range(n)],
        "multiclass" if s == "sentiment" else "multilabel")) for s, n in cascade.STAGE_LABELS.items()}
    out = cascade.cascade_predict(docs.select("id", "sentence_form"), scorers)
    assert out.count() == docs.count()
    assert out.filter(F.size("annotation") > 0).count() > 0


def test_unknown_scorer_options_raise():
    import pytest

    with pytest.raises(TypeError):
        load_scorer("md5_python", 3, member="member")
    with pytest.raises(ValueError):
        load_scorer("no_such_model", 3)
