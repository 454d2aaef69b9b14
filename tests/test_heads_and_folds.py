"""Heads at full width, all folds in one pass, losses with NULL rows, models
per worker, members by path, and cascade counts in one pass."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from aspectspark.functions.text import tokens
from aspectspark.operators import aggregates, metrics, sampling
from aspectspark.plans import cascade, fitting, sparse_heads, training
from aspectspark.plans.scorers import PandasScorer
from aspectspark.sources import corpus as io
from tests.conftest import SF001


def feature_rows(spark, n=300, dim=6, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=(classes, dim))
    x = rng.normal(size=(n, dim))
    y = np.argmax(x @ truth.T + 2 * rng.gumbel(size=(n, classes)), axis=1)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), [int(y[i] == c) for c in range(classes)], i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, y int, target array<int>, fold int").repartition(3).cache()


def test_softmax_fit_equals_the_library(spark):
    rows = feature_rows(spark)
    problem = fitting.problems_of([-1], 3, "multiclass")
    fit = fitting.fit_problems(rows, problem, 6, "multiclass", max_iter=200, reg=0.01, tol=1e-12)[0]
    ml = LogisticRegression(family="multinomial", maxIter=500, regParam=0.01, standardization=False, tol=1e-12,
                            labelCol="y").fit(training.vector_features(rows, "features"))
    assert np.allclose(fit.weights[:, :-1], ml.coefficientMatrix.toArray(), atol=1e-4)
    own, lib = fit.weights[:, -1], ml.interceptVector.toArray()
    assert np.allclose(own - own.mean(), lib - lib.mean(), atol=1e-4) and fit.gradient < 1e-5


@pytest.mark.parametrize("kind", ["multiclass", "multilabel"])
def test_folds_together_equal_separate_fits(spark, kind):
    rows = feature_rows(spark)
    together = fitting.problems_of([0, 1, 2, 3], 3, kind)
    fits = fitting.stacked(together, fitting.fit_problems(rows, together, 6, kind, max_iter=30, reg=0.01))
    for f in range(4):
        alone = fitting.problems_of([-1], 3, kind)
        one = fitting.stacked(alone, fitting.fit_problems(rows.where(F.col("fold") != f), alone, 6, kind, max_iter=30, reg=0.01))[-1]
        assert np.allclose(fits[f], one, atol=1e-6)


def test_bucket_rows_equal_dense_rows(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "b c"), (0, "a"), (1, ""), (1, "c c c"), (0, None), (0, "d a")], "y int, text string")
    dim, one = 16, F.array(F.when(F.col("y") == 1, 1).otherwise(0))
    sparse = df.select(sparse_heads.token_buckets("text", dim).alias("features"), one.alias("target"), F.lit(0).alias("fold"))
    dense = sparse.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(
        F.col("features").isNotNull(), F.size(F.filter("features", lambda b: b == i)).cast("double"))))
    dense = dense.withColumn("features", F.when(F.get("features", F.lit(0)).isNotNull(), F.col("features")))
    problems = fitting.problems_of([-1], 1, "multilabel")
    a, b = (fitting.fit_problems(d, problems, dim, "multilabel", max_iter=20, reg=0.1)[0] for d in (sparse, dense))
    assert np.allclose(a.weights, b.weights, atol=1e-9) and a.loss == pytest.approx(b.loss)


def test_too_many_weights_are_an_error(spark):
    with pytest.raises(ValueError, match="weights in all"):
        fitting.fit_problems(feature_rows(spark), fitting.problems_of([0], 3, "multiclass"), fitting.MAX_CELLS, "multiclass")


TEXTS = [(1, "one two two"), (2, "three\tone  one\n"), (3, ""), (4, None), (5, "日本 über x"), (6, " ".join(f"w{i}" for i in range(500)))]


def by_hand(weights, bias, dim):
    out = {}
    for i, text in TEXTS:
        bs = [int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dim for t in (text or "").split()]
        out[i] = [b + sum(weights[x][j] for x in bs) for j, b in enumerate(bias)]
    return out


@pytest.mark.parametrize("sent", [sparse_heads.MAX_SENT, 0])
@pytest.mark.parametrize("kind", ["multiclass", "multilabel"])
def test_sparse_head(spark, tmp_path, monkeypatch, sent, kind):
    dim, bias = 1 << 10, [0.5, -0.25]
    rng = np.random.default_rng(2)
    weights = np.concatenate([rng.normal(size=(2, dim)) * (rng.random(dim) < 0.7), np.array(bias)[:, None]], axis=1)
    sparse_heads.SparseHead.of(spark, weights, kind).save(str(tmp_path / "head"))
    head = sparse_heads.SparseHead.load(spark, str(tmp_path / "head"))
    df = spark.createDataFrame(TEXTS, "id long, text string").repartition(3)
    scorer = {r.id: r.s for r in df.select("id", head.scorer().column(F.col("text")).alias("s")).collect()}
    monkeypatch.setattr(sparse_heads, "MAX_SENT", sent)
    want = by_hand(weights.T, bias, dim)
    for r in head.predict(df, ["id"], "text").collect():
        assert np.allclose(r.logits, want[r.id])
        assert np.allclose(r.prob, fitting.probabilities(np.array([r.logits]), kind)[0])
        if r.id == 4:
            assert scorer[4] is None        # no prompt, no score
        else:
            assert np.allclose(scorer[r.id], r.prob)
        if kind == "multiclass":
            assert r.prediction == int(np.argmax(r.logits))
        else:
            assert r.hot == [int(p > 0.5) for p in r.prob]


def test_a_trained_sparse_head_scores_the_cascade(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("sentence_form"), (F.col("doc_id") % 2).cast("int").alias("y"))
    head, fits = sparse_heads.train_sparse_head(docs, "sentence_form", "y", n_classes=2, max_iter=15, reg=0.001)
    assert fits[0].loss < math.log(2)
    right = head.predict(docs, ["id"], "sentence_form").join(docs, "id").where("prediction = y").count()
    assert right > 0.9 * docs.count()
    stages = {s: sparse_heads.SparseHead(head.table.select("bucket", F.flatten(F.array_repeat("weights", 3)).alias("weights"))
                                         .withColumn("weights", F.slice("weights", 1, n)), [0.0] * n,
                                         kind="multiclass" if s == "sentiment" else "multilabel").scorer()
              for s, n in cascade.STAGE_LABELS.items()}
    out = cascade.cascade_predict(docs.select("id", "sentence_form"), stages)
    assert out.count() == docs.count() and out.where(F.size("annotation") > 0).count() == docs.count()


def test_cross_validation_by_hand(spark):
    rows = feature_rows(spark, n=120).select("id", "features", "y")
    out = training.cross_validate(rows, "y", ["id"], k=4, n_classes=3, max_iter=30, reg=0.01).orderBy("fold").collect()
    assert [r.fold for r in out] == [0, 1, 2, 3] and all(r.n_train + r.n_valid == 120 for r in out)
    folded, _ = training.fold_rows(rows, "y", ["id"], 4, 3, "features")
    data = folded.collect()
    for r in out:
        alone = fitting.problems_of([-1], 3, "multiclass")
        fit = fitting.fit_problems(folded.where(F.col("fold") != r.fold), alone, 6, "multiclass", 30, 0.01)[0]
        own = [d for d in data if d.fold == r.fold]
        p = fitting.probabilities(np.array([d.features for d in own]) @ fit.weights[:, :-1].T + fit.weights[:, -1], "multiclass")
        y = np.argmax([d.target for d in own], axis=1)
        assert r.accuracy == pytest.approx(np.mean(p.argmax(1) == y))
        assert r.loss == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean(), abs=1e-6)
        assert r.support == np.bincount(y, minlength=3).tolist()


def test_cross_validation_with_null_rows_and_equal_keys(spark):
    rows = feature_rows(spark, n=60).select("id", "features", "y")
    holes = rows.withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y"))).withColumn(
        "features", F.when(F.col("id") % 15 != 1, F.col("features")))
    out = training.cross_validate(holes, "y", ["id"], k=3, n_classes=3, max_iter=10).collect()
    assert sum(r.n_valid for r in out) == 60 and sum(sum(r.support) for r in out) == 54
    assert all(0 < r.loss < 3 for r in out)      # rows without scores have no loss
    with pytest.raises(ValueError, match="equal"):
        training.cross_validate(rows.unionByName(rows), "y", ["id"], k=3, n_classes=3)


def test_bce_leaves_null_rows_out(spark):
    rows = [([1, 0], [0.5, 0.5]), ([1, 0], None), (None, [0.5, 0.5]), ([1, 0], [0.5, None])]
    df = spark.createDataFrame(rows, "label array<int>, prob array<double>")
    assert metrics.bce_loss(df).first().bce == pytest.approx(math.log(2))
    assert metrics.bce_loss(df.limit(0)).first().bce is None


def test_cross_entropy_null_rows_and_unknown_classes(spark):
    one = math.log(math.exp(0.2) + math.exp(0.8)) - 0.2
    df = spark.createDataFrame([(0, [0.2, 0.8]), (None, [0.2, 0.8]), (0, None)], "y int, scores array<double>")
    assert metrics.cross_entropy_loss(df).first().ce == pytest.approx(one)
    for y in (7, -1):
        bad = spark.createDataFrame([(0, [0.2, 0.8]), (y, [0.2, 0.8])], "y int, scores array<double>")
        with pytest.raises(Exception, match="without a score"):
            metrics.cross_entropy_loss(bad).collect()


def test_a_model_is_loaded_once_per_worker_and_sees_like_lengths(spark, tmp_path):
    folder = str(tmp_path)

    def loader():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def model(prompts):
            assert [len(p) for p in prompts] == sorted(len(p) for p in prompts)
            return np.array([[float(len(p)), float(p[0] == "b")] for p in prompts])

        return model

    scorer = PandasScorer(2, loader)
    df = spark.createDataFrame([(i, "ab"[i % 2] * (1 + i * 7 % 40)) for i in range(200)] + [(999, None)], "id long, p string").repartition(12)
    for _ in range(3):
        for r in df.select("id", "p", scorer.column(F.col("p")).alias("s")).collect():
            assert r.s == (None if r.p is None else [float(len(r.p)), float(r.p[0] == "b")])
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) < 36


def test_members_by_path(spark, tmp_path):
    root = str(tmp_path / "members")
    for m in ("b", "a", "c"):
        rows = spark.createDataFrame([(f"{m}1", "s", [("x#y", "p")])], "id string, sentence_form string, annotation array<struct<aspect:string,polarity:string>>")
        io.write_predictions(rows, f"{root}/{m}")
    found = {(r.member, r.id) for r in io.read_members(spark, root).collect()}
    assert found == {(0, "a1"), (1, "b1"), (2, "c1")}
    with pytest.raises(Exception, match="unknown member"):
        io.read_members(spark, root, names=["a", "b"]).collect()


def test_cascade_counts_in_one_pass(spark):
    corpus = spark.createDataFrame([(i, None if i == 5 else f"sentence {i % 30}") for i in range(80)], "id long, sentence_form string")
    sent = cascade.distinct_sentences(corpus)
    assert sent.count() == 31
    f = cascade.stage_frames(sent, cascade.default_scorers())
    want = {r.stage: r.n for r in aggregates.stage_counts({
        "stage0": sent, "stage1": f["routing"].where(F.get("hot0", F.lit(cascade.HEAD)) == 1),
        "stage2": f["categories"], "stage3": f["aspects"]}).collect()}
    assert {r.stage: r.n for r in cascade.stage_totals(sent, cascade.default_scorers()).collect()} == want
    assert [r.n for r in cascade.stage_totals(sent.limit(0), cascade.default_scorers()).collect()] == [0] * 4


@pytest.mark.parametrize("prefix_len,bucket", [(None, 1 << 20), (1, 3), (2, 1)])
def test_samples_are_the_smallest_keys(spark, monkeypatch, prefix_len, bucket):
    monkeypatch.setattr(sampling, "MAX_BUCKET", bucket)
    rows = [(i, "abc"[min(2, i % 5)]) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k long, c string").repartition(4)
    order = lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k)
    for sizes in ({"a": 30, "b": 100, "c": 1}, {"c": 299}, {"a": 0, "b": 1}, {"a": 100}):
        out = sampling.sample_exact(df, "c", sizes, ["k"], seed=7, prefix_len=prefix_len).collect()
        want = [(k, c) for c, n in sizes.items() for k in sorted((k for k, d in rows if d == c), key=order)[:n]]
        assert sorted((r.k, r.c) for r in out) == sorted(want)
    with pytest.raises(ValueError, match="too small"):
        sampling.sample_exact(df, "c", {"a": 101, "z": 1}, ["k"])
    assert sampling.sample_exact(df, "c", {"a": 101, "z": 1}, ["k"], on_short="take_all").count() == 100


def test_token_buckets_agree_with_python(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    for r in df.select("text", sparse_heads.token_buckets("text").alias("b"), tokens("text").alias("t")).collect():
        if r.text is not None:
            assert r.b == sparse_heads._buckets_py(r.text, sparse_heads.WIDTH) and len(r.b) == len(r.t)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 32, 33, 1000, 1025])
def test_permuted_is_a_bijection(spark, n):
    df = spark.range(n)
    orders = [[r.p for r in df.select("id", sampling.permuted(F.col("id"), n, 7, e).alias("p")).orderBy("id").collect()] for e in (1, 2)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 32 or orders[0] != orders[1]


def test_later_batches_are_a_narrow_map(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(100)], "k string")
    ids = sampling.materialized(sampling.dense_ids(rows, ["k"]).drop("n_rows"))
    out = sampling.later_batches(ids, 100, 16, epoch=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    got = sorted((r.batch, r.slot) for r in out.collect())
    assert got == [(b, s) for b in range(6) for s in range(16)]
    assert sampling.later_batches(ids, 100, 16, epoch=3, drop_last=False).count() == 100
    sampling.write_batches(out, str(tmp_path / "batches"), 3)
    stored = spark.read.parquet(str(tmp_path / "batches")).select("*", F.input_file_name().alias("f")).collect()
    assert len(stored) == 96
    for name in {r.f for r in stored}:
        own = [(r.batch, r.slot) for r in stored if r.f == name]
        assert own == sorted(own)
    assert all(len({r.f for r in stored if r.batch == b}) == 1 for b in range(6))
