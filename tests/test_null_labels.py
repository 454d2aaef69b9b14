"""NULL, unknown and repeated labels have one rule at every size."""

import pytest
from pyspark.sql import functions as F

from aspectspark.operators import labels, metrics, sampling, tokens
from aspectspark.plans import jobs
from aspectspark.sources import corpus as io


@pytest.mark.parametrize("n", [7, 65, 200])
def test_multi_hot_ignores_null_codes(spark, n):
    df = spark.createDataFrame([(1, None), (2, 3), (2, None)], "id int, code int")
    got = {r.id: r.label for r in labels.multi_hot(df, ["id"], "code", n).collect()}
    assert got == {1: [0] * n, 2: [int(i == 3) for i in range(n)]}


def test_null_category_is_no_class(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, category int")
    got = {r.id: (r.coarse, r.fine) for r in labels.coarse_fine_split(df, ["id"]).collect()}
    assert got == {1: ([0, 0, 0], [0] * 5), 2: ([0, 0, 1], [0, 0, 0, 1, 0])}


@pytest.mark.parametrize("extra", [0, 2000])
def test_taxonomy_keeps_rows_and_columns(spark, extra):
    pairs = ["a#b", "a#b"] + [f"x#{i}" for i in range(extra)]
    df = spark.createDataFrame([(1, "a#b", "p"), (2, "z#z", "p"), (3, None, "p")], "id int, aspect string, c string")
    valid, invalid = labels.validate_taxonomy(df, pairs=pairs)
    assert valid.columns == invalid.columns == df.columns
    assert [r.id for r in valid.collect()] == [1]
    assert sorted(r.id for r in invalid.collect()) == [2, 3]
    assert [r.valid for r in labels.taxonomy_flag(df, pairs=pairs).orderBy("id").collect()] == [1, 0, 0]


def test_null_predictions_are_misses(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 1)], "y int, p int")
    r = metrics.accuracy(df).first()
    assert (r.n, r.n_correct) == (3, 1) and abs(r.accuracy - 1 / 3) < 1e-12
    v = spark.createDataFrame([([1, 0], [1, 0]), ([1, 0], None)], "label array<int>, hot array<int>")
    assert metrics.subset_accuracy(v).first().accuracy == 0.5


def test_codes_outside_the_classes_raise(spark):
    df = spark.createDataFrame([(5, 1), (0, 0)], "y int, p int")
    with pytest.raises(Exception, match="class code outside"):
        metrics.f1_per_class(df, "y", "p", 3).collect()
    with pytest.raises(Exception, match="class code outside"):
        metrics.prediction_distribution(df, "y", 3).collect()


def test_folds_keep_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id int, label string")
    folds = sampling.stratified_kfold(df, "label", ["id"], k=5)
    assert folds.count() == 20
    assert {r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {2}


def test_every_word_reaches_an_id(spark):
    words = [f"w{i}" for i in range(700)]
    df = spark.createDataFrame([(1, " ".join(words), "what is it"), (2, None, "what is it"), (3, "", "what is it")],
                               "id int, text string, question string")
    vocab = tokens.build_vocab(df, ["text"])
    ids = {r.token: r.id for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(4, 704))
    out = tokens.encode_tokens(df, "id", "question", "text", vocab, max_len=32).orderBy("id", "window").collect()
    got = [i for r in out if r.id == 1 for i in r.input_ids[5:] if i > 3]
    assert got == [ids[w] for w in words]
    assert all(len(r.input_ids) == 32 for r in out)
    assert [r.window for r in out if r.id in (2, 3)] == [0, 0]
    cut = tokens.encode_tokens(df, "id", "question", "text", vocab, max_len=32, truncate=True)
    assert cut.count() == 3


def test_invalid_annotations_are_set_apart(spark, tmp_path):
    ann = F.array(F.struct(F.lit("\uc81c\ud488 \uc804\uccb4#\ud488\uc9c8").alias("aspect"), F.lit("[null,0,0]").alias("span"),
                           F.lit("positive").alias("polarity")),
                  F.struct(F.lit("no#such").alias("aspect"), F.lit("[null,0,0]").alias("span"),
                           F.lit("positive").alias("polarity")))
    c = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("text").alias("sentence_form"), ann.alias("annotation"))
    io.write_corpus(c, str(tmp_path / "c"))
    valid, invalid = jobs._flat(spark, str(tmp_path / "c"), "quarantine")
    assert (valid.count(), invalid.count()) == (3, 3)
    assert {r.aspect for r in invalid.collect()} == {"no#such"}
