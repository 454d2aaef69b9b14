"""File-to-file jobs on corpus files written from the sf0.001 tables."""

import tempfile

from pyspark.sql import functions as F

from aspectspark import catalog
from aspectspark.plans import datasets, jobs
from aspectspark.sources import corpus as io
from aspectspark.sources import fixtures as fx
from aspectspark.plans.cascade import default_scorers
from tests.conftest import SF001


def _setup(spark):
    root = tempfile.mkdtemp(prefix="jobs-")
    io.write_corpus(fx.gold_corpus(spark, SF001), f"{root}/gold")
    io.write_legacy(fx.legacy_corpus(spark, SF001), f"{root}/legacy")
    p = fx.member_predictions(spark, SF001).withColumn(
        "member_file", F.concat(F.lit("test_result_"), F.col("member").cast("string")))
    ann = F.transform("annotation", lambda a: F.array(a["aspect"], a["polarity"]))
    (p.select("member_file", F.to_json(F.struct("id", "sentence_form", ann.alias("annotation")))
              .alias("value")).write.partitionBy("member_file").text(f"{root}/members"))
    return root


def test_jobs_end_to_end(spark):
    root = _setup(spark)
    paths = jobs.build_stage_sets(spark, f"{root}/gold", f"{root}/gold", f"{root}/legacy",
                               f"{root}/sets")
    assert len(paths) == 8
    three = io.read_stage_csv(spark, paths["0_category_3way_train"])
    want = catalog.q_build_category_sets(spark, SF001).filter("set = '3way'").count()
    assert three.count() == want
    sent = io.read_stage_csv(spark, paths["3_sentiment_train"], "int",
                             ("input", "entity", "label"))
    assert sorted(r.n for r in sent.groupBy("label").agg(F.count("*").alias("n")).collect()) \
        == sorted(catalog.W1_SIZES.values())

    jobs.vote_files(spark, f"{root}/members", f"{root}/gold", f"{root}/vote")
    got = {int(r.id): len(r.annotation) for r in io.read_predictions(spark, f"{root}/vote")
           .collect()}
    want = {r.id: r.n_annotations for r in catalog.q_vote_lookup(spark, SF001).collect()}
    assert got == want

    # member 0 against gold: the same counts as the registered metric job
    m0 = f"{root}/members/member_file=test_result_0"
    rep = jobs.evaluate_files(spark, f"{root}/gold", m0, ("exact", "sticky"))
    ref = {(r.result, r.mode): r for r in catalog.q_evaluation_report(spark, SF001).collect()}
    for r in rep:
        assert round(r["f1"], 6) == ref[(r["result"], r["mode"])].f1

    jobs.predict_file(spark, f"{root}/gold", f"{root}/pred", default_scorers())
    assert io.read_predictions(spark, f"{root}/pred").count() == \
        fx.table(spark, SF001, "orders").count()


def test_heads_from_files(spark):
    """Sets, a head per stage, cross-validation and inference by the heads."""
    root = _setup(spark)
    paths = jobs.build_stage_sets(spark, f"{root}/gold", f"{root}/gold", f"{root}/legacy", f"{root}/sets")
    files = {"trinary": "0_category_3way_train", "category": "1_category_5way_train",
             "topic": "2_topic_train", "sentiment": "3_sentiment_train"}
    for stage, name in files.items():
        fit = jobs.fit_stage(spark, paths[name], stage, f"{root}/heads/{stage}", dim=1 << 12, max_iter=5)
        assert fit["rows"] > 0 and 0 < fit["loss"] < 2 and 0 < fit["steps"] <= 5
    jobs.predict_file(spark, f"{root}/gold", f"{root}/pred", jobs.load_heads(spark, f"{root}/heads"))
    out = io.read_predictions(spark, f"{root}/pred")
    assert out.count() == fx.table(spark, SF001, "orders").count()
    assert out.filter(F.size("annotation") > 0).count() == out.count()
    folds = jobs.cross_validate_stage(spark, paths[files["sentiment"]], "sentiment", k=3, dim=1 << 10, max_iter=5)
    assert [f["fold"] for f in folds] == [0, 1, 2]
    assert sum(f["n_valid"] for f in folds) == sum(catalog.W1_SIZES.values()) and all(f["loss"] > 0 for f in folds)


def test_set_counts_equal_the_sets(spark):
    rows = [(1, "s", 0, 0, 1), (1, "s", 1, 5, 1), (1, "s", 2, 5, 2), (2, "s", 0, 1, None), (3, "t", 0, None, 1), (4, "u", 0, 6, None)]
    flat = spark.createDataFrame(rows, "id long, sentence_form string, pos int, category int, topic int").withColumn(
        "aspect", F.lit("a")).withColumn("pol", F.lit(0))
    three, five = datasets.build_category_sets(flat)
    want = {"category_3way": three.count(), "category_5way": five.count(), "topic": datasets.build_topic_set(flat).count(),
            "sentiment_dev": datasets.build_sentiment_dev(flat).count()}
    assert {r.stage: r.n for r in datasets.set_counts(flat).collect()} == want
    assert {r.n for r in datasets.set_counts(flat.limit(0)).collect()} == {0}
