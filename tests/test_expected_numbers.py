"""Expected counts at sf0.01 (FIXTURES.md part C)."""

import pytest
from pyspark.sql import functions as F

from aspectspark import catalog
from tests.conftest import SF01

pytestmark = pytest.mark.slow


def test_set_match_counts(spark):
    c = catalog._counts(spark, SF01).first().asDict()
    assert (c["ce_tp"], c["ce_fn"]) == (45880, 14120)
    assert (c["pi_tp"], c["pi_fn"]) == (38068, 21932)
    assert (c["ce_fp"], c["pi_fp"]) == (3338, 10531)
    assert (c["ce_fp_sticky"], c["pi_fp_sticky"]) == (1066, 3291)


def test_vote_total(spark):
    v = catalog._hard_vote(spark, SF01)
    assert v.select(F.sum(F.size("annotation"))).first()[0] == 56216


def test_category_sets(spark):
    d = catalog.q_build_category_sets(spark, SF01)
    three = {r.label_text: r.n for r in d.filter("set = '3way'").groupBy("label_text")
             .agg(F.count("*").alias("n")).collect()}
    assert three == {"0,0,1": 4212, "0,1,0": 213, "0,1,1": 3473, "1,0,0": 250,
                     "1,0,1": 3517, "1,1,0": 175, "1,1,1": 2903}
    assert d.filter("set = '5way'").count() == 14105


def test_topic_and_sentiment_sets(spark):
    assert catalog.q_build_topic_set(spark, SF01).count() == 45708
    dev = {r.label: r.n for r in catalog.q_build_sentiment_dev(spark, SF01)
           .groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert dev == {0: 20028, 1: 20046, 2: 19926}


def test_taxonomy_and_recode(spark):
    assert catalog.q_validate_taxonomy(spark, SF01).filter("valid = 0").count() == 6399
    rec = {r.label: r.n for r in catalog.q_recode_legacy(spark, SF01)
           .groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert rec == {1: 2014, 2: 3988}


def test_sampling_and_folds(spark):
    s = {r.label: r.n for r in catalog.q_build_sentiment_train(spark, SF01)
         .groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert s == {0: 804, 1: 400, 2: 250}
    f = catalog.q_stratified_kfold(spark, SF01)
    assert f.select("fold", "label_text").distinct().count() == 35


def test_metrics(spark):
    pc = {r.cls: (r.tp, r.fp, r.fn) for r in catalog.q_f1_per_class(spark, SF01).collect()}
    assert pc == {0: (5683, 1323, 1162), 1: (5705, 1249, 1059), 2: (11793, 108, 2312)}
    sa = catalog.q_subset_accuracy(spark, SF01).first()
    assert (sa.n_exact, sa.n) == (8642, 14743)
    assert catalog.q_bce_loss(spark, SF01).first().bce == pytest.approx(0.386555, abs=1e-6)
