"""Properties on the sf0.001 driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aspectspark import catalog
from aspectspark.functions.taxonomy import seeded_md5
from aspectspark.operators import metrics, sampling, vote
from aspectspark.sources import fixtures as fx
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_folds_partition_rows_and_balance(spark):
    f = catalog._folds(spark, SF001)
    n = catalog.q_build_category_sets(spark, SF001).filter("set = '3way'").count()
    assert f.count() == n and f.select("id").distinct().count() == n
    sizes = f.groupBy("label_text", "fold").agg(F.count("*").alias("n")) \
        .groupBy("label_text").agg((F.max("n") - F.min("n")).alias("spread"))
    assert sizes.agg(F.max("spread")).first()[0] <= 1
    tot = f.groupBy("fold").count().agg((F.max("count") - F.min("count"))).first()[0]
    assert tot <= 1


def test_two_level_rank_equals_plain_rank(spark):
    o = fx.table(spark, SF001, "orders").select("o_orderkey") \
        .withColumn("k", seeded_md5(42, "o_orderkey"))
    r = sampling.ranked(o, "k", ["o_orderkey"], prefix_len=2)
    plain = o.withColumn("p", F.row_number().over(Window.orderBy("k", "o_orderkey")) - 1)
    j = r.join(plain, "o_orderkey")
    assert j.filter(F.col("rank") != F.col("p")).count() == 0
    assert j.count() == o.count()


def test_repartitioning_does_not_change_results(spark):
    m = fx.member_annotations(spark, SF001)
    a = vote.hard_vote(m)
    b = vote.hard_vote(m.repartition(7, "pos"))
    c = vote.hard_vote(m.repartition(1))
    assert _rows(a) == _rows(b) == _rows(c)
    g = fx.gold_labels(spark, SF001)
    p = m.filter("member = 0").drop("member")
    x = metrics.set_match_counts(g, p).first()
    y = metrics.set_match_counts(g.repartition(5), p.repartition(3, "aspect")).first()
    assert x == y


def test_counting_identities(spark):
    c = catalog._counts(spark, SF001).first()
    gold_rows = fx.gold_labels(spark, SF001).count()
    assert c.ce_tp + c.ce_fn == gold_rows == c.pi_tp + c.pi_fn
    assert c.ce_fp >= c.ce_fp_sticky and c.pi_fp >= c.pi_fp_sticky
    assert c.pi_tp <= c.ce_tp


def test_perfect_predictions_on_driver_data(spark):
    g = fx.gold_labels(spark, SF001)
    # gold without repeated aspects inside a record
    w = Window.partitionBy("id", "aspect").orderBy("pos")
    u = g.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    u = u.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1)
    rep = metrics.evaluation_report(metrics.set_match_counts(u, u), ("exact", "sticky")).collect()
    assert all(r.f1 == 1.0 for r in rep)


def test_epoch_batches_full_and_exact(spark):
    b = catalog.q_epoch_batches(spark, SF001)
    n = fx.table(spark, SF001, "orders").count()
    assert b.count() == (n // 32) * 32
    assert b.groupBy("batch").count().agg(F.min("count"), F.max("count")).first() == (32, 32)
