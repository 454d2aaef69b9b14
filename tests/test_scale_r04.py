"""Shuffles that must not grow with the members or the annotations of a record."""

import random

import pytest
from pyspark.sql import functions as F

from aspectspark import catalog, session
from aspectspark.operators import aggregates, joins
from tests.test_scale_r03 import _lineitems


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("hashpartitioning(")[1] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]


@pytest.fixture
def unbroadcast(spark, monkeypatch):
    monkeypatch.setattr(session.task_count, "__defaults__", (100,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_predictions_are_not_shuffled_by_member(spark, tmp_path, unbroadcast):
    out = catalog.QUERIES["attach_predictions"](spark, _lineitems(tmp_path, spark, 2000))
    # line items and sentences by record, then a row of each record and the records by sentence
    assert sorted(x.split("#")[0] for x in _exchanges(out)) == ["id", "rec", "sentence_key", "sentence_key"]


def test_first_match_of_dealt_sides_shuffles_nothing_more(spark, tmp_path, unbroadcast):
    out = catalog.QUERIES["first_match_join"](spark, _lineitems(tmp_path, spark, 2000))
    assert [x.split("#")[0] for x in _exchanges(out)] == ["rec", "rec"]
    assert out.rdd.getNumPartitions() == 20


def test_predictions_of_records_with_odd_keys(spark, tmp_path):
    """Orders twice, without line items or without a sentence's fields; line
    items without a supplier (an aspect without a name) or with negative keys."""
    li = spark.createDataFrame(
        [(1, 0, 11, 3, 1.0, 1.0, "A"), (1, 1, 12, None, 2.0, 1.0, "R"), (1, 2, 13, None, 3.0, 1.0, "R"),
         (2, 0, 11, 3, 4.0, 1.0, "A"), (2, 1, -14, -3, None, 1.0, None), (2, 2, 7, 9, 10.0, None, "N"),
         (4, 0, 16, 5, 1.0, 1.0, "A"), (None, 0, 11, 3, 1.0, 1.0, "A"), (9, 0, 11, 3, 1.0, 1.0, "A")],
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_extendedprice double, l_returnflag string")
    orders = spark.createDataFrame(
        [(1, "1-URGENT", "O"), (1, "1-URGENT", "O"), (2, "1-URGENT", "O"), (3, "1-URGENT", "O"),
         (4, None, None), (5, "2-HIGH", "F"), (None, "1-URGENT", "O")],
        "o_orderkey bigint, o_orderpriority string, o_orderstatus string").withColumn("o_orderdate", F.to_date(F.lit("2020-01-02")))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    # by its plain steps: a fold of names for each member and sentence
    x = catalog._by_sentence(spark, sf)
    folded = aggregates.fold_annotations(x, ["member", "sentence_key"], ["id", "pos"])
    records = joins.expand_members(catalog.fx.sentences(spark, sf).withColumn(
        "sentence_key", F.unhex(F.md5("sentence_form"))), 5)
    want = joins.attach_predictions(records, folded, also=("member",)).select(
        "member", "id", F.size("annotation").alias("n_annotations"), catalog.ann_text().alias("annotation_text"))
    got = catalog.QUERIES["attach_predictions"](spark, sf)
    assert got.columns == want.columns and got.count() == 35
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("n", [None, 1 << 18])
def test_fold_within_records_is_the_plain_fold(spark, n):
    rnd = random.Random(5)
    pick = lambda *a: rnd.choice(a)
    rows = [(pick("s", "t", "u", None), pick(1, 2, 3, 4, None), pick(0, 1, 2, 3, 4, None), pick("a", "b", "c", None), pick(0, 1))
            for _ in range(400)] + [("v", None, None, None, None), ("w", 1, 0, "a", 1), ("w", 1, 0, "a", 0)]
    df = spark.createDataFrame(rows, "k string, id bigint, pos int, aspect string, pol int")
    args = ["k"], ["id", "pos"], ("aspect", "pol")
    plain = {r.k: r.annotation for r in aggregates.fold_annotations(df, *args).collect()}
    packed = {r.k: r.annotation for r in aggregates.fold_annotations(df, *args, rows=n, within="id").collect()}
    assert plain == packed and len(plain) == 6
    with pytest.raises(ValueError):
        aggregates.fold_annotations(df, "k", ["pos", "id"], within="id")


def test_first_match_by_a_dealt_key(spark):
    left = spark.createDataFrame([(m, i, p, a, "l") for m in (0, 1, None) for i in (1, 2, None) for p, a in enumerate(("a", "b", "b", None))],
                                 "member int, id int, pos int, aspect string, other string")
    rnd = random.Random(6)
    right = spark.createDataFrame([(rnd.choice((0, 1, None)), rnd.choice((1, 3, None)), p, rnd.choice(("a", "b", "c", None)), f"x{p}")
                                   for p in range(60)] + [(0, 1, 60, "b", None)],
                                  "member int, id int, pos int, aspect string, polarity string")
    keys = ["member", "id", "aspect"]
    plain, by = joins.first_match(left, right, keys), joins.first_match(left, right, keys, by="id")
    assert plain.columns == by.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, by.collect()))
    assert by.filter("match_pos is not null").count() > 0


def test_dealt_annotations_are_not_broadcast(spark, tmp_path):
    """Spark estimates them as small before they are derived."""
    sf = _lineitems(tmp_path, spark, 2000)
    for q in ("attach_predictions", "first_match_join"):
        plan = catalog.QUERIES[q](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [id" in plan and "BroadcastHashJoin [id" not in plan
