"""Steps whose cost per task, per driver or per row must not grow with the input."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aspectspark import catalog, session
from aspectspark.functions.vectors import hot_text, segment_ids
from aspectspark.operators import joins, tokens
from aspectspark.plans import fitting, scorers
from aspectspark.sources import corpus as io
from aspectspark.sources import fixtures as fx
from tests.conftest import SF001


def test_segment_ids_of_long_rows_and_edges(spark):
    rows = [([2, 5, 3, 6, 3, 0],), ([3, 3],), ([3, 1],), ([1, 3],), ([],), (None,), ([3, None, 3, 3],), ([None],)]
    got = [r.s for r in spark.createDataFrame(rows, "ids array<int>").select(segment_ids("ids").alias("s")).collect()]
    assert got == [[0, 0, 0, 1, 1, 0], [0, 1], [0, 0], [0, 0], [], None, [0, 1, 1, 0], [0]]
    # linear in the row: looking the separators up for each position took minutes
    ids = F.concat(F.array_repeat(F.lit(7), 20000), F.array(F.lit(3)), F.array_repeat(F.lit(7), 20000), F.array(F.lit(3)))
    began = time.time()
    text = spark.range(20).select(hot_text(segment_ids(ids), "").alias("s")).agg(F.min("s")).first()[0]
    assert text == "0" * 20001 + "1" * 20001 and time.time() - began < 60


def _lineitems(tmp_path, spark, n):
    li = spark.range(n).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (F.col("id") * 7 % 1000).alias("l_partkey"), (F.col("id") * 5 % 97).alias("l_suppkey"),
        (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"),
        F.element_at(F.array(F.lit("A"), F.lit("R"), F.lit("N")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(n // 4 + 3).select(
        F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"),
        F.to_date(F.lit("2020-01-02")).alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_a_task_takes_a_bounded_number_of_annotations(spark, tmp_path, monkeypatch):
    sf = _lineitems(tmp_path, spark, 4000)
    small = {f: sorted(map(str, f(spark, sf).collect())) for f in (fx.member_annotations, fx.member_predictions, fx.gold_corpus)}
    monkeypatch.setattr(session.task_count, "__defaults__", (100,))
    for f, rows in small.items():
        assert sorted(map(str, f(spark, sf).collect())) == rows
    # 40 tasks of 100 rows, which adaptive execution does not merge again
    assert fx.member_annotations(spark, sf).rdd.getNumPartitions() == 40


def test_votes_and_alignment_take_a_bounded_number_of_annotations(spark, tmp_path, monkeypatch):
    sf = _lineitems(tmp_path, spark, 4000)
    jobs = [catalog.QUERIES[q] for q in ("hard_vote", "vote_lookup", "vote_counts", "vote_aspects", "vote_polarity",
                                         "align_gold_pred", "decode_label", "attach_predictions", "fold_annotations")]
    small = [sorted(map(str, q(spark, sf).collect())) for q in jobs]
    monkeypatch.setattr(session.task_count, "__defaults__", (100,))
    for q, rows in zip(jobs, small):
        assert sorted(map(str, q(spark, sf).collect())) == rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over tables too large for it
    try:
        for q, rows in zip(jobs, small):
            out = q(spark, sf)
            assert sorted(map(str, out.collect())) == rows
            assert out.rdd.getNumPartitions() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_member_predictions_are_not_shuffled_by_member(spark):
    df = fx.member_predictions(spark, SF001)
    assert not [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines()
                if "Exchange hashpartitioning" in x and "member" in x]


def test_first_match_with_a_known_number_of_rows(spark):
    left = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (None, 0, "a")], "id int, pos int, aspect string")
    right = spark.createDataFrame([(1, 2, "a", "y"), (1, 1, "a", "x"), (2, 0, "b", "z"), (None, 0, "a", "n")],
                                  "id int, pos int, aspect string, polarity string")
    plain, sized = (sorted(map(str, joins.first_match(left, right, ["id", "aspect"], rows=n).collect())) for n in (None, 1 << 18))
    assert plain == sized and joins.first_match(left, right, ["id", "aspect"], rows=1 << 22).rdd.getNumPartitions() == 32


def test_predictions_of_all_members_in_one_job(spark, tmp_path):
    rows = [(m, i, f"s{i}", [("x#y", f"p{m}")] if i else []) for m in range(3) for i in range(4)] + [(1, None, None, [])]
    df = spark.createDataFrame(rows, "member int, id bigint, sentence_form string, annotation array<struct<aspect:string,polarity:string>>")
    io.write_predictions(df, f"{tmp_path}/p", by="member", compression="gzip")
    back = io.read_predictions(spark, f"{tmp_path}/p", id_type="bigint", by="member")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one = io.read_predictions(spark, f"{tmp_path}/p/member=2", id_type="bigint")
    assert one.count() == 4
    io.write_predictions(df.limit(0), f"{tmp_path}/none", by="member")
    assert io.read_predictions(spark, f"{tmp_path}/none", by="member").count() == 0


def test_gradients_are_packed_by_bits():
    g = np.zeros((2, 1001))
    g[0, 3], g[1, 1000] = 1.5, -2.0
    total = np.ones((2, 1001))
    columns, values = fitting._packed(g)
    fitting._add(total, columns, values)
    assert (total == g + 1).all() and len(columns) == 126 and len(values) == 2 * 2 * 8


def test_the_driver_gets_one_gradient_per_problem(spark, monkeypatch):
    rows = [([i % 5, i % 7], [i % 2], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "features array<int>, target array<int>, fold int").repartition(40)
    got = []
    frame = type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    fitting.fit_problems(df, fitting.problems_of([0, 1], 1, "multilabel"), 8, "multilabel", max_iter=2)
    assert got and all(len(g) <= 2 for g in got)


def test_frequent_words_are_not_shuffled_by_word(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("##b", 6), ("##a", 7)], "piece string, id int")
    docs = spark.createDataFrame([(i, "a ab", " ".join(["ab", "ba", "zz", "a" * (i % 9 + 1)] * (i + 1))) for i in range(30)]
                                 + [(99, None, None)], "id int, q string, t string")
    found = []
    for often, each in ((1 << 16, 1 << 20), (1, 50), (0, 50)):
        monkeypatch.setattr(tokens, "FREQUENT", often)
        monkeypatch.setattr(tokens, "TASK_WORDS", each)
        out = tokens.encode_subwords(docs, "id", "q", "t", vocab, 16)
        found.append(sorted(map(str, out.collect())))
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1] == found[2]


def test_a_scorer_holds_a_part_of_a_batch(monkeypatch):
    monkeypatch.setattr(scorers, "SCORE_BYTES", 10)
    seen = []

    def model(prompts):
        seen.append(sum(map(len, prompts)))
        return [[len(p), 0.5] for p in prompts]

    texts = ["가나다", None, "x" * 25, "", "ab", None, "abcdefgh"]
    got = scorers.score_batch(model, pa.array(texts), 2).to_pylist()
    assert got == [None if t is None else [float(len(t)), 0.5] for t in texts]
    assert len(seen) > 2 and seen == sorted(seen)
    assert scorers.score_batch(model, pa.array([None, None], pa.string()), 2).to_pylist() == [None, None]
    assert scorers.score_batch(model, pa.array([], pa.string()), 2).to_pylist() == []
