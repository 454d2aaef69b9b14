"""Edge cases on hand-built frames."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import POLARITIES
from aspectspark.functions.vectors import (
    argmax, segment_ids, threshold_decode, threshold_decode_or_top1)
from aspectspark.operators import joins, labels, metrics, sampling, vote
from aspectspark.sources import corpus as io


def test_read_corpus_mixed_type_annotation(spark):
    d = tempfile.mkdtemp(prefix="corpus-")
    with open(os.path.join(d, "a.jsonl"), "w", encoding="utf-8") as f:
        f.write('{"id":"a1","sentence_form":"s one","annotation":[["본품#품질",["x",0,3],'
                '"positive"],["브랜드#가격",[null,0,0],"negative"]]}\n')
        f.write('{"id":"a2","sentence_form":"s two","annotation":[]}\n')
    c = io.read_corpus(spark, d)
    rows = {r.id: r for r in c.collect()}
    a = rows["a1"].annotation
    assert [x.aspect for x in a] == ["본품#품질", "브랜드#가격"]
    assert a[0].span == '["x",0,3]' and a[1].span == "[null,0,0]"
    assert [x.polarity for x in a] == ["positive", "negative"]
    assert rows["a2"].annotation == []
    # P1 outer keeps the empty record
    x = labels.explode_annotations(c, outer=True).collect()
    assert len(x) == 3 and any(r.id == "a2" and r.pos is None for r in x)
    # round trip keeps the raw span JSON
    out = tempfile.mkdtemp(prefix="corpus-out-")
    io.write_corpus(c, out + "/c")
    back = {r.id: r for r in io.read_corpus(spark, out + "/c").collect()}
    assert back["a1"].annotation == rows["a1"].annotation


def test_read_corpus_bad_line_fails(spark):
    d = tempfile.mkdtemp(prefix="corpus-bad-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"id":"a1","sentence_form":"x","annotation":[]}\n{not json\n')
    with pytest.raises(Exception):
        io.read_corpus(spark, d).collect()


def _scores(spark, rows):
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "k int, s array<double>")


def test_threshold_decodes(spark):
    df = _scores(spark, [[0.1, 0.4, 0.4], [0.5, 0.5, 0.2], [0.7, 0.2, 0.9], [0.3, 0.3, 0.3]])
    got = df.select("k", threshold_decode("s").alias("a"),
                    threshold_decode_or_top1("s").alias("b"), argmax("s").alias("m")) \
        .orderBy("k").collect()
    # strict '>' : exactly 0.5 does not pass
    assert [r.a for r in got] == [[0, 0, 0], [0, 0, 0], [1, 0, 1], [0, 0, 0]]
    # none passes -> first argmax slot (ties go to the first)
    assert [r.b for r in got] == [[0, 1, 0], [1, 0, 0], [1, 0, 1], [1, 0, 0]]
    assert [r.m for r in got] == [1, 0, 2, 0]


def test_segment_ids(spark):
    df = spark.createDataFrame([([2, 5, 3, 7, 8, 3, 0],), ([2, 5, 6, 3, 0, 0, 0],)],
                               "ids array<int>")
    got = [r.s for r in df.select(segment_ids("ids").alias("s")).collect()]
    assert got[0] == [0, 0, 0, 1, 1, 1, 0]
    assert got[1] == [0] * 7          # fewer than two SEPs -> all zeros


def test_unknown_labels(spark):
    df = spark.createDataFrame([(1, 0, "본품#품질", "positive"), (1, 1, "본품#맛", "positive"),
                                (2, 0, "본품", "neutral"), (3, 0, "브랜드#가격", "great")],
                               "id int, pos int, aspect string, polarity string")
    with pytest.raises(Exception):
        labels.encode_annotations(df, "fail").collect()
    kept = labels.encode_annotations(df, "drop").collect()
    assert [(r.id, r.topic, r.category, r.pol) for r in kept] == [(1, 1, 0, 0)]
    ok, bad = labels.quarantine(labels.encode_annotations(df, "quarantine"))
    assert ok.count() == 1 and bad.count() == 3


def _brute_set_match(gold, pred):
    """Plain-Python loop from the E1/E2 semantics: dict id -> list of
    (aspect, polarity) in order."""
    c = dict(ce_tp=0, ce_fn=0, ce_fp=0, ce_fp_sticky=0,
             pi_tp=0, pi_fn=0, pi_fp=0, pi_fp_sticky=0)
    for rid in set(gold) | set(pred):
        g, p = gold.get(rid, []), pred.get(rid, [])
        for ga, gp in g:
            first = next((pp for pa, pp in p if pa == ga), None)
            c["ce_tp" if first is not None else "ce_fn"] += 1
            c["pi_tp" if first == gp else "pi_fn"] += 1
        seen_ce = seen_pi = False
        for pa, pp in p:
            first = next((gp for ga, gp in g if ga == pa), None)
            hit_ce, hit_pi = first is not None, first == pp
            c["ce_fp"] += not hit_ce
            c["pi_fp"] += not hit_pi
            seen_ce, seen_pi = seen_ce or hit_ce, seen_pi or hit_pi
            c["ce_fp_sticky"] += not seen_ce
            c["pi_fp_sticky"] += not seen_pi
    return c


def _flat(spark, d):
    rows = [(k, i, a, p) for k, lst in d.items() for i, (a, p) in enumerate(lst)]
    return spark.createDataFrame(rows, "id int, pos int, aspect string, polarity string")


def test_set_match_against_brute_force(spark):
    gold = {1: [("A", "positive"), ("A", "negative"), ("B", "neutral")],
            2: [("C", "positive")],
            3: [("D", "negative"), ("E", "positive")],
            4: [("F", "neutral")]}
    pred = {1: [("A", "negative"), ("A", "positive"), ("X", "positive"), ("B", "neutral")],
            2: [("Y", "positive"), ("C", "negative"), ("Z", "neutral")],
            3: [("E", "positive"), ("Q", "negative")],
            5: [("G", "positive")]}
    got = metrics.set_match_counts(_flat(spark, gold), _flat(spark, pred)).first().asDict()
    assert got == _brute_set_match(gold, pred)
    assert got["ce_fp"] >= got["ce_fp_sticky"] and got["pi_fp"] >= got["pi_fp_sticky"]


def test_perfect_prediction_f1_is_one(spark):
    gold = {1: [("A", "positive"), ("B", "neutral")], 2: [("C", "negative")]}
    c = metrics.set_match_counts(_flat(spark, gold), _flat(spark, gold))
    rep = metrics.evaluation_report(c, ("exact", "sticky")).collect()
    assert all(r.precision == 1.0 and r.recall == 1.0 and r.f1 == 1.0 for r in rep)


def test_report_zero_division(spark):
    c = spark.createDataFrame([(0,) * 8], metrics.COUNT_COLS)
    r = metrics.evaluation_report(c).collect()
    assert r[0].precision is None and r[0].f1 is None
    r = metrics.evaluation_report(c, zero_division=0).collect()
    assert r[0].precision == 0.0


def _members(spark, rows):
    return spark.createDataFrame(rows, "member int, id int, pos int, aspect string, "
                                       "polarity string")


def test_vote_threshold_and_ties(spark):
    rows = [
        # id 1: A voted 3x, B 1x -> keep A only; polarity tie 2:2 -> first seen
        (0, 1, 0, "A", "negative"), (0, 1, 1, "B", "positive"),
        (1, 1, 0, "A", "positive"), (2, 1, 0, "A", "negative"),
        # id 2: every aspect once (max = 1) -> keep all, in first-seen order
        (0, 2, 0, "Z", "neutral"), (1, 2, 0, "Y", "neutral"), (1, 2, 1, "X", "positive"),
    ]
    v = {r.id: [(a.aspect, a.polarity) for a in r.annotation]
         for r in vote.hard_vote(_members(spark, rows)).collect()}
    assert v[1] == [("A", "negative")]
    assert v[2] == [("Z", "neutral"), ("Y", "neutral"), ("X", "neutral")]


def test_vote_lookup_missing(spark):
    corpus = spark.createDataFrame([(1, "s"), (9, "t")], "id int, sentence_form string")
    votes = vote.hard_vote(_members(spark, [(0, 1, 0, "A", "positive")]))
    got = {r.id: r.annotation for r in joins.vote_lookup(corpus, votes).collect()}
    assert got[9] == [] and len(got[1]) == 1
    with pytest.raises(Exception):
        joins.vote_lookup(corpus, votes, on_missing="fail").collect()


def test_duplicate_sentence_shares_predictions(spark):
    corpus = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")],
                                   "id int, sentence_form string")
    preds = spark.createDataFrame(
        [("same", [("A", "positive")])],
        "sentence_form string, annotation array<struct<aspect:string,polarity:string>>") \
        .withColumn("sentence_key", F.md5("sentence_form"))
    got = {r.id: r.annotation for r in joins.attach_predictions(corpus, preds).collect()}
    assert got[1] == got[2] and len(got[1]) == 1 and got[3] == []


def test_sample_exact_short_pool(spark):
    df = spark.range(10).select(F.col("id").alias("k"), (F.col("id") % 2).alias("c"))
    s = sampling.sample_exact(df, "c", {0: 3, 1: 2}, ["k"], seed=7)
    assert sorted((r.c, r.n) for r in s.groupBy("c").agg(F.count("*").alias("n")).collect()) \
        == [(0, 3), (1, 2)]
    with pytest.raises(Exception):
        sampling.sample_exact(df, "c", {0: 6, 1: 2}, ["k"]).collect()
    t = sampling.sample_exact(df, "c", {0: 6, 1: 2}, ["k"], on_short="take_all")
    assert t.count() == 7


def test_stage_csv_round_trip_with_quotes_and_newlines(spark):
    rows = [(1, 'a, "quoted"\nsecond line', [1, 0, 1]), (2, "  lead and trail  ", [0, 1, 0]),
            (3, "tab\there\r\nwindows", [0, 0, 1])]
    df = spark.createDataFrame(rows, "k int, input string, label array<int>")
    p = tempfile.mkdtemp(prefix="csv-") + "/s"
    io.write_stage_csv(df, p)
    back = io.read_stage_csv(spark, p, "array", ("k", "input", "label"))
    got = sorted((int(r.k), r.input, r.label) for r in back.collect())
    assert got == sorted(rows)


def test_recode_legacy(spark):
    df = spark.createDataFrame([("s1", "A#B", "긍정"), ("s2", "A#B", "부정"),
                                ("s3", "A#B", "중립"), ("s4", "A#B", None)],
                               "sentence string, aspect string, answer string")
    got = sorted((r.input, r.label) for r in labels.recode_legacy(df).collect())
    assert got == [("s2", 1), ("s3", 2), ("s4", 2)]


def test_sentiment_pools_compat(spark):
    from aspectspark.operators.unions import sentiment_pools
    legacy = spark.createDataFrame([], "sentence string, aspect string, answer string")
    flat = spark.createDataFrame([(1, 0, "s", "A#B", 0), (1, 1, "s", "A#C", 1)],
                                 "id int, pos int, sentence_form string, aspect string, pol int")
    exact = sorted(r.label for r in sentiment_pools(legacy, flat).collect())
    compat = sorted(r.label for r in sentiment_pools(legacy, flat, compat=True).collect())
    assert exact == [0, 1] and compat == [0, 1, 2]


def test_write_predictions_format(spark):
    df = spark.createDataFrame(
        [("x1", "문장", [("본품#품질", "positive")])],
        "id string, sentence_form string, annotation array<struct<aspect:string,polarity:string>>")
    p = tempfile.mkdtemp(prefix="pred-") + "/p"
    io.write_predictions(df, p)
    lines = [r.value for r in spark.read.text(p).collect()]
    assert json.loads(lines[0]) == {"id": "x1", "sentence_form": "문장",
                                    "annotation": [["본품#품질", "positive"]]}
    assert "문장" in lines[0]                     # UTF-8, not escaped
    assert POLARITIES[0] == "positive"


def test_sample_exact_large_uses_exact_smallest_keys(spark):
    import hashlib
    df = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    sizes = {0: 1500, 1: 1200}          # above the window-group-limit threshold
    got = sorted((r.c, r.k) for r in sampling.sample_exact(df, "c", sizes, ["k"], seed=5)
                 .collect())
    want = []
    for c, n in sizes.items():
        ks = sorted(range(c, 6000, 3), key=lambda k: (hashlib.md5(f"5:{k}".encode())
                                                       .hexdigest(), k))[:n]
        want += [(c, k) for k in ks]
    assert got == sorted(want)
    with pytest.raises(Exception):
        sampling.sample_exact(df, "c", {0: 2500, 2: 1500}, ["k"]).collect()
