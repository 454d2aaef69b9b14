"""Plan properties that carry the scale design (checked on final AQE plans)."""

import re

import pytest

from aspectspark import catalog
from tests.conftest import SF001

QUERIES = catalog.QUERIES


def _nodes(node):
    """All physical nodes, looking inside AQE wrappers and query stages."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _nodes(node.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from _nodes(node.plan())
        return
    yield node
    kids = node.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def _final(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    unpartitioned = sum(1 for n in _nodes(plan)
                        if n.nodeName() == "Window" and n.partitionSpec().size() == 0)
    return plan.toString(), unpartitioned


@pytest.fixture(scope="module")
def finals(spark):
    return {n: _final(f(spark, SF001)) for n, f in QUERIES.items()
            if n not in ("train_head", "cross_validate", "cross_validate_metrics", "cross_validate_multilabel",
                         "cross_validate_multilabel_metrics")}


@pytest.fixture(scope="module")
def plans(finals):
    return {n: v[0] for n, v in finals.items()}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items()
           if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_in_model_scoring(plans):
    py = {n for n, p in plans.items()
          if re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", p)}
    assert py == {"scorer", "cascade_predict_python", "ensemble_models"}


def test_each_stage_is_scored_once(plans):
    # one Python node per stage, and one md5 per label for the JVM model
    # (the rest: the sentence key, on both sides of the last join, computed
    # or tested for NULL)
    assert len(re.findall(r"ArrowEvalPython", plans["cascade_predict_python"])) == 4
    assert len(re.findall(r"md5\(", plans["cascade_predict"])) <= 3 + 5 + 4 + 3 + 4


def test_sampling_ranks_in_buckets(plans):
    for n in ("sample_exact", "build_sentiment_train", "concat_splits"):
        assert re.search(r"row_number\(\) windowspecdefinition\(label[^,]*, _b", plans[n]), n


def test_hard_vote_is_one_shuffle(plans):
    p = plans["hard_vote"]
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_set_match_reads_each_side_once(plans):
    # one lineitem shuffle for gold and one for member 0, nothing else keyed
    p = plans["eval_set_match"]
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_unpartitioned_windows_only_over_small_tables(finals):
    # allowed: the totals of the two-level rank (one row per lead value) and
    # the rollup total (A5)
    allowed = {"label_distribution", "stratified_kfold", "fold_split", "epoch_batches",
               "epoch_batches_all", "encode_tokens", "encode_subwords", "segment_ids", "later_epoch_batches"}
    seen = {n for n, (_p, k) in finals.items() if k}
    assert seen and seen <= allowed, seen


def test_distinct_sentences_stay_dealt_by_their_key(plans):
    # the sentences, and the records that meet them; not the fold between
    assert len(re.findall(r"Exchange hashpartitioning", plans["cascade_predict"])) <= 2


def test_cascade_counts_and_categories_read_the_corpus_once(plans):
    for n in ("cascade_stage_counts", "merge_stage_outputs"):
        assert plans[n].count("FileScan parquet") == 1, n


def test_sampling_filters_before_it_shuffles(plans):
    # rows beyond the cut prefix leave before the exchange of the ranked rows
    p = plans["sample_exact"]
    assert re.search(r"Exchange hashpartitioning\(label[^\n]*\n(.*\n)*?[^\n]*Filter [^\n]*<=", p) and p.count("Window") >= 1


def test_hashed_head_shuffles_sums_only(plans):
    p = plans["head_predict_hashed"]
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and "SortMergeJoin" not in p
