"""Four-stage routed inference (C5) and the ensemble.

Stage 0 (3-way): quality / general / other -> stage 1 (5-way) for "other";
stage 2: topics of every (sentence, category); stage 3: polarity of every
aspect.  Scoring is the expensive part, so sentences are de-duplicated once
(md5 key) and all four stages are narrow per-row steps: no shuffle between
stages.  Only the final fold (small rows, no text) and the join back to the
records shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import (
    CATEGORIES, HEAD, POLARITIES, TOPICS, join_aspect, name_of)
from aspectspark.functions.text import build_prompt
from aspectspark.functions.vectors import argmax, threshold_decode_or_top1
from aspectspark.operators.joins import attach_predictions, expand_members
from aspectspark.operators.sampling import materialized
from aspectspark.operators.vote import hard_vote
from aspectspark.plans.scorers import Md5Scorer, load_scorer

STAGE_LABELS = {"trinary": HEAD + 1, "category": len(CATEGORIES) - HEAD,
                "topic": len(TOPICS), "sentiment": len(POLARITIES)}


def default_scorers(member: str | None = None) -> dict:
    """The md5 stand-in model for every stage."""
    return {s: Md5Scorer(n, member=member) for s, n in STAGE_LABELS.items()}


def named_scorers(name: str, **kw) -> dict:
    """One registered scorer (:data:`scorers.SCORERS`) for every stage."""
    return {s: load_scorer(name, n, **kw) for s, n in STAGE_LABELS.items()}


def distinct_sentences(corpus: DataFrame, text: str = "sentence_form") -> DataFrame:
    """``sentence_key, text``: one row per distinct sentence (partial
    aggregate first, so repeated texts are merged map-side; the result stays
    dealt by the key, so the stages' fold needs no shuffle)."""
    return (corpus.select(F.md5(text).alias("sentence_key"), F.col(text).alias("text"))
                  .dropDuplicates(["sentence_key"]))


def stage_frames(sentences: DataFrame, scorers: dict, threshold: float = 0.5,
                 keys: tuple[str, ...] = ("sentence_key",),
                 observations: dict | None = None) -> dict[str, DataFrame]:
    """The cascade as a chain of narrow steps; returns every stage frame.

    ``observations`` (A4, opt-in): pass a dict to receive one
    ``Observation`` per stage input (``stage0`` .. ``stage3``); the row
    counts are gathered in the same pass that computes the predictions,
    readable after the action.  Use it in a session that does not later
    run Spark ML model transforms (or in ``spark.newSession()``): on Spark
    4.1.2, after an Observation has been used, ML transforms in the same
    session fail with "Task not serializable" (the session's observation
    manager).  No default code path creates observations.
    Frames:

    * ``routing``: keys, text, hot0 (3), hot1 (5 or NULL)
    * ``categories``: keys, text, category, routed (bool)
    * ``aspects``: keys, text, category, topic
    * ``sentiments``: keys, category, topic, aspect, polarity
    """
    k = list(keys)

    def obs(df, name, rows=None):
        if observations is None:
            return df
        o = observations.setdefault(name, Observation(name))
        return df.observe(o, (F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("n"))

    # a stage's scores are a column of their own: the decode step reads them
    # several times, and may do so inside a lambda, where no Python scorer runs
    sentences = obs(sentences, "stage0")
    s0 = (sentences.withColumn("_s0", scorers["trinary"].column(build_prompt("trinary", "text")))
                   .withColumn("hot0", threshold_decode_or_top1("_s0", threshold)).drop("_s0"))
    need1 = F.get("hot0", HEAD) == 1
    s0 = obs(s0, "stage1", F.when(F.get("hot0", HEAD) == 1, 1).otherwise(0))
    routing = (s0.withColumn("_s1", scorers["category"].column(build_prompt("category", "text"), need1))
                 .withColumn("hot1", threshold_decode_or_top1("_s1", threshold)).drop("_s1"))
    cats = routing.select(*k, "text", F.explode(_categories()).alias("category"))
    cats = obs(cats.withColumn("routed", F.col("category") >= HEAD), "stage2")

    cname = name_of("category", CATEGORIES)
    topics = cats.withColumn("_s2", scorers["topic"].column(build_prompt("topic", "text", cname)))
    hot2 = threshold_decode_or_top1("_s2", threshold)
    aspects = (topics.select(*k, "text", "category", F.posexplode(hot2).alias("topic", "_h"))
                     .filter(F.col("_h") == 1).drop("_h"))

    aspect = join_aspect(name_of("topic", TOPICS), cname)
    a = obs(aspects.withColumn("aspect", aspect), "stage3")
    scored = a.withColumn("_s3", scorers["sentiment"].column(build_prompt("sentiment", "text", "aspect")))
    sentiments = scored.select(*k, "category", "topic", "aspect",
                               name_of(argmax("_s3"), POLARITIES).alias("polarity"))
    return {"routing": routing, "categories": cats, "aspects": aspects,
            "sentiments": sentiments}


def stage_totals(sentences: DataFrame, scorers: dict, threshold: float = 0.5) -> DataFrame:
    """A4 of the cascade: ``stage, n``, the rows that enter each stage, from
    one pass over the sentences.  A sentence counts itself and its way to
    stage 1 with its first category; the topics of a category are counted,
    not exploded; polarities are not scored."""
    first = sentences.withColumn("_s0", scorers["trinary"].column(build_prompt("trinary", "text"))).withColumn(
        "hot0", threshold_decode_or_top1("_s0", threshold))
    to_fine = F.coalesce(F.get("hot0", HEAD) == 1, F.lit(False))
    second = first.withColumn("_s1", scorers["category"].column(build_prompt("category", "text"), to_fine)).withColumn(
        "hot1", threshold_decode_or_top1("_s1", threshold))
    cats = second.select("text", to_fine.alias("fine"), F.posexplode_outer(_categories()).alias("pos", "category"))
    cname = name_of("category", CATEGORIES)
    scored = cats.withColumn("_s2", scorers["topic"].column(build_prompt("topic", "text", cname)))
    topics = F.aggregate(threshold_decode_or_top1("_s2", threshold), F.lit(0), lambda n, x: n + x)
    once = F.coalesce(F.col("pos"), F.lit(0)) == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = scored.select(once.cast("int").alias("n0"), (once & F.col("fine")).cast("int").alias("n1"),
                         F.col("category").isNotNull().cast("int").alias("n2"), F.coalesce(topics, F.lit(0)).alias("n3")).agg(
        *[total(f"n{i}").alias(f"n{i}") for i in range(4)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f"stage{i}").alias("stage"), F.col(f"n{i}").alias("n"))
                                           for i in range(4)])).alias("x")).select("x.*")


def _categories():
    """Codes of the categories of ``hot0`` and ``hot1``: the direct ones of
    stage 0, then those of stage 1."""
    direct = F.filter(F.sequence(F.lit(0), F.lit(HEAD - 1)), lambda i: F.get("hot0", i) == 1)
    routed = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(len(CATEGORIES) - HEAD - 1)),
                 lambda i: F.coalesce(F.get("hot1", i), F.lit(0)) == 1),
        lambda i: i + HEAD)
    return F.concat(direct, routed)


def fold_by_sentence(sentiments: DataFrame, keys: tuple[str, ...] = ("sentence_key",)) -> DataFrame:
    """A3 for the cascade: per sentence the list of [aspect, polarity] in the
    reference's output order (category code, then topic code).  Each
    (sentence, category, topic) occurs once, so no de-dup is needed and
    the list is bounded by the 28 possible aspects."""
    item = F.struct((F.col("category") * len(TOPICS) + F.col("topic")).alias("_o"),
                    "aspect", "polarity")
    return sentiments.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(item)),
                    lambda x: F.struct(x["aspect"].alias("aspect"),
                                       x["polarity"].alias("polarity"))).alias("annotation"))


def cascade_predict(corpus: DataFrame, scorers: dict | None = None,
                    threshold: float = 0.5, text: str = "sentence_form",
                    observations: dict | None = None) -> DataFrame:
    """Corpus (id, sentence_form) -> D9 (id, sentence_form, annotation).
    Records with equal text share predictions; no prediction -> [].
    ``observations``: see :func:`stage_frames` (per-stage input counts)."""
    scorers = scorers or default_scorers()
    sent = distinct_sentences(corpus, text)
    preds = fold_by_sentence(stage_frames(sent, scorers, threshold,
                                          observations=observations)["sentiments"])
    c = corpus.select("id", text).withColumn("sentence_key", F.md5(text))
    return attach_predictions(c, preds, "sentence_key", text)


def ensemble_predict(corpus: DataFrame, n_members: int = 5, threshold: float = 0.5,
                     scorers: dict | None = None, vote_threshold: int = 2,
                     text: str = "sentence_form", members: dict[int, dict] | None = None) -> DataFrame:
    """The cascade once per member, then the hard vote.

    ``members``: member id -> its own four stage scorers, as separately
    trained models have.  Without it ``n_members`` members share ``scorers``,
    which tell them apart by the ``member`` column (default: the salted
    stand-in).  All members' predictions of a record are those of its
    sentence, so the vote runs per sentence and is attached to the records
    once."""
    keys = ("member", "sentence_key")
    if members is not None:
        if scorers is not None:
            raise ValueError("give either scorers or members")
        sent = materialized(distinct_sentences(corpus, text))   # each member reads it
        folded = None
        for m, own in sorted(members.items()):
            one = sent.withColumn("member", F.lit(m).cast("int"))
            part = fold_by_sentence(stage_frames(one, own, threshold, keys)["sentiments"], keys)
            folded = part if folded is None else folded.unionByName(part)
    else:
        sent = expand_members(distinct_sentences(corpus, text), n_members)
        own = scorers or default_scorers(member="member")
        folded = fold_by_sentence(stage_frames(sent, own, threshold, keys)["sentiments"], keys)
    flat = folded.select("member", "sentence_key",
                         F.posexplode("annotation").alias("pos", "a")).select(
        "member", "sentence_key", "pos", "a.aspect", "a.polarity")
    votes = hard_vote(flat, key="sentence_key", threshold=vote_threshold)
    c = corpus.select("id", text).withColumn("sentence_key", F.md5(text))
    return attach_predictions(c, votes, "sentence_key", text)
