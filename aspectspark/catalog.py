"""Registered jobs: one Spark callable per SURVEY operator, each over the
driver tables of one scale-factor directory.

Every callable returns flat columns (integers where possible, doubles
rounded to 6 places, vectors and lists as text) so the result can be
compared value by value with the independent SQL in
:mod:`aspectspark.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import (
    CATEGORIES, POLARITIES, TOPICS, join_aspect, name_of, split_aspect)
from aspectspark.functions.text import QUESTIONS, build_prompt
from aspectspark.functions.vectors import (
    argmax, hot_text, linear_head, segment_ids, sigmoid, threshold_decode,
    threshold_decode_or_top1)
from aspectspark.operators import (
    aggregates, joins, labels, metrics, sampling, tokens, unions, vote)
from aspectspark.plans import cascade, datasets, scorers, sparse_heads, training
from aspectspark.session import scratch_path
from aspectspark.sources import corpus as io
from aspectspark.sources import fixtures as fx

R = 6  # decimals kept for floating results


def ann_text(col="annotation", with_span=False):
    """Annotation list -> ``aspect/polarity;...`` text (order kept)."""
    if with_span:
        f = lambda a: F.concat_ws("/", a["aspect"], a["span"], a["polarity"])
    else:
        f = lambda a: F.concat_ws("/", a["aspect"], a["polarity"])
    return F.array_join(F.transform(col, f), ";")


def _encoded_gold(spark, sf):
    return fx.gold_annotations(spark, sf)


def _docs_corpus(spark, sf):
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("sentence_form"))


# ----------------------------------------------------------------- sources
def q_read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    io.write_corpus(fx.gold_corpus(spark, sf), path)
    c = io.read_corpus(spark, path, id_type="bigint")
    return c.select("id", "sentence_form", F.size("annotation").alias("n_annotations"),
                    ann_text(with_span=True).alias("annotation_text"))


def q_read_legacy_polarity(spark, sf):
    path = scratch_path(spark, "legacy")
    io.write_legacy(fx.legacy_corpus(spark, sf), path)
    return io.read_legacy_polarity(spark, path)


def q_write_stage_csv(spark, sf):
    three, _ = datasets.build_category_sets(_encoded_gold(spark, sf))
    path = scratch_path(spark, "stage-csv")
    io.write_stage_csv(three, path)
    raw = (spark.read.schema("id string, input string, label string")
                .option("header", True).option("multiLine", True)
                .option("escape", '"').csv(path))
    return raw.select(F.col("id").cast("bigint").alias("id"), "input", "label")


def q_read_stage_csv(spark, sf):
    # every document; one without labels has -1 in both slots
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left")
    s = d.select("doc_id", F.col("text").alias("input"),
                 F.array(*[F.coalesce(c, F.lit(-1)) for c in ("quality", "toxic")]).alias("label"))
    path = scratch_path(spark, "text-csv")
    io.write_stage_csv(s, path)
    r = io.read_stage_csv(spark, path, "array", ("doc_id", "input", "label"))
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.md5("input").alias("input_md5"),
                    F.length("input").alias("input_len"),
                    hot_text("label").alias("label_text"))


def q_write_predictions(spark, sf):
    # a file set per member, as the cascade writes them, all from one pass
    root = scratch_path(spark, "pred")
    io.write_predictions(fx.member_predictions(spark, sf), root, by="member", compression="gzip")
    out = io.read_predictions(spark, root, id_type="bigint", by="member")
    return out.select("member", "id", "sentence_form", F.size("annotation").alias("n_annotations"),
                      ann_text().alias("annotation_text"))


def q_read_members(spark, sf):
    p = fx.member_predictions(spark, sf).withColumn(
        "member_file", F.concat(F.lit("test_result_"), F.col("member").cast("string"),
                                F.lit(".jsonl")))
    root = scratch_path(spark, "members")
    ann = F.transform("annotation", lambda a: F.array(a["aspect"], a["polarity"]))
    (p.select("member_file", F.to_json(F.struct("id", "sentence_form", ann.alias("annotation")))
              .alias("value"))
      .write.partitionBy("member_file").text(root))
    r = io.read_members(spark, root, id_type="bigint")
    return r.select("member", "id", F.size("annotation").alias("n_annotations"),
                    ann_text().alias("annotation_text"))


# ------------------------------------------------------ projections, P1-P15
def q_explode_annotations(spark, sf):
    x = labels.explode_annotations(fx.gold_corpus(spark, sf))
    return x.select("id", "pos", "aspect", "span", "polarity")


def q_split_aspect(spark, sf):
    g = fx.gold_annotations(spark, sf)
    t, c = split_aspect("aspect", strict=True)
    return g.select("id", "pos", t.alias("topic_name"), c.alias("category_name"))


def q_encode_label(spark, sf):
    g = fx.gold_annotations(spark, sf).select("id", "pos", "aspect", "polarity")
    e = labels.encode_annotations(g, on_invalid="fail")
    return e.select("id", "pos", "topic", "category", "pol")


def q_decode_label(spark, sf):
    m = fx.member_annotations(spark, sf)
    return m.select("member", "id", "pos",
                    name_of("topic", TOPICS).alias("topic_name"),
                    name_of("category", CATEGORIES).alias("category_name"),
                    name_of("pol", POLARITIES).alias("polarity_name"))


def q_join_aspect(spark, sf):
    g = fx.gold_codes(spark, sf)
    return g.select(F.col("rec").alias("id"), "pos",
                    join_aspect(name_of("topic", TOPICS),
                                name_of("category", CATEGORIES)).alias("aspect"))


def q_multi_hot(spark, sf):
    m = labels.multi_hot(_encoded_gold(spark, sf), ["id"], "category", len(CATEGORIES))
    return m.select("id", hot_text("label").alias("label_text"))


def q_coarse_fine_split(spark, sf):
    c = labels.coarse_fine_split(_encoded_gold(spark, sf), ["id"])
    return c.select("id", hot_text("coarse").alias("coarse_text"),
                    hot_text("fine").alias("fine_text"))


def _doc_prompts(spark, sf):
    d = fx.table(spark, sf, "documents")
    cat = name_of((F.col("doc_id") % 7).cast("int"), CATEGORIES)
    asp = join_aspect(name_of((F.col("doc_id") % 4).cast("int"), TOPICS), cat)
    d = d.select("doc_id", "text", cat.alias("category"), asp.alias("aspect"))
    items = [F.struct(F.lit(s).alias("stage"), build_prompt(s, "text", e).alias("prompt"))
             for s, e in (("trinary", None), ("category", None), ("topic", "category"),
                          ("sentiment", "aspect"))]
    return d.select("doc_id", F.explode(F.array(*items)).alias("x")).select("doc_id", "x.*")


def q_build_prompt(spark, sf):
    p = _doc_prompts(spark, sf)
    return p.select("doc_id", "stage", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").alias("prompt_len"))


def _encoded_docs(spark, sf, max_len=128):
    d = fx.table(spark, sf, "documents").select(
        "doc_id", "text", F.lit(QUESTIONS["trinary"]).alias("question"))
    return tokens.encode_tokens(d, "doc_id", "question", "text",
                                tokens.build_vocab(d, ["text"]), max_len)


def q_encode_tokens(spark, sf):
    e = _encoded_docs(spark, sf)
    return e.select("doc_id", "window", hot_text("input_ids", " ").alias("ids_text"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
                    .alias("n_real"))


def q_encode_subwords(spark, sf):
    """Every word of every document in pieces; the piece table is derived
    from the words, as a pretrained one is not among the inputs."""
    d = fx.table(spark, sf, "documents").select(
        "doc_id", "text", F.lit(QUESTIONS["trinary"]).alias("question"))
    pieces = sampling.materialized(tokens.build_pieces(d, ["text"]))
    e = tokens.encode_subwords(d, "doc_id", "question", "text", pieces)
    return e.select("doc_id", "window", hot_text("input_ids", " ").alias("ids_text"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("n_real"))


def q_segment_ids(spark, sf):
    e = _encoded_docs(spark, sf)
    return e.select("doc_id", "window", hot_text(segment_ids("input_ids"), "").alias("segments"))


HEAD_OUT, HEAD_DIM = 10, 64
HEAD_W = [[float(((j * HEAD_DIM + k) % 7) - 3) for k in range(HEAD_DIM)]
          for j in range(HEAD_OUT)]


def _logits(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", linear_head("embedding", HEAD_W).alias("logits"))


def q_linear_head(spark, sf):
    x = _logits(spark, sf).select("vec_id", F.posexplode("logits").alias("j", "v"))
    return x.select("vec_id", "j", F.round("v", R).alias("logit"))


def q_sigmoid_scores(spark, sf):
    x = _logits(spark, sf).select("vec_id", F.posexplode(sigmoid("logits")).alias("j", "v"))
    return x.select("vec_id", "j", F.round("v", R).alias("prob"))


def q_threshold_decode(spark, sf):
    s = fx.score_vectors(spark, sf)
    return s.select("id", hot_text(threshold_decode("prob")).alias("hot_text"))


def q_threshold_decode_or_top1(spark, sf):
    s = fx.score_vectors(spark, sf)
    return s.select("id", hot_text(threshold_decode_or_top1("prob")).alias("hot_text"))


def q_argmax_decode(spark, sf):
    s = fx.single_label_rows(spark, sf)
    a = argmax("scores")
    return s.select("id", "pos", a.alias("pred"), name_of(a, POLARITIES).alias("pred_name"))


# ------------------------------------------------------------ filters F1-F4
def q_drop_all_zero(spark, sf):
    c = labels.coarse_fine_split(_encoded_gold(spark, sf), ["id"])
    f = labels.drop_all_zero(c.select("id", F.col("fine").alias("label")))
    return f.select("id", hot_text("label").alias("label_text"))


def q_recode_legacy(spark, sf):
    return labels.recode_legacy(fx.legacy_corpus(spark, sf))


def q_route_positive(spark, sf):
    s = fx.score_vectors(spark, sf).withColumn("hot", threshold_decode_or_top1("prob"))
    return labels.route_positive(s, "hot", keep=("id",)).select(
        "id", F.col("idx").cast("int").alias("idx"))


def q_validate_taxonomy(spark, sf):
    g = fx.gold_annotations(spark, sf).select("id", "pos", "aspect")
    return labels.taxonomy_flag(g)


# -------------------------------------------------------------- joins J1-J5
def _member0(spark, sf):
    return fx.member_annotations(spark, sf, [0]).drop("member")


def q_align_gold_pred(spark, sf):
    pred = fx.member_predictions(spark, sf)
    a = joins.align_gold_pred(fx.gold_corpus(spark, sf), pred, carry=("member",))
    return a.select("member", "id", F.size("gold_annotation").alias("n_gold"),
                    F.size("pred_annotation").alias("n_pred"))


def q_first_match_join(spark, sf):
    g = fx.gold_labels(spark, sf).select("id", "pos", "aspect", "polarity")
    p = fx.member_annotations(spark, sf).select("member", "id", "pos", "aspect", "polarity")
    # both are dealt by record
    j = joins.first_match(joins.expand_members(g, fx.N_MEMBERS), p, ["member", "id", "aspect"], by="id")
    # no match -> '' / -1, so the checked output has no NULL numbers
    return j.select("member", "id", "pos", "aspect",
                    F.coalesce("match_polarity", F.lit("")).alias("match_polarity"),
                    F.coalesce("match_pos", F.lit(-1)).alias("match_pos"))


def _by_sentence(spark, sf):
    m = fx.member_annotations(spark, sf)
    # the annotations stay dealt by record: they are not the side to broadcast
    return m.join(_keyed(fx.sentences(spark, sf)).hint("merge"), "id").select(
        "member", "sentence_key", "sentence_form", "id", "pos", "aspect", "polarity",
        "topic", "category", "pol")


def _keyed(sentences):
    # the md5 as 16 bytes
    return sentences.withColumn("sentence_key", F.unhex(F.md5("sentence_form")))


def _member_texts(annotation):
    """Folded codes of all members -> a list with each member's annotations as
    their number and text."""
    def texts(member):
        own = F.filter(annotation, lambda a: a["member"] == member)
        named = F.transform(own, lambda a: F.struct(
            join_aspect(name_of(F.floor(a["code"] / len(CATEGORIES)), TOPICS),
                        name_of(a["code"] % len(CATEGORIES), CATEGORIES)).alias("aspect"),
            name_of(a["pol"], POLARITIES).alias("polarity")))
        return F.struct(F.lit(member).alias("member"), F.size(own).alias("n"), ann_text(named).alias("text"))
    return F.array(*[texts(m) for m in range(fx.N_MEMBERS)])


def q_attach_predictions(spark, sf):
    """The fold is shuffled as codes, a row for each record, and the records once
    for all members: each takes its own annotations after the join.  They get their
    text before it, once for a sentence."""
    n = fx.table(spark, sf, "lineitem").count()
    named = F.col("topic").between(0, len(TOPICS) - 1) & F.col("category").between(0, len(CATEGORIES) - 1)
    x = _by_sentence(spark, sf).select(
        "sentence_key", "id", "pos", F.col("member").cast("tinyint").alias("member"),
        # an aspect without a name is one, whatever its codes
        F.when(named, F.col("topic") * len(CATEGORIES) + F.col("category")).cast("tinyint").alias("code"),
        F.col("pol").cast("tinyint").alias("pol"))
    folded = aggregates.fold_annotations(x, "sentence_key", ["id", "pos"], ("member", "code", "pol"),
                                         rows=n, within="id")
    texts = folded.select("sentence_key", _member_texts(F.col("annotation")).alias("annotation"))
    out = joins.attach_predictions(_keyed(fx.sentences(spark, sf)), texts)
    own = F.get(F.filter("annotation", lambda a: a["member"] == F.col("member")), 0)
    return (joins.expand_members(out, fx.N_MEMBERS).withColumn("_own", own)
            .select("member", "id", F.coalesce("_own.n", F.lit(0)).alias("n_annotations"),
                    F.coalesce("_own.text", F.lit("")).alias("annotation_text")))


def _hard_vote(spark, sf):
    m = fx.member_annotations(spark, sf)
    votes = vote.hard_vote(m)
    return joins.vote_lookup(fx.sentences(spark, sf), votes)


def q_vote_lookup(spark, sf):
    v = _hard_vote(spark, sf)
    return v.select("id", F.size("annotation").alias("n_annotations"))


def q_expand_members(spark, sf):
    e = joins.expand_members(fx.sentences(spark, sf), 5)
    return e.select("member", "id")


# ------------------------------------------------------- aggregations A1-A5
def q_distinct_categories(spark, sf):
    d = labels.distinct_categories(_encoded_gold(spark, sf))
    return d.select("id", hot_text("categories").alias("categories_text"))


def q_topics_per_category(spark, sf):
    t = labels.topics_per_category(_encoded_gold(spark, sf))
    return t.select("id", "category", hot_text("label").alias("topics_text"))


def q_fold_annotations(spark, sf):
    # the sentence itself is the key here: short texts, and no join back to them
    x = _by_sentence(spark, sf).drop("sentence_key")
    f = aggregates.fold_annotations(x, ["member", "sentence_form"], ["id", "pos"],
                                    rows=fx.table(spark, sf, "lineitem").count())
    return f.select(
        "member", "sentence_form", F.size("annotation").alias("n_annotations"),
        ann_text().alias("annotation_text"))


def q_stage_counts(spark, sf):
    return datasets.set_counts(_encoded_gold(spark, sf))


def q_label_distribution(spark, sf):
    d = labels.label_distribution(_encoded_gold(spark, sf), ["topic", "category"])
    # rollup levels: 0 = (topic, category), 1 = topic, 3 = total; -1 marks "all"
    return d.select(F.coalesce("topic", F.lit(-1)).alias("topic"),
                    F.coalesce("category", F.lit(-1)).alias("category"),
                    F.col("level").cast("int").alias("level"), "n", "share")


# ------------------------------------------------------------ metrics E1-E11
def _counts(spark, sf):
    g = fx.gold_labels(spark, sf).select("id", "pos", "aspect", "polarity")
    return metrics.set_match_counts(g, _member0(spark, sf))


def q_eval_set_match(spark, sf):
    return _counts(spark, sf).select("ce_tp", "ce_fn", "ce_fp", "pi_tp", "pi_fn", "pi_fp")


def q_eval_set_match_sticky(spark, sf):
    return _counts(spark, sf).select("ce_tp", "ce_fn", "ce_fp_sticky",
                                     "pi_tp", "pi_fn", "pi_fp_sticky")


def _rounded(df):
    return df.select(*[F.round(c, R).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def q_prf1(spark, sf):
    return _rounded(metrics.evaluation_report(_counts(spark, sf)).drop("mode"))


def q_accuracy(spark, sf):
    return _rounded(metrics.accuracy(fx.single_label_rows(spark, sf)))


def q_subset_accuracy(spark, sf):
    s = fx.score_vectors(spark, sf).withColumn("hot", threshold_decode("prob"))
    return _rounded(metrics.subset_accuracy(s))


def _per_class(spark, sf):
    """Multi-label: the 3-way gold bits against the thresholded scores."""
    s = fx.score_vectors(spark, sf).withColumn("hot", threshold_decode("prob"))
    return metrics.f1_per_class(s, label="label", hot="hot")


def q_f1_per_class(spark, sf):
    return _rounded(_per_class(spark, sf).select(
        F.col("cls").cast("int").alias("cls"), "tp", "fp", "fn", "f1"))


def q_f1_per_class_single(spark, sf):
    pc = metrics.f1_per_class(fx.single_label_rows(spark, sf), "y", "p", 3)
    return _rounded(pc.select(F.col("cls").cast("int").alias("cls"), "tp", "fp", "fn", "f1"))


def q_f1_macro(spark, sf):
    return _rounded(metrics.f1_macro(_per_class(spark, sf)))


def q_f1_micro(spark, sf):
    return _rounded(metrics.f1_micro(_per_class(spark, sf)))


def q_prediction_distribution(spark, sf):
    d = metrics.prediction_distribution(fx.single_label_rows(spark, sf), "p", 3)
    return _rounded(d.select(F.col("cls").cast("int").alias("cls"), "n", "pct"))


def q_bce_loss(spark, sf):
    return _rounded(metrics.bce_loss(fx.score_vectors(spark, sf)))


def q_cross_entropy_loss(spark, sf):
    return _rounded(metrics.cross_entropy_loss(fx.single_label_rows(spark, sf)))


# ------------------------------------------------- sampling, folds W1-W4
W1_SIZES = {0: 804, 1: 400, 2: 250}


def q_sample_exact(spark, sf):
    dev = datasets.build_sentiment_dev(_encoded_gold(spark, sf))
    s = sampling.sample_exact(dev, "label", W1_SIZES, ["id", "pos"], seed=42)
    return s.select("id", "pos", "label")


def _folds(spark, sf):
    three, _ = datasets.build_category_sets(_encoded_gold(spark, sf))
    t = three.select("id", hot_text("label").alias("label_text"))
    # the 3-way set is an aggregate: checkpoint it once, the rank reads it twice
    return sampling.stratified_kfold(t, "label_text", ["id"], k=5, seed=42, materialize=True)


def q_stratified_kfold(spark, sf):
    return _folds(spark, sf).select("id", "label_text", "fold")


def q_fold_split(spark, sf):
    return sampling.fold_tag(_folds(spark, sf), 0).select("id", "split")


def q_epoch_batches(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey")
    b = sampling.epoch_batches(o, ["o_orderkey"], 32, seed=42, epoch=0, drop_last=True)
    return b.select("o_orderkey", "batch", "slot")


def q_epoch_batches_all(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey")
    b = sampling.epoch_batches(o, ["o_orderkey"], 32, seed=42, epoch=0, drop_last=False)
    return b.select("o_orderkey", "batch", "slot")


def q_later_epoch_batches(spark, sf):
    """Epochs 1 and 2 over the ids of one ranking."""
    o = fx.table(spark, sf, "orders").select("o_orderkey")
    ids = sampling.materialized(sampling.dense_ids(o, ["o_orderkey"], seed=42).drop("n_rows"))
    n = ids.count()
    parts = [sampling.later_batches(ids, n, 32, e, seed=42).select(F.lit(e).alias("epoch"), "o_orderkey", "batch", "slot")
             for e in (1, 2)]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------- unions U1-U4
def q_sentiment_pools(spark, sf):
    return unions.sentiment_pools(fx.legacy_corpus(spark, sf), _encoded_gold(spark, sf))


def q_sentiment_pools_compat(spark, sf):
    return unions.sentiment_pools(fx.legacy_corpus(spark, sf), _encoded_gold(spark, sf),
                                  compat=True)


def _sentiment_train(spark, sf):
    return datasets.build_sentiment_train(fx.legacy_corpus(spark, sf),
                                          _encoded_gold(spark, sf))


def q_concat_splits(spark, sf):
    train = _sentiment_train(spark, sf).select("input", "entity", "label")
    dev = datasets.build_sentiment_dev(_encoded_gold(spark, sf)).select(
        "input", "entity", "label")
    return unions.concat_splits({"train": train, "dev": dev})


def q_merge_stage_outputs(spark, sf):
    sent = cascade.distinct_sentences(_docs_corpus(spark, sf))
    cats = cascade.stage_frames(sent, cascade.default_scorers())["categories"]
    m = unions.merge_stage_outputs(cats)        # tagged in the pass that scores them
    return m.select("sentence_key", "category", F.col("routed").cast("int").alias("routed"))


# ------------------------------------------------------------------ vote V1-V5
def q_vote_counts(spark, sf):
    t = vote.vote_tallies(fx.member_annotations(spark, sf), "id")
    return t.select("id", F.when(F.col("kind") == 0, "aspect").otherwise("polarity").alias("kind"),
                    "value", "n", vote.first_member("first").alias("first_member"),
                    vote.first_pos("first").alias("first_pos"))


def q_vote_aspects(spark, sf):
    a, _ = vote.vote_counts(fx.member_annotations(spark, sf))
    return vote.vote_aspects(a)


def q_vote_polarity(spark, sf):
    _, p = vote.vote_counts(fx.member_annotations(spark, sf))
    return vote.vote_polarity(p)


def q_hard_vote(spark, sf):
    v = _hard_vote(spark, sf)
    return v.select("id", F.size("annotation").alias("n_annotations"),
                    ann_text().alias("annotation_text"))


def q_annotation_histogram(spark, sf):
    return vote.annotation_histogram(_hard_vote(spark, sf))


# ------------------------------------------------------- composite C1-C7, M*
def q_build_category_sets(spark, sf):
    both = datasets.category_sets(_encoded_gold(spark, sf))
    return both.select("set", "id", "input", hot_text("label").alias("label_text"))


def q_build_topic_set(spark, sf):
    t = datasets.build_topic_set(_encoded_gold(spark, sf))
    return t.select("id", "input", "entity", hot_text("label").alias("label_text"))


def q_build_sentiment_train(spark, sf):
    return _sentiment_train(spark, sf).select("input", "entity", "label", "key")


def q_build_sentiment_dev(spark, sf):
    return datasets.build_sentiment_dev(_encoded_gold(spark, sf))


def q_cascade_predict(spark, sf):
    p = cascade.cascade_predict(_docs_corpus(spark, sf))
    return p.select("id", F.size("annotation").alias("n_annotations"),
                    ann_text().alias("annotation_text"))


def q_ensemble_predict(spark, sf):
    p = cascade.ensemble_predict(_docs_corpus(spark, sf), n_members=5)
    return p.select("id", F.size("annotation").alias("n_annotations"),
                    ann_text().alias("annotation_text"))


def _annotated(p):
    return p.select("id", F.size("annotation").alias("n_annotations"),
                    ann_text().alias("annotation_text"))


def q_cascade_predict_python(spark, sf):
    """The cascade with a Python model in every stage."""
    return _annotated(cascade.cascade_predict(_docs_corpus(spark, sf),
                                              cascade.named_scorers("md5_python")))


def q_ensemble_models(spark, sf):
    """Members with models of their own: Python ones and JVM ones."""
    members = {m: cascade.named_scorers("md5_python" if m % 2 else "md5", salt=m)
               for m in range(fx.N_MEMBERS)}
    return _annotated(cascade.ensemble_predict(_docs_corpus(spark, sf), members=members))


def q_cascade_stage_counts(spark, sf):
    """A4 of the inference stages: rows that enter each of them."""
    sent = cascade.distinct_sentences(_docs_corpus(spark, sf))
    return cascade.stage_totals(sent, cascade.default_scorers())


def q_evaluation_report(spark, sf):
    return _rounded(metrics.evaluation_report(_counts(spark, sf), ("exact", "sticky")))


def q_scorer(spark, sf):
    d = fx.table(spark, sf, "documents")
    sc = scorers.load_scorer("md5_python", 3)
    s = d.select("doc_id", sc.column(build_prompt("trinary", "text")).alias("s"))
    return s.select("doc_id", *[F.get("s", i).alias(f"s{i}") for i in range(3)])


def q_train_head(spark, sf):
    e = training.vector_features(fx.table(spark, sf, "embeddings"), "embedding")
    head = training.train_head(e, "label", "multiclass", max_iter=20)
    return head.predict(e).select("vec_id", "label", "prediction")


def q_head_predict(spark, sf):
    """A head with given weights, saved and loaded again."""
    path = scratch_path(spark, "head")
    training.LinearHead(HEAD_W).save(spark, path)
    head = training.LinearHead.load(spark, path)
    return head.predict(fx.table(spark, sf, "embeddings"), "embedding").select("vec_id", "prediction")


def _cross_validated(spark, sf):
    e = training.vector_features(fx.table(spark, sf, "embeddings"), "embedding")
    return training.cross_validate(e, "label", ["vec_id"], k=5, n_classes=10, max_iter=20)


def q_cross_validate(spark, sf):
    """The folds that were fitted and scored: sizes and support."""
    return _cross_validated(spark, sf).select("fold", "n_train", "n_valid",
                                              hot_text("support").alias("support_text"))


def _cross_validated_labels(spark, sf):
    """A multi-label stage on hashed tokens, at the width that heads have."""
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id")
    buckets = d.select("doc_id", "quality", "toxic", sparse_heads.token_buckets("text").alias("features"))
    return training.cross_validate(buckets, ["quality", "toxic"], ["doc_id"], k=5, max_iter=20, reg=0.01,
                                   dim=sparse_heads.WIDTH)


def q_cross_validate_multilabel(spark, sf):
    """A multi-label stage: sizes and support of the folds that were fitted."""
    return _cross_validated_labels(spark, sf).select("fold", "n_train", "n_valid",
                                                     hot_text("support").alias("support_text"))


def q_cross_validate_multilabel_metrics(spark, sf):
    return _cross_validated_labels(spark, sf).select("fold", "accuracy", "loss", "f1_macro", "f1_micro")


def q_cross_validate_metrics(spark, sf):
    return _cross_validated(spark, sf).select("fold", "accuracy", "loss", "f1_macro", "f1_micro")


SPARSE_OUT = 3


def sparse_weights(spark):
    """Given weights of a head at full width, eighths from -6 to 6."""
    b = F.col("bucket")
    return spark.range(sparse_heads.WIDTH).select(F.col("id").cast("int").alias("bucket")).select(
        "bucket", F.array(*[((b * (2 * j + 3) + j) % 13 - 6) / 8.0 for j in range(SPARSE_OUT)]).alias("weights"))


def q_head_predict_hashed(spark, sf):
    """A head of 2^18 buckets with given weights, saved and loaded again,
    over the tokens of whole texts."""
    path = scratch_path(spark, "sparse-head")
    sparse_heads.SparseHead(sparse_weights(spark), [0.5 * j for j in range(SPARSE_OUT)]).save(path)
    head = sparse_heads.SparseHead.load(spark, path)
    out = head.predict(fx.table(spark, sf, "documents"), ["doc_id"], "text")
    return out.select("doc_id", *[F.round(F.get("logits", F.lit(j)), R).alias(f"logit{j}") for j in range(SPARSE_OUT)], "prediction")


QUERIES = {
    # sources / sinks
    "cascade_predict_python": q_cascade_predict_python,
    "ensemble_models": q_ensemble_models,
    "cascade_stage_counts": q_cascade_stage_counts,
    "epoch_batches_all": q_epoch_batches_all,
    "head_predict": q_head_predict,
    "cross_validate_multilabel": q_cross_validate_multilabel,
    "cross_validate_metrics": q_cross_validate_metrics,
    "cross_validate_multilabel_metrics": q_cross_validate_multilabel_metrics,
    "head_predict_hashed": q_head_predict_hashed,
    "read_corpus": q_read_corpus,
    "read_legacy_polarity": q_read_legacy_polarity,
    "write_stage_csv": q_write_stage_csv,
    "read_stage_csv": q_read_stage_csv,
    "write_predictions": q_write_predictions,
    "read_members": q_read_members,
    # projections
    "explode_annotations": q_explode_annotations,
    "split_aspect": q_split_aspect,
    "encode_label": q_encode_label,
    "decode_label": q_decode_label,
    "join_aspect": q_join_aspect,
    "multi_hot": q_multi_hot,
    "coarse_fine_split": q_coarse_fine_split,
    "build_prompt": q_build_prompt,
    "encode_tokens": q_encode_tokens,
    "encode_subwords": q_encode_subwords,
    "segment_ids": q_segment_ids,
    "linear_head": q_linear_head,
    "sigmoid_scores": q_sigmoid_scores,
    "threshold_decode": q_threshold_decode,
    "threshold_decode_or_top1": q_threshold_decode_or_top1,
    "argmax_decode": q_argmax_decode,
    # filters
    "drop_all_zero": q_drop_all_zero,
    "recode_legacy": q_recode_legacy,
    "route_positive": q_route_positive,
    "validate_taxonomy": q_validate_taxonomy,
    # joins
    "align_gold_pred": q_align_gold_pred,
    "first_match_join": q_first_match_join,
    "attach_predictions": q_attach_predictions,
    "vote_lookup": q_vote_lookup,
    "expand_members": q_expand_members,
    # aggregations
    "distinct_categories": q_distinct_categories,
    "topics_per_category": q_topics_per_category,
    "fold_annotations": q_fold_annotations,
    "stage_counts": q_stage_counts,
    "label_distribution": q_label_distribution,
    # metrics
    "eval_set_match": q_eval_set_match,
    "eval_set_match_sticky": q_eval_set_match_sticky,
    "prf1": q_prf1,
    "accuracy": q_accuracy,
    "subset_accuracy": q_subset_accuracy,
    "f1_per_class": q_f1_per_class,
    "f1_per_class_single": q_f1_per_class_single,
    "f1_macro": q_f1_macro,
    "f1_micro": q_f1_micro,
    "prediction_distribution": q_prediction_distribution,
    "bce_loss": q_bce_loss,
    "cross_entropy_loss": q_cross_entropy_loss,
    # sampling / folds / batches
    "sample_exact": q_sample_exact,
    "stratified_kfold": q_stratified_kfold,
    "fold_split": q_fold_split,
    "epoch_batches": q_epoch_batches,
    "later_epoch_batches": q_later_epoch_batches,
    # unions
    "sentiment_pools": q_sentiment_pools,
    "sentiment_pools_compat": q_sentiment_pools_compat,
    "concat_splits": q_concat_splits,
    "merge_stage_outputs": q_merge_stage_outputs,
    # vote
    "vote_counts": q_vote_counts,
    "vote_aspects": q_vote_aspects,
    "vote_polarity": q_vote_polarity,
    "hard_vote": q_hard_vote,
    "annotation_histogram": q_annotation_histogram,
    # composite jobs and model surface
    "build_category_sets": q_build_category_sets,
    "build_topic_set": q_build_topic_set,
    "build_sentiment_train": q_build_sentiment_train,
    "build_sentiment_dev": q_build_sentiment_dev,
    "cascade_predict": q_cascade_predict,
    "ensemble_predict": q_ensemble_predict,
    "evaluation_report": q_evaluation_report,
    "scorer": q_scorer,
    "train_head": q_train_head,
    "cross_validate": q_cross_validate,
}
