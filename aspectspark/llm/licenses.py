"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined with the positions of
the templates' k-grams; hits vote for their diagonal (text position less
template position); neighbouring diagonals of a template merge into a span;
and the spans' words are compared with the template's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectspark.llm.common import UPPER, bloom_filter, lower_ascii, materialize, might_contain, spread_keys, text_key

#: Words of a k-gram; no template is shorter.
K = 3

#: Diagonals of one template merge if they differ by at most so many words.
MAX_SHIFT = 4

#: A template labels a text from this share of its words on.
MIN_COVERAGE = 0.6


class Template(NamedTuple):
    label: str
    text: str
    #: Counts only where all its words stand consecutively.
    phrase: bool = False


#: Fixed phrases and license notices, as published.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except "
                         "in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
                    "gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international "
                         "license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("all-rights-reserved", "all rights reserved"),
)

#: What separates words, in lower-cased text: ASCII but 0-9 and a-z.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def template_words(text: str) -> list[str]:
    """A template's words, as :func:`license_words` has a text's."""
    lowered = text.translate(str.maketrans(UPPER, UPPER.lower()))
    words = [w for w in re.split(SEPARATORS, lowered) if w]
    if len(words) < K:
        raise ValueError(f"a template needs {K} words: {text!r}")
    return words


def _grams(words: Column) -> Column:
    """Hash of the k words from each position (none: no k-gram)."""
    starts = F.sequence(F.lit(0), F.size(words) - K)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[words[i + j] for j in range(K)]))
    return F.when(F.size(words) < K, F.array().cast("array<bigint>")).otherwise(hashes)


def template_positions(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """One row per template and k-gram: as many as the templates have words,
    whatever the documents, so it is broadcast."""
    rows = [(i, t.label, t.phrase, len(words := template_words(t.text)), words) for i, t in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, phrase boolean, size int, words array<string>")
    return frame.select("template", "label", "phrase", "size", "words",
                        F.posexplode(_grams(F.col("words"))).alias("tpos", "gram"))


def _verified(texts: DataFrame, votes: DataFrame, blocks: int | None) -> DataFrame:
    """The votes whose words are the template's, word for word.

    Only texts with votes are dealt out (by a Bloom filter of their keys),
    each with its own votes.
    """
    per_text = votes.groupBy("t1", "t2").agg(F.collect_list(F.struct("template", "label", "phrase", "size", "tpos", "pos",
                                                                     "expected")).alias("votes"))
    per_text = materialize(per_text, "license-votes")
    some = might_contain(texts, bloom_filter(per_text, "t1", blocks), F.col("t1"), "voted").where("voted")
    joined = spread_keys(some.groupBy("t1", "t2").agg(F.first("text").alias("text"))).join(per_text, ["t1", "t2"])
    words = joined.select("t1", "t2", "votes", license_words(F.col("text")).alias("w"))
    same = F.filter("votes", lambda v: F.forall(
        F.sequence(F.lit(0), F.lit(K - 1)), lambda j: F.col("w")[v["pos"] + j] == v["expected"][j]))
    return words.select("t1", "t2", F.explode(same).alias("v")).select("t1", "t2", "v.*").drop("expected")


def _spans(votes: DataFrame) -> DataFrame:
    """Merged diagonals: template, first and last word, and the share of the
    template's words that its k-grams cover."""
    of = ["t1", "t2", "template", "label", "phrase", "size"]
    diagonals = votes.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*of, "diagonal").agg(
        F.collect_set("tpos").alias("tpos"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*of).orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT)
    numbered = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "span", F.sum("apart").over(order))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("tpos")), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(K - 1)), lambda j: p + j))))
    merged = numbered.groupBy(*of, "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.size(covered).alias("covered"),
        F.size(F.array_distinct(F.flatten(F.collect_set("tpos")))).alias("grams"))
    return merged.withColumn("coverage", F.col("covered") / F.col("size")).drop("span", "covered").withColumn(
        "whole", F.col("grams") == F.col("size") - (K - 1))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id",
                  text_col: str = "text", min_coverage: float = MIN_COVERAGE, blocks: int | None = None) -> DataFrame:
    """``id_col``, n_words, spans (label, phrase, first and last word,
    coverage) of every row.

    A phrase gives a span at each place where its words stand consecutively;
    another template where merged diagonals cover ``min_coverage`` of its
    words.  A null or empty text has no words and no spans.  Work is done
    once for equal texts; ids may be null or repeated; other columns are not
    read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.select("id", "text", *text_key(F.col("text")))
    words = keyed.select("id", "t1", "t2", license_words(F.col("text")).alias("w"))
    grams = words.select("t1", "t2", F.posexplode(_grams(F.col("w"))).alias("pos", "gram"))
    places = template_positions(spark, templates).select(
        "template", "label", "phrase", "size", "tpos", "gram", F.slice("words", F.col("tpos") + 1, K).alias("expected"))
    votes = grams.join(F.broadcast(places), "gram").drop("gram").distinct()
    spans = _spans(_verified(keyed.select("t1", "t2", "text"), votes, blocks))
    kept = spans.where(F.when(F.col("phrase"), F.col("whole")).otherwise(F.col("coverage") >= min_coverage))
    found = kept.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct(
        "first", (F.col("last") + K - 1).alias("last"), "label", "phrase", "coverage"))).alias("spans"))
    counted = words.select("id", "t1", "t2", F.size("w").cast("long").alias("n_words"))
    return counted.join(spread_keys(found), ["t1", "t2"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
