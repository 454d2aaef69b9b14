"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.llm.collocations import collocations
from aspectspark.llm.common import table
from aspectspark.llm.hard_negatives import mine_hard_negatives
from aspectspark.llm.licenses import scan_licenses
from aspectspark.llm.lines import dedup_lines
from aspectspark.llm.mixing import mix
from aspectspark.llm.multi_index import nearest
from aspectspark.llm.pieces import encode_pieces
from aspectspark.llm.private import BASE_KINDS, find_private, span_string
from aspectspark.llm.quality import COUNTS, quality
from aspectspark.llm.sharding import shard_documents
from aspectspark.llm.simhash import hex_digits, near_duplicates
from aspectspark.llm.suffixes import find_repeats
from aspectspark.llm.url_filter import filter_urls

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A page is listed if over one in so many of its characters is such a symbol.
JUNK_SYMBOLS = "%$#*&|"
JUNK_SHARE = 50


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc.doc_id", *COUNTS, "base_failed", "kept")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded texts."""
    def digest(numbers: str):  # of the numbers joined by commas: the JSON list without its brackets
        text = F.to_json(numbers)
        return F.sha2(F.substring(text, F.lit(2), F.length(text) - 2), 256)

    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                          digest("ends").alias("ends_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_digests(encode_pieces(docs, piece_model(), round_trip=True))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "n_lines", "n_dropped",
                        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken",
                        F.array_min("positions").alias("position"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_string(base), 256).alias("base_sha256"),
                        span_string(F.col("spans")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["first"].cast("long"))

    def names(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    best = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
                        F.coalesce(best, F.lit(0.0)).alias("score"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("first.id").alias("component_id"))


def junk_urls(pages: DataFrame) -> DataFrame:
    """The list that op9 probes: the URLs of pages full of symbols."""
    plain = F.translate("html", JUNK_SYMBOLS, "")
    return pages.where((F.char_length("html") - F.char_length(plain)) * JUNK_SHARE > F.char_length("html")).select("url")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, junk_urls(pages), URL_RULES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_personal_data": op6_personal_data,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sharding": op12_sharding,
    "op13_collocations": op13_collocations,
}
