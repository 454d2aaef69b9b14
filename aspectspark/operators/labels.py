"""Label ETL operators: explode, encode, multi-hot, filters, taxonomy checks
(P1, P6, P7, F1-F4, A1, A2, A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import (
    ALLOWED_PAIRS, CATEGORIES, HEAD, LEGACY_POLARITIES, POLARITIES, TOPICS,
    code_of, split_aspect)


def explode_annotations(corpus: DataFrame, outer: bool = False,
                        keep: tuple[str, ...] = ("id", "sentence_form")) -> DataFrame:
    """One row per annotation with its 0-based list position ``pos``.

    ``outer=True`` keeps records without annotations (pos/aspect NULL).
    Works for gold (aspect, span, polarity) and prediction (aspect,
    polarity) structs alike.
    """
    fn = F.posexplode_outer if outer else F.posexplode
    x = corpus.select(*keep, fn("annotation").alias("pos", "a"))
    fields = corpus.schema["annotation"].dataType.elementType.fieldNames()
    return x.select(*keep, "pos", *[F.col("a")[f].alias(f) for f in fields])


def encode_annotations(flat: DataFrame, on_invalid: str = "fail") -> DataFrame:
    """P2 + P3 on exploded annotations: adds ``topic``, ``category``, ``pol``.

    ``on_invalid``: ``fail`` raises on an unknown name or malformed aspect
    (the reference's KeyError/ValueError); ``drop`` removes such rows;
    ``keep`` / ``quarantine`` leave NULL codes (split them off with
    :func:`quarantine`).
    """
    if on_invalid not in ("fail", "drop", "keep", "quarantine"):
        raise ValueError(f"on_invalid: {on_invalid!r}")
    strict = on_invalid == "fail"
    mode = "fail" if strict else "null"
    topic, category = split_aspect("aspect", strict=strict)
    if not strict:
        ok = F.size(F.split("aspect", "#", -1)) == 2
        topic, category = F.when(ok, topic), F.when(ok, category)
    out = flat.select(
        "*",
        code_of(topic, TOPICS, mode, "topic").alias("topic"),
        code_of(category, CATEGORIES, mode, "category").alias("category"),
        code_of("polarity", POLARITIES, mode, "polarity").alias("pol"))
    if on_invalid == "drop":
        out = out.filter(F.col("topic").isNotNull() & F.col("category").isNotNull()
                         & F.col("pol").isNotNull())
    return out


def quarantine(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``encode_annotations(..., on_invalid='keep')`` output into
    (valid, invalid) rows."""
    ok = (F.col("topic").isNotNull() & F.col("category").isNotNull()
          & F.col("pol").isNotNull())
    return encoded.filter(ok), encoded.filter(~ok)


def hot_columns(code, n: int, name: str) -> list:
    """Aggregate expressions for a 0/1 presence vector of width ``n``: the
    distinct codes (at most as many as the label space has) merge map-side,
    and slots are looked up in them.  NULL codes set no slot."""
    c = F.col(code) if isinstance(code, str) else code
    found = F.collect_set(c)
    return [F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda i: F.array_contains(found, i).cast("int")).alias(name)]


def multi_hot(df: DataFrame, keys: list[str], code: str, n: int,
              name: str = "label") -> DataFrame:
    """``groupBy(keys)`` -> 0/1 vector of the codes present.  Partial
    aggregation runs map-side, so a hot key never reaches one task whole.  A
    key with NULL codes alone gets zeros, whatever the width."""
    return df.groupBy(*keys).agg(*hot_columns(code, n, name))


def coarse_fine_split(df: DataFrame, keys: list[str], code: str = "category",
                      head: int = HEAD, n: int = len(CATEGORIES),
                      coarse: str = "coarse", fine: str = "fine") -> DataFrame:
    """Coarse vector (codes < head keep their slot, the rest share slot
    ``head``) and fine vector (code - head for the rest), in one aggregate.
    A NULL code (an invalid label) sets no slot of either."""
    c = F.col(code)
    coarse_code = F.when(c < head, c).when(c.isNotNull(), head)
    return df.groupBy(*keys).agg(
        *hot_columns(coarse_code, head + 1, coarse),
        *hot_columns(c - head, n - head, fine))


def drop_all_zero(df: DataFrame, label: str = "label") -> DataFrame:
    """keep rows whose multi-hot vector has a 1."""
    return df.filter(F.exists(label, lambda x: x == 1))


def recode_legacy(legacy: DataFrame) -> DataFrame:
    """legacy corpus -> (input, entity, label): positive answers are
    dropped, negative -> 1, anything else (also NULL) -> 2."""
    pos, neg = LEGACY_POLARITIES[0], LEGACY_POLARITIES[1]
    return (legacy.filter(~F.col("answer").eqNullSafe(pos))
                  .select(F.col("sentence").alias("input"),
                          F.col("aspect").alias("entity"),
                          F.when(F.col("answer").eqNullSafe(neg), 1).otherwise(2)
                          .alias("label")))


def route_positive(df: DataFrame, hot: str, names: list[str] | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """one row per positive slot of a 0/1 vector: ``idx`` (0-based) and
    optionally its ``name``."""
    x = df.select(*keep, F.posexplode(hot).alias("idx", "_v")).filter(F.col("_v") == 1)
    cols = [*keep, "idx"]
    if names is not None:
        x = x.withColumn("name", F.get(F.array(*[F.lit(v) for v in names]), F.col("idx")))
        cols.append("name")
    return x.select(*cols)


def _allowed(aspect: str, pairs: list[str]):
    """One rule for any list: the distinct pairs as an IN-set expression, so
    rows are neither multiplied nor moved (a repeated pair counts once)."""
    return F.coalesce(F.col(aspect).isin(sorted(set(pairs))), F.lit(False))


def taxonomy_flag(df: DataFrame, aspect: str = "aspect", pairs: list[str] = ALLOWED_PAIRS,
                  name: str = "valid") -> DataFrame:
    """F4 in one pass: adds ``valid`` (1/0; a NULL aspect is not valid)."""
    return df.withColumn(name, _allowed(aspect, pairs).cast("int"))


def validate_taxonomy(df: DataFrame, aspect: str = "aspect",
                      pairs: list[str] = ALLOWED_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows by the declared aspect list."""
    ok = _allowed(aspect, pairs)
    return df.filter(ok), df.filter(~ok)


def distinct_categories(flat: DataFrame, keys: tuple[str, ...] = ("id",),
                        code: str = "category") -> DataFrame:
    """A1: sorted distinct category codes per record."""
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_set(code)).alias("categories"))


def topics_per_category(flat: DataFrame, keys: tuple[str, ...] = ("id", "sentence_form"),
                        n_topics: int = len(TOPICS)) -> DataFrame:
    """A2: per (record, category) the multi-hot vector of its topics;
    repeated topics collapse."""
    return multi_hot(flat, [*keys, "category"], "topic", n_topics, "label")


def label_distribution(df: DataFrame, levels: list[str]) -> DataFrame:
    """A5: counts per class at every rollup level plus the total, with the
    share of the total.  The rollup result is tiny (one row per class), so
    the total is read from it with a window over that small frame."""
    gid = F.grouping_id(*levels)
    agg = df.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), gid.alias("level"))
    full = (1 << len(levels)) - 1
    total = F.max(F.when(F.col("level") == full, F.col("n"))).over(Window.partitionBy())
    return agg.withColumn("share", F.round(F.col("n") / total, 6))
