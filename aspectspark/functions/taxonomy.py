"""Label taxonomy and the name <-> code column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the label names and code order of the
# annotated corpus format, otherwise codes and prompts would not line up.
#   topic codes 0..3, category codes 0..6, polarity codes 0..2
# ---------------------------------------------------------------------------
TOPICS = ["제품 전체", "본품", "패키지/구성품", "브랜드"]
CATEGORIES = ["품질", "일반", "편의성", "디자인", "인지도", "가격", "다양성"]
POLARITIES = ["positive", "negative", "neutral"]
# answers of the legacy polarity corpus: positive, negative, neutral
LEGACY_POLARITIES = ["긍정", "부정", "중립"]
# the 25 declared (topic#category) aspects
ALLOWED_PAIRS = [
    "제품 전체#품질", "제품 전체#편의성", "제품 전체#일반", "제품 전체#다양성",
    "제품 전체#인지도", "제품 전체#가격", "제품 전체#디자인",
    "본품#품질", "본품#편의성", "본품#일반", "본품#다양성", "본품#인지도",
    "본품#가격", "본품#디자인",
    "패키지/구성품#품질", "패키지/구성품#편의성", "패키지/구성품#일반",
    "패키지/구성품#다양성", "패키지/구성품#가격", "패키지/구성품#디자인",
    "브랜드#품질", "브랜드#일반", "브랜드#인지도", "브랜드#가격", "브랜드#디자인",
]
# ---------------------------------------------------------------------------

# stage-0 routing: category codes below HEAD keep their own slot, all other
# categories share the last slot and go on to the fine (5-way) stage.
HEAD = 2


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def name_of(code: Column | str, names: list[str]) -> Column:
    """Code -> name; NULL for a code outside the list."""
    code = F.col(code) if isinstance(code, str) else code
    return F.get(_lit_array(names), code.cast("int"))


def code_of(name: Column | str, names: list[str], on_invalid: str = "fail",
            what: str = "label") -> Column:
    """Name -> 0-based code.

    ``on_invalid``: ``"fail"`` raises on an unknown name (the reference's
    KeyError), ``"null"`` leaves NULL so the caller can drop or quarantine.
    """
    name = F.col(name) if isinstance(name, str) else name
    mapping = F.create_map(*[x for i, v in enumerate(names)
                             for x in (F.lit(v), F.lit(i))])
    code = F.try_element_at(mapping, name)
    if on_invalid == "fail":
        return F.when(code.isNull(),
                      F.raise_error(F.concat(F.lit(f"unknown {what}: "),
                                             F.coalesce(name, F.lit("NULL"))))
                      ).otherwise(code)
    if on_invalid == "null":
        return code
    raise ValueError(f"on_invalid must be 'fail' or 'null', got {on_invalid!r}")


def split_aspect(aspect: Column | str, strict: bool = True) -> tuple[Column, Column]:
    """``topic#category`` -> (topic, category).

    Strict mode needs exactly one ``#`` (the ETL's unpacking); lax mode takes
    parts 0 and 1 like the prompt builder does.
    """
    aspect = F.col(aspect) if isinstance(aspect, str) else aspect
    parts = F.split(aspect, "#", -1)
    topic, category = F.get(parts, 0), F.get(parts, 1)
    if strict:
        bad = F.size(parts) != 2
        err = F.raise_error(F.concat(F.lit("aspect needs one '#': "), aspect))
        topic = F.when(bad, err).otherwise(topic)
        category = F.when(bad, err).otherwise(category)
    return topic, category


def join_aspect(topic: Column | str, category: Column | str) -> Column:
    """P5: ``topic#category``."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    category = F.col(category) if isinstance(category, str) else category
    return F.concat(topic, F.lit("#"), category)


def seeded_md5(seed, *keys: Column | str) -> Column:
    """Deterministic pseudo-random order key ``md5('seed:k1:k2...')``.

    md5 instead of ``rand()``: the value depends only on the row, so it is
    stable under retries, repartitioning and lost executors.
    """
    cols = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *cols))


def hash6(text: Column) -> Column:
    """First 6 hex digits of md5 as an integer (0 .. 16**6-1)."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("bigint")
