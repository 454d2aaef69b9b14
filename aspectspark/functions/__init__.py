"""Column-level helpers: everything here returns a ``Column`` built from
Spark built-in functions, so it stays inside whole-stage codegen."""

from aspectspark.functions.taxonomy import (  # noqa: F401
    ALLOWED_PAIRS, CATEGORIES, LEGACY_POLARITIES, POLARITIES, TOPICS,
    code_of, hash6, join_aspect, name_of, seeded_md5, split_aspect,
)
from aspectspark.functions.vectors import (  # noqa: F401
    argmax, hot_text, linear_head, segment_ids, sigmoid,
    threshold_decode, threshold_decode_or_top1,
)
