"""Prompt templates (P8) and the whitespace tokenizer used by P9."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectspark.functions.taxonomy import split_aspect

# ---------------------------------------------------------------------------
# The question text of every stage, as the models were trained
# with them.  ``{entity}`` is a category name, ``{topic}``/``{category}`` the
# two halves of an aspect.  The input follows after SEP_TEXT.
# ---------------------------------------------------------------------------
SEP_TEXT = "[SEP]"
QUESTIONS = {
    "trinary": "다음 문장은 품질, 일반, 나머지 중에 뭐에 대한 거야?",
    "category": "다음 문장의 카테고리를 분류하면?",
    "topic": "{entity}에 대해 [제품 전체, 본품, 패키지/구성품, 브랜드] 중에 하나를 고르면?",
    "sentiment": "{topic}의 {category}에 대한 감성을 분류하면?",
}
# ---------------------------------------------------------------------------

# whitespace set shared with the SQL oracle (Java and RE2 read it alike)
TOKEN_SPLIT = "[ \\t\\n\\r\\f\\x0B]+"

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders of a template with columns."""
    parts, last = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > last:
            parts.append(F.lit(template[last:m.start()]))
        parts.append(fields[m.group(1)])
        last = m.end()
    if last < len(template):
        parts.append(F.lit(template[last:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def question(stage: str, entity: Column | str | None = None,
             templates: dict[str, str] = QUESTIONS) -> Column:
    """The stage question; ``entity`` is the category (topic stage) or the
    aspect (sentiment stage)."""
    ent = F.col(entity) if isinstance(entity, str) else entity
    fields = {}
    if stage == "topic":
        fields["entity"] = ent
    elif stage == "sentiment":
        t, c = split_aspect(ent, strict=False)
        fields["topic"], fields["category"] = t, c
    return render(templates[stage], fields)


def build_prompt(stage: str, text: Column | str, entity: Column | str | None = None,
                 templates: dict[str, str] = QUESTIONS) -> Column:
    """``question + [SEP] + input``."""
    txt = F.col(text) if isinstance(text, str) else text
    return F.concat(question(stage, entity, templates), F.lit(SEP_TEXT), txt)


def tokens(text: Column | str) -> Column:
    """Whitespace tokens of a text (empty strings removed)."""
    txt = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(txt, TOKEN_SPLIT, -1), lambda t: t != "")
