"""License templates as published, with capitals and punctuation."""

import pytest

from aspectspark.llm.licenses import TEMPLATES, Template, scan_licenses, template_words


def test_templates_are_read_as_texts_are(spark):
    df = spark.createDataFrame([(1, "Sold under The Example-License, Version 7.")], "doc_id long, text string")
    out = scan_licenses(df, [Template("example", "The Example-License, Version 7.", True)]).collect()
    assert [(s.label, s["first"], s["last"]) for s in out[0].spans] == [("example", 2, 6)]


def test_short_templates_are_an_error(spark):
    df = spark.createDataFrame([(1, "GPL")], "doc_id long, text string")
    with pytest.raises(ValueError, match="3 words"):
        scan_licenses(df, [Template("gpl", "GPL v3")])


def test_built_in_templates_keep_their_words():
    assert all(template_words(t.text) == t.text.split() for t in TEMPLATES)
