"""The operators against plain Python on tables with nulls, empty and long
texts, ties, repeated rows, columns of clashing names, and no rows at all."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectspark.llm import lines, multi_index, quality, queries, simhash, suffixes
from aspectspark.llm.licenses import scan_licenses
from aspectspark.llm.mixing import mix, mixed_documents, shares
from aspectspark.llm import pieces
from aspectspark.llm.pieces import PieceEncoder, Normalizer, decode_pieces, encode_pieces
from aspectspark.llm.private import BASE_KINDS, find_private, private_spans
from aspectspark.llm.url_filter import filter_urls
from tests.llm import brute

RNG = random.Random(5)
WORDS = ["the", "of", "Licht", "über", "niño", "a@b.example", "10.0.0.1", "4111111111111111", "+49 30 1234567", "und", "日本", "x"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", str(rng.randint(0, 9))]) for _ in range(n))


PASSAGE = prose(70, 1)
NEAR = prose(300, 2)
TEXTS = [
    (1, prose(50, 3)), (2, NEAR), (3, NEAR + " end"), (3, NEAR + " end"), (4, NEAR), (None, NEAR), (5, None), (6, ""),
    (7, " \n\t \n"), (8, prose(30_000, 4)), (9, "one two"), (10, "ab " * 400), (11, prose(40, 5) + "\n" + PASSAGE),
    (12, PASSAGE + "\n" + prose(40, 6)), (13, PASSAGE + "\n" + prose(40, 7)), (14, "z" * 450),
    (15, "Seen 12 times today by bob\nReleased under the MIT License.\nCC BY-NC 4.0"),
    (16, "Seen 99 times today by bob\nLicensed under the Apache License, Version 2.0."),
    (17, "Seen 7 times today by bob\n" + prose(20, 8)), (None, "Seen 7 times today by bob"), (18, "\x00 \x0b\x0c\r x"),
    (19, "Permission is hereby granted, free of charge, to any person obtaining a copy of the present software and "
         "associated documentation files (the Software), to deal in the Software without restriction."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 9 else f"s{(i or 0) % 3}", len(t or ""), "t1", 7, "doc", -1, "x") for i, t in TEXTS]
    # the last columns bear names that the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "t1 string, id int, doc string, n int, words string").repartition(3)


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def expected(of):
    return sorted(((i, *of(t)) for i, t in TEXTS), key=repr)


def test_quality(docs):
    out = quality.quality(docs).select("doc.doc_id", *quality.COUNTS, "base_failed", "kept")
    base = ("doc_id", *quality.COUNTS, "base_failed")
    assert rows_of(out, *base) == expected(brute.quality_base)
    kept = {r.doc_id for r in out.collect() if r.kept}
    assert {5, 6, 7, 9, 10, 14}.isdisjoint(kept)
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_quality_rules_are_a_table(spark):
    clean = " ".join(f"the word{i} of this and" for i in range(30))
    junk = " ".join(f"###{i} $$$" for i in range(60))
    df = spark.createDataFrame([(1, clean), (2, junk), (3, clean.upper())], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [1]
    assert quality.keep_good(df, rules=()).count() == 3


def test_pieces_equal_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = encode_pieces(docs, queries.piece_model(), round_trip=True)
    found = rows_of(out, "doc_id", "ids", "decoded")
    want = sorted(((i, ids := library.encode(t or ""), library.decode(ids)) for i, t in TEXTS), key=repr)
    assert found == want
    for r in out.collect():
        assert len(r.ids) == len(r.begins) == len(r.ends)
    again = decode_pieces(out, queries.piece_model())
    assert rows_of(again, "doc_id", "decoded") == sorted(((i, d) for i, _, d in want), key=repr)
    assert encode_pieces(docs.limit(0), queries.piece_model()).count() == 0


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("suffix", [True, False])
def test_piece_spans_through_character_maps(rule, trim, suffix):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(queries.piece_model(), "rb") as file:
        proto.ParseFromString(file.read())
    if rule:
        source = pb.ModelProto()
        source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = source.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = trim
    proto.trainer_spec.treat_whitespace_as_suffix = suffix
    encoder = PieceEncoder(proto.SerializeToString())
    rng = random.Random(9)
    letters = "ab ▁é日\U0001F600ﬁＡ　\xa0\n\x00ｶﾞ①  "
    texts = ["", " ", "▁", "  a  b ", "▁x ▁", "ﷺ x"] + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(200)]
    for text in texts:
        ids, begins, ends = encoder.encode(text)
        pieces = encoder.library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in pieces], text
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in pieces], text


def test_a_text_is_segmented_by_stretches(monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(queries.piece_model(), "rb") as file:
        model = file.read()
    encoder, seen = PieceEncoder(model), []
    rng = random.Random(5)
    texts = ["", " ", "a" * 50, " " * 50] + ["".join(rng.choices("abthe  ▁é日\U0001F600\n\x00", k=rng.randint(1, 80))) for _ in range(500)]
    for stretch in (1, 7, 30):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        assert all(encoder.encode(t)[0].tolist() == encoder.library.encode(t) for t in texts)
    plain = encoder.plain
    encoder.plain = type("Seen", (), {"encode": lambda self, t: seen.append(len(t)) or plain.encode(t)})()
    encoder.encode("some words " * 1000)
    assert max(seen) < 50
    proto = pb.ModelProto()  # a piece that spans a blank: the text stays whole
    proto.ParseFromString(model)
    proto.pieces[-1].piece = "e▁t"
    encoder = PieceEncoder(proto.SerializeToString())
    assert not encoder.separable and all(encoder.encode(t)[0].tolist() == encoder.library.encode(t) for t in texts)


def test_normalizer_offsets_point_into_the_text():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    normal, source = Normalizer(proto.normalizer_spec, False)("ﬁx")
    assert len(source) == len(normal.encode()) + 1 and source[-1] == 4 and list(source) == sorted(source)


def test_lines(docs):
    want = brute.line_dedup(TEXTS)
    out = lines.dedup_lines(docs).select("doc.doc_id", "kept")
    assert rows_of(out, "doc_id", "kept") == sorted(((i, want[i, t]) for i, t in TEXTS), key=repr)
    assert want[16, TEXTS[17][1]].startswith("Licensed")  # a varied field is still the template
    left = lines.without_repeated_lines(docs)
    assert left.columns == docs.columns and left.count() == len(TEXTS)
    assert lines.without_repeated_lines(docs.limit(0)).count() == 0


def test_near_lines_share_the_template_of_their_leaf(spark):
    rows = [(i, f"Sign in as member {'abcdefgh'[i]} to read or write any more comments here\nown{i} text line {'xyzuvwrs'[i] * 3}")
            for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.kept for r in lines.dedup_lines(df).select("doc.doc_id", "kept").collect()}
    assert out == {i: k for (i, _), k in brute.line_dedup(rows).items()}
    assert out[0] == rows[0][1] and out[5].startswith("own5")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v string")


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    some = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(300, 9))]
    rows = [(i, v, "a", "b") for i, v in enumerate(some)]
    rows += [(1000 + i, some[7], "a", "b") for i in range(60)]  # ties
    rows += [(2000, None, "", ""), (2020, [0.0] * 9, "", ""), (2040, [float("nan")] + [1.0] * 8, "", ""),
             (2060, [float("inf")] + [1.0] * 8, "", ""), (2080, [None] + [1.0] * 8, "", ""), (2100, [1.0] * 4, "", ""),
             (None, some[3], "", ""), (40, some[40], "again", "")]
    out = multi_index.nearest(vectors(spark, rows), F.col("id") % 20 == 0)
    found = sorted(tuple(r) for r in out.collect())
    assert found == sorted(brute.nearest([r[:2] for r in rows], lambda i: i % 20 == 0))


def test_nearest_keeps_every_row_of_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.875, 0.125]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.0, 2.0])] + [(7, [5.0, 0.0])] * 30
    rows += [(40, [5.0, 0.0])] * 25 + [(41, [5.0, 0.0]), (42, [5.0, 0.0])]
    found = sorted(tuple(r) for r in multi_index.nearest(vectors(spark, [(*r, "", "") for r in rows]), F.col("id") % 20 == 0, k=4).collect())
    assert found == sorted(brute.nearest(rows, lambda i: i % 20 == 0, k=4))


def test_nearest_copies_entries_to_visiting_blocks_only(spark, monkeypatch):
    """Two far clusters with queries in one: the other's entries stay."""
    monkeypatch.setattr(multi_index, "FIRST", 20)
    rows = [(i, [10.0 + i % 7 / 10, 0.0, 10.0, i % 5 / 10], "", "") for i in range(200)]
    rows += [(1000 + i, [-10.0 - i % 7 / 10, 0.0, -10.0, i % 5 / 10], "", "") for i in range(200)]
    copied = []
    search = multi_index._search

    def spy(cells, queries, blocks, query_parts, k):
        visiting = queries.select("c1").distinct()
        copied.append(cells.join(visiting, "c1", "left_semi").count())
        return search(cells, queries, blocks, query_parts, k)

    monkeypatch.setattr(multi_index, "_search", spy)
    multi_index.nearest(vectors(spark, rows), (F.col("id") < 1000) & (F.col("id") % 20 == 0), k=5).collect()
    assert max(copied) <= 200


def test_nearest_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 32)
    monkeypatch.setattr(multi_index, "FIRST", 40)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 6))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 5] + rng.normal(size=6) / 9], "", "") for i in range(500)]
    found = sorted(tuple(r) for r in multi_index.nearest(vectors(spark, rows), F.col("id") % 3 == 0, k=7).collect())
    assert found == sorted(brute.nearest([r[:2] for r in rows], lambda i: i % 3 == 0, k=7))


def test_nearest_of_few_and_none(spark):
    out = multi_index.nearest(vectors(spark, [(0, [1.0], "", ""), (1, [2.0], "", "")]), F.col("id") % 20 == 0)
    assert [tuple(r) for r in out.collect()] == [(0, 1, 1, 2.0)]
    for rows in ([], [(0, None, "", "")]):
        assert multi_index.nearest(vectors(spark, rows), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sources", [1, 2, 5, 9, 9, 9, 3000])
def test_targets_follow_the_rounds(spark, sources):
    rng = random.Random(sources)
    sizes = [rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for _ in range(sources)]
    names = sorted({f"{rng.choice('aAz\u00e9\U0001f600')}{rng.random()}" for _ in range(sources - 1)}) + [None]
    rows = [(s, n // 2) for s, n in zip(names, sizes)] + [(s, n - n // 2) for s, n in zip(names, sizes)]
    out = shares(spark.createDataFrame(rows, "source string, size long"), (1, 2, 3)).collect()
    found = {r.source: r for r in out}
    want = brute.mix_targets(sizes, [1 + i % 3 for i in range(sources)])
    assert len(out) == sources and [found[s].source_size for s in names] == sizes
    assert np.allclose([found[s].target for s in names], want)
    assert [found[s].start_weight for s in names] == [(1.5, 1.0, 0.5)[i % 3] for i in range(sources)]


def test_targets_without_words(spark):
    assert shares(spark.createDataFrame([], "source string, size long"), (1, 2, 3)).collect() == []
    rows = shares(spark.createDataFrame([("a", 0), (None, 0)], "source string, size long"), (1, 2, 3)).collect()
    assert sorted((r.source or "", r.target) for r in rows) == [("", 0.0), ("a", 0.0)]


def test_mix(docs):
    out = mix(docs)
    found = rows_of(out, "doc_id", "size", "source", "source_size", "target", "taken")
    assert found == rows_of(mix(docs.repartition(5)), "doc_id", "size", "source", "source_size", "target", "taken")
    assert sorted(r[1] for r in found) == sorted(len(brute.WORD.findall(t or "")) for _, t in TEXTS)
    by = brute.group(found, lambda r: r[2])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[1] for r in by[s]) for s in names]
    for name, size, goal in zip(names, sizes, brute.mix_targets(sizes, [1 + i % 3 for i in range(len(names))])):
        largest = max(r[1] for r in by[name])
        assert {(r[3], round(r[4], 6)) for r in by[name]} == {(size, round(goal, 6))}
        assert abs(sum(r[5] for r in by[name]) - goal) <= largest / 2 + 1
    assert all(r[5] <= 3 * r[1] and (r[1] == 0 or r[5] % r[1] == 0) for r in found)
    for r in out.collect():
        assert len(r.positions) == len(r.passes) and all(0 <= p <= 1 for p in r.positions)
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns
    assert sum(len(brute.WORD.findall(r.text or "")) for r in copies.collect()) == sum(r[5] for r in found)
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_private(docs):
    out = find_private(docs)
    base = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in BASE_KINDS)) for r in out.collect()}
    assert base == {(i, tuple(brute.private_base(t))) for i, t in TEXTS}
    assert find_private(docs.limit(0)).count() == 0


def test_private_parsers_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "2", "55", "255", "0", "+", "-", " ", "(", ")", "b.c", "%", "é", "4111111111111111", "3"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert [s for s in private_spans(text) if s[0] in BASE_KINDS] == brute.private_base(text), text


def test_private_cues():
    text = 'IBAN: DE89 3704 0044 0532 0130 00, ftp://bob:pw@host.example/x, token = "592e2677e7e6567f917b"'
    found = {k: text[b:e] for k, b, e in private_spans(text) if k not in BASE_KINDS}
    assert found == {"account": "DE89 3704 0044 0532 0130 00", "address": "ftp://bob:pw@host.example",
                     "identifier": "592e2677e7e6567f917b"}
    assert private_spans("IBAN: DE89 3704 0044 0532 0130 01. a token of trust, https://example.com/a:b") == []


def test_licenses(docs):
    found = scan_licenses(docs).collect()

    def base(r):
        at = [s for s in r.spans if s.phrase]
        starts = [s.first for s in at]
        return (r.doc_id, r.n_words, len(at), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({s.label for s in at})))

    assert sorted(map(base, found), key=repr) == expected(brute.license_base)
    changed = next(r for r in found if r.doc_id == 19)  # "the present software" for "this software"
    assert [(s.label, s.phrase) for s in changed.spans] == [("mit", False)] and 0.6 <= changed.spans[0].coverage < 1
    assert scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [8192, 2])
def test_suffixes(docs, monkeypatch, limit):
    monkeypatch.setattr(suffixes, "GROUP", limit)
    out = suffixes.find_repeats(docs)
    found = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)
                    for r in out.collect()), key=repr)
    want = brute.removed_bytes([t for _, t in TEXTS])
    assert found == sorted(((i, *w) for (i, _), w in zip(TEXTS, want)), key=repr)
    assert sum(w[1] for w in want) > 0
    assert suffixes.find_repeats(docs.limit(0)).count() == 0


def test_suffix_runs_cover_every_window_once():
    rng = random.Random(2)
    for data in (b"ab" * 300, bytes(rng.choices(b"abc", k=2000)), b"x" * 199, b"x" * 200, bytes(rng.choices(b"ab", k=400_000))):
        key, first, last, anchor = suffixes.suffix_runs(data)
        assert [i for a, b in zip(first, last) for i in range(a, b + 1)] == list(range(max(0, len(data) - 199)))
        assert all(b <= p <= a + 200 - suffixes.PREFIX for a, b, p in zip(first, last, anchor))
        assert len(key) == len(first)


def test_suffixes_of_a_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=300_000))
    texts = [(1, long[:270_000] + long[1000:1400] + long[270_000:]), (2, long[200_000:200_300]), (3, long[5:199])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)
             for r in suffixes.find_repeats(df).collect()}
    assert [found[i] for i in (1, 2, 3)] == brute.removed_bytes([t for _, t in texts])


@pytest.fixture(scope="module")
def with_maps(spark):
    """Rows of one id and text that differ elsewhere, equal rows, and a map."""
    text = prose(40, 77)
    rows = [(1, text, "x", "s", {"a": 1}), (1, text, "y", "s", {"a": 1}), (1, text, "y", "s", {"a": 2, "b": 3}), (2, prose(50, 78), "x", "s", None),
            (2, prose(50, 78), "x", "s", None), (3, None, "z", None, {}), (None, text, "z", "t", {"c": 1})]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, facts map<string,int>").repartition(3)


def plain(rows):
    return sorted((repr((r.doc_id, r.text, r.lang, r.source, r.facts)) for r in rows))


def test_near_duplicates_with_maps(with_maps):
    left = simhash.keep_one_each(with_maps)
    assert left.columns == with_maps.columns
    rows = left.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3] and set(plain(rows)) <= set(plain(with_maps.collect()))
    assert plain(simhash.keep_one_each(with_maps.repartition(5)).collect()) == plain(rows)


def test_mixing_keeps_rows_that_differ_elsewhere(spark, with_maps):
    every = mixed_documents(with_maps, weights=(1, 1, 1))
    assert every.columns == with_maps.columns and set(plain(every.collect())) <= set(plain(with_maps.collect()))
    assert plain(mixed_documents(with_maps.repartition(5), weights=(1, 1, 1)).collect()) == plain(every.collect())
    twins = [(1, "a b c", "s", {"n": i}) for i in range(4)]
    out = mixed_documents(spark.createDataFrame(twins, "doc_id long, text string, source string, facts map<string,int>"))
    assert sorted(r.facts["n"] for r in out.collect()) == [0, 1, 2, 3]


def check_simhash(docs, texts):
    found = simhash.near_duplicates(docs).select("id", "fp", F.col("first.id").alias("c")).collect()
    prints = [brute.simhash(t) for _, t in texts]
    own = brute.components(prints)
    least = {}
    for (i, _), c in zip(texts, own):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(texts, prints, own)), key=repr)
    assert sorted(((r.id, f"{r.fp & (2**64 - 1):016x}", r.c) for r in found), key=repr) == want
    return own


def test_simhash(docs):
    own = check_simhash(docs, TEXTS)
    left = simhash.keep_one_each(docs)
    assert left.columns == docs.columns and left.count() == len(set(own))
    assert simhash.keep_one_each(docs.limit(0)).count() == 0


def test_simhash_through_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    texts = []
    for i in range(40):
        words = prose(120, 100 + i).split()
        for j in range(5):  # chains of small edits
            texts.append((10 * i + j, " ".join(words)))
            words[(7 * j) % len(words)] = f"edit{j}"
    check_simhash(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 100), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    groups = brute.group(simhash.components(frame).collect(), lambda r: r.root)
    assert sorted(sorted(r.node for r in g) for g in groups.values()) == [list(range(61)), [100, 200, 300]]


RULES = queries.URL_RULES


def test_urls(spark):
    urls = ["http://Tionsh.Example.NET/en/1", "https://a.example.net", "https://a.example.net/", "https://a.example.com/de/x?y#z",
            "http://b.org/fr/", "http://borg/fr/", "x", None, "", "://", "http://", "http://www.spam.example/a/?utm_source=q&b=1#c",
            "https://spam.example/a?b=1", "https://spam.example/a?b=2", "http://net/", "http://evil.net?x://", "a://b://c.net/d"]
    urls += [urls[11]] * 30
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(urls)] + [(None, urls[0], "h", True)],
                                  "page_id long, url string, host string, listed boolean")
    listed = spark.createDataFrame([("http://spam.example/a/?b=1",), (None,), ("nonsense",)], "url string")
    for blocks in (1 << 16, 1):
        out = filter_urls(pages, listed, RULES, blocks=blocks).collect()
        assert len(out) == len(urls) + 1
        for r in out:
            url = urls[r.page_id if r.page_id is not None else 0]
            assert (r.host, r.path) == brute.url_parts(url)
            fits = [(len(x), x, v) for v, x in RULES if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0]))
                    and r.path.startswith(x[x.index("/"):])]
            best = max(fits, default=None)
            assert r.rule == (best[1] if best else None)
            spam = url in (urls[11], urls[12])
            assert r.listed == spam and r.verdict == (best[2] if best else "block" if spam else "allow")
    assert {r.verdict for r in filter_urls(pages, listed.limit(0), (), ).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), listed, RULES).count() == 0
