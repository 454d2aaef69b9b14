"""Hard negatives, sharding and collocations against plain Python, on tables
with nulls, ties, repeated rows, clashing column names, and no rows at all."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectspark.llm import collocations as phrases
from aspectspark.llm import hard_negatives as negatives
from aspectspark.llm import sharding
from aspectspark.session import scratch_path
from tests.llm import brute


def vectors(spark, rows):
    rows = [(*r, 1, "x", 2.0, 3) for r in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int, v string, score double, "
                                       "page int").repartition(3)


def mined(spark, rows, every=10, **options):
    out = negatives.mine_hard_negatives(vectors(spark, rows), F.col("id") % every == 0, **options)
    return sorted(tuple(r) for r in out.collect())


def random_vectors(n, dims, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, (centres[i % labels] + spread * rng.normal(size=dims)).tolist(), i % labels) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"PAGE": 32, "LEAF": 8, "FAN": 2, "NODE": 3, "BLOCK": 7}])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(negatives, name, value)
    rows = random_vectors(400, 6, 4, 1)
    same = rows[7][1]
    rows += [(1000 + i, same, i % 2) for i in range(50)]  # one large group of copies
    rows += [(2000, None, 1), (2010, [], 2), (2020, [1.0, None, 0.0], 1), (2030, [float("nan")] * 6, 1),
             (2040, [float("inf")] * 6, 1), (2050, [0.0] * 6, None), (None, same, 1), (2060, [1.0, -2.0], 3),
             (2070, [9.0] * 6, 99), (2080, [0.0] * 6, 1), (20, rows[20][1], 0), (20, rows[20][1], 0), (21, rows[21][1], 1)]
    assert mined(spark, rows) == brute.hard_negatives(rows, every=10)


def test_hard_negatives_of_huge_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2**21, 2**21)) for _ in range(5)], i % 2) for i in range(60)]
    assert mined(spark, rows, low=10) == brute.hard_negatives(rows, every=10, low=10)


def test_hard_negatives_prune_boxes(monkeypatch):
    """On clustered vectors a query reads few leaves."""
    import pandas as pd

    rows = random_vectors(4000, 8, 20, 5, spread=0.05)
    frame = pd.DataFrame([(i, i, c, np.floor(256 * np.array(v)).astype(int)) for i, v, c in rows], columns=["row", "id", "label", "v"])
    page = negatives.Page(negatives.packed(frame, 8), 8)
    query = frame["v"][0].astype(np.int64)
    read = []
    monkeypatch.setattr(negatives, "_suits", lambda labels, label, same: read.append(len(labels)) or (labels == label) == same)
    spans = tuple(s[0] for some in (page.inner, page.leaves) for s in negatives.intervals(query[None, :], *some))
    found = negatives.best_first(page, query, 0, 0, [[negatives.LOWEST, negatives.HIGHEST, negatives.LOWEST]], 5, True, spans)
    scores = sorted((-int(query @ v), i) for i, v, c in zip(frame["id"], frame["v"], frame["label"]) if c == 0 and i != 0)
    assert found[0] == scores[:5] and sum(read) < len(rows) / 4


def test_hard_negatives_of_few_and_none(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]


DOCS = [(i, f"text {i} " * (1 + i % 7)) for i in range(300)] + [(None, "nobody"), (None, None), (400, None), (400, ""), (401, "é" * 500)]
DOCS += [(500, "the same row")] * 700


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, {"a": i or 0}, n) for n, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, id int, copy map<string,long>, n int").repartition(4)


def test_sharding(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 100)
    rows = sharding.shard_documents(docs, n_shards=7).collect()
    data = [(i, (t or "").encode()) for i, t in DOCS]
    assert Counter((r.id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in data)
    by = brute.group(rows, lambda r: r.shard)
    assert sorted(by) == list(range(7))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in own) for own in by.values()]
    assert max(loads) - min(loads) <= max(len(t) + 8 for _, t in data)
    assert len({r.shard for r in rows if r.id == 500}) == 7  # a hot record is spread
    again = sharding.shard_documents(docs.repartition(9), n_shards=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_a_new_shard_takes_what_the_others_hold_too_much(spark, docs):
    path = scratch_path(spark, "test-maps")
    sizes = sharding.slot_sizes(sharding.records(docs)).cache()
    first = sharding.store_map(sharding.edited_map(sizes, 6), path)
    second = sharding.store_map(sharding.edited_map(sizes, 7, first), path)
    third = sharding.store_map(sharding.edited_map(sizes, 5, second), path)
    one, two, three = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, second, third))
    assert [m.first()["version"] for m in (first, second, third)] == [1, 2, 3]
    assert sharding.stored_map(spark, path).first()["version"] == 3 and sharding.stored_map(spark, path, 1).count() == 4096
    weight = {r.virtual_slot: r.bytes for r in sizes.collect()}
    total, moved = sum(weight.values()), [s for s in weight if one[s] != two[s]]
    assert sum(weight[s] for s in moved) <= 1.5 * total / 7 and {two[s] for s in weight} == set(range(7))
    assert set(three.values()) == set(range(5))
    for held, n in ((one, 6), (two, 7), (three, 5)):
        loads = Counter()
        for s, w in weight.items():
            loads[held[s]] += w
        assert max(loads.values()) <= 1.1 * total / n


def test_written_shards_hold_every_row(spark, docs):
    placed = sharding.shard_documents(docs, n_shards=5)
    slots = sharding.edited_map(sharding.slot_sizes(sharding.records(docs)), 5)
    path = scratch_path(spark, "test-shards")
    sharding.write_shards(docs, slots, path)
    back = spark.read.parquet(path)
    assert sorted(r.n for r in back.collect()) == list(range(len(DOCS)))
    shards = Counter((r.doc_id, r.text or "", r.shard) for r in back.collect())
    crc = Counter((i, zlib.crc32(t.encode()), s) for (i, t, s) in shards.elements())
    assert crc == Counter((r.id, r.text_crc32, r.shard) for r in placed.collect())


def phrase_docs(seed=3):
    rng = random.Random(seed)
    words = ["the", "Of", "New", "york", "über", "日本", "a\xa0b", "x", "-", "1"]
    texts = [" ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 60))) + rng.choice([".", "\n", "\t!", ""])
             + "once upon a time, there" * rng.randint(0, 1) for _ in range(120)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    return rows + [("en", None), ("en", ""), ("fr", " \t\n"), ("en", ".,;:!?\x0b\x0c\r")] + [("en", "hot line of copies")] * 200


def mined_phrases(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, word string").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(frame, **options).collect())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 64, "MAX_BUCKETS": 64, "RANK_PARTS": 3}])
def test_collocations_equal_plain_python(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_docs()
    assert mined_phrases(spark, rows) == brute.collocations(rows)
    assert mined_phrases(spark, rows, top=7, shards=2, min_count=4) == brute.collocations(rows, top=7, min_count=4)


def test_longer_collocations(spark):
    rows = phrase_docs(4)
    assert mined_phrases(spark, rows, longest=5, shards=4, min_count=3) == brute.collocations(rows, longest=5, min_count=3)


def test_collocations_of_none(spark):
    assert mined_phrases(spark, []) == [] and mined_phrases(spark, [("en", None), (None, "one two")]) == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 10)
    for text in (b"abc. defgh ijklmnopqrst, u v w", b"x" * 40, b"", b"a.b.c.d.e.f.g.h.i.j.k.l", b"aaaaaaaaaaaaaaaaa.b"):
        parts = list(phrases.cut(text))
        assert phrases.END.join(parts) == text.translate(phrases.TABLE)


@pytest.mark.parametrize("n_words", [50, 1 << 40])
def test_distinct_phrases(n_words):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 5, 300) for _ in range(3)]
    places, count = phrases.distinct(words, n_words)
    assert dict(zip(zip(*(p.tolist() for p in places)), count.tolist())) == Counter(zip(*(w.tolist() for w in words)))
