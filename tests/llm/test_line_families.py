"""Line dedup in leaves with several template families."""

import hashlib
import random
from collections import Counter

import pytest

from aspectspark.llm import lines
from tests.llm import brute


def families(docs, bound=lambda size: 2 if size >= 8 else 3, depth=3, similarity=0.8):
    """{id: kept text} of documents with distinct ids and lines of words
    without digits: each kind joins the first leader that it agrees with."""
    split = {i: t.split("\n") for i, t in docs}
    count = Counter(tuple(x.split()) for ls in split.values() for x in ls)
    leaves = brute.group(count, lambda t: (len(t), t[:depth]))
    template = {}
    for kinds in leaves.values():
        leaders = []
        for t in sorted(kinds, key=lambda t: (-count[t], hashlib.md5(" ".join(t).encode()).digest())):
            own = (x for x in leaders if sum(a == b for a, b in zip(t, x)) >= similarity * len(t))
            template[t] = next(own, t)
            if template[t] is t:
                leaders.append(t)
    places = brute.group([(i, n, template[tuple(x.split())]) for i in sorted(split) for n, x in enumerate(split[i])],
                         lambda p: p[2])
    gone = {p[:2] for t, at in places.items() if len({p[0] for p in at}) >= bound(len(t)) for p in at[1:]}
    return {i: "\n".join(x for n, x in enumerate(ls) if (i, n) not in gone) for i, ls in split.items()}


def kept(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.kept for r in lines.dedup_lines(df).select("doc.doc_id", "kept").collect()}


def test_a_second_family_of_a_leaf_is_dropped(spark):
    fixed = "Read more about how we handle your data in our notice"
    docs = [(i, f"{fixed}\nRead more about the {'amber birch cedar delta'.split()[i % 4]}{'xyz'[i // 4]} story on the next few pages")
            for i in range(10)]
    out = kept(spark, docs)
    assert out[0] == docs[0][1] and all(out[i] == "" for i in range(1, 10))
    assert out == families(docs)


@pytest.mark.parametrize("front", [(1, 2), (2, 4), (lines.FIRST_FRONT, lines.FRONT)])
def test_families_equal_plain_python(spark, monkeypatch, front):
    monkeypatch.setattr(lines, "FIRST_FRONT", front[0])
    monkeypatch.setattr(lines, "FRONT", front[1])
    rng = random.Random(3)
    words = "ash bay elm fig oak".split()
    heads = ["Read more about", "Sign in to"]

    def line():
        size = rng.choice([2, 5, 6, 11, 17])
        base = random.Random(rng.randint(0, 3) * 100 + size)
        rest = [base.choice(words) for _ in range(size)]
        for _ in range(rng.randint(0, size // 3)):
            rest[rng.randrange(size)] = rng.choice(words)
        return " ".join([rng.choice(heads), *rest])

    docs = [(i, "\n".join(line() for _ in range(4))) for i in range(60)]
    assert kept(spark, docs) == families(docs)


def rounds(monkeypatch):
    """Names of the tables that the rounds write, as they are written."""
    names, write = [], lines.materialize

    def noted(df, name):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(lines, "materialize", noted)
    return names


def test_many_lines_that_begin_alike_take_few_rounds(spark, monkeypatch):
    names = rounds(monkeypatch)
    rng = random.Random(5)
    docs = [(i, f"Published by the New York {' '.join(f'w{rng.choice(WORDS)}' for _ in range(7))}") for i in range(2000)]
    assert kept(spark, docs) == families(docs)
    assert sum(n.startswith("line-front") for n in names) <= 12


def test_many_lines_of_few_words_that_do_not_agree_take_few_rounds(spark, monkeypatch):
    names = rounds(monkeypatch)
    rng = random.Random(6)
    docs = [(i, f"Published by the {' '.join(rng.choice('ash bay elm fig oak yew'.split()) for _ in range(17))}")
            for i in range(2000)]
    assert kept(spark, docs) == families(docs)
    assert sum(n.startswith("line-front") for n in names) <= 12


def test_a_large_family_leaves_with_its_leader(spark, monkeypatch):
    names = rounds(monkeypatch)
    base = "Read more about some story on the next few of our pages"
    fixed = "Read more about how we handle all of your data in notices"
    docs = [(0, f"{fixed}\n{fixed}\n{fixed}")]
    docs += [(i, base.replace("story", f"{WORDS[i % 60]}{WORDS[i // 60]}")) for i in range(1, 1500)]
    out = kept(spark, docs)
    assert out == families(docs) and sum(x == "" for x in out.values()) == 1498
    assert sum(n.startswith("line-front") for n in names) == 1


WORDS = [a + b for a in "abcdefgh" for b in "klmnopqr"]


def test_two_documents_are_enough_for_long_lines(spark):
    long, short = "one two three four five six seven eight", "one two three four five six seven"
    docs = [(1, f"{long} x\n{short}\na"), (2, f"b\n{long} y\n{short}"), (3, f"c\n{long}"), (4, f"d\n{long}")]
    out = kept(spark, docs)
    assert out == {1: docs[0][1], 2: f"b\n{short}", 3: docs[2][1], 4: "d"}
    assert out == families(docs)
