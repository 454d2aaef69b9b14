"""Subword encoding against a plain greedy tokenizer."""

import random

from pyspark.sql import functions as F

from aspectspark.operators import tokens as T


def greedy(word, vocab):
    if len(word) > T.MAX_WORD:
        return [T.UNK]
    at, ids = 0, []
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("" if at == 0 else T.CONTINUES) + word[at:end]
            if piece in vocab:
                ids.append(vocab[piece])
                at = end
                break
        else:
            return [T.UNK]
    return ids


def table(spark, vocab):
    return spark.createDataFrame(list(vocab.items()), "piece string, id int")


PIECES = ["un", "##aff", "##able", "a", "##b", "ab", "##c", "abc", "##bc", "##", "日", "##本", "é", "##é", "x##", "##x##y", "runs", "##s", "run"]
VOCAB = {p: i + T.FIRST_ID for i, p in enumerate(PIECES)}


def test_longest_match_of_words(spark):
    rng = random.Random(4)
    words = ["unaffable", "abc", "abbc", "abcc", "日本", "日本語", "éé", "a##b", "##a", "runs", "runss", "u", "x" * 101, "a" + "b" * 99]
    words += ["".join(rng.choices("abc日é", k=rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in set(words)], "word string")
    found = {r.word: r.ids for r in T.word_pieces(df, table(spark, VOCAB)).collect()}
    # "##" alone continues with nothing, so it can only stand at a word's start
    assert found == {w: greedy(w, VOCAB) for w in set(words)}


def test_encoding_equals_plain_python(spark):
    rng = random.Random(6)
    rows = [(i, "ab abc un", " ".join("".join(rng.choices("abc日xu", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(100, None, "abc abc"), (101, "abc " * 50, "abc"), (102, "a", None), (103, "", " \t\n")]
    df = spark.createDataFrame(rows, "id long, q string, t string").repartition(3)
    max_len = 24
    for truncate in (False, True):
        found = {(r.id, r.window): (r.input_ids, r.attention_mask)
                 for r in T.encode_subwords(df, "id", "q", "t", table(spark, VOCAB), max_len, truncate).collect()}
        want = {}
        for i, q, t in rows:
            ids = lambda s: [x for w in (s or "").split() for x in greedy(w, VOCAB)]
            head, body = ids(q)[:max_len - 4], ids(t)
            room = max_len - 3 - len(head)
            parts = [body[a:a + room] for a in range(0, len(body), room)] or [[]]
            for w, part in enumerate(parts[:1] if truncate else parts):
                b = [T.CLS, *head, T.SEP, *part, T.SEP]
                pad = max_len - len(b)
                want[i, w] = (b + [T.PAD] * pad, [1] * len(b) + [0] * pad)
        assert found == want


def test_pieces_by_words(spark):
    df = spark.createDataFrame([("abcde abxy",), ("abcde b",), (None,)], "t string")
    found = {r.piece: r.id for r in T.build_pieces(df, ["t"]).collect()}
    assert set(found) == {"a", "ab", "##b"} and sorted(found.values()) == [4, 5, 6]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, q string, t string")
    assert T.encode_subwords(df, "id", "q", "t", table(spark, VOCAB)).count() == 0
    one = spark.createDataFrame([(1, "a", "b c")], "id long, q string, t string")
    out = T.encode_subwords(one, "id", "q", "t", table(spark, VOCAB).limit(0), 8).select("input_ids").first()
    assert out.input_ids == [T.CLS, T.UNK, T.SEP, T.UNK, T.UNK, T.SEP, 0, 0]
    assert T.build_pieces(df, ["t"]).filter(F.lit(True)).count() == 0
