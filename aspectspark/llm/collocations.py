"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards, which are scanned in a cycle.  Words are
counted from the first scan on.  A longer phrase becomes active after the
scan in which both its subphrases, all but its last and all but its first
word, have reached the threshold; from the next scan on it is counted, along
with all other lengths, until it has seen every shard once.  So the lengths
interleave, and a phrase that recurs often is counted long before the shorter
ones have been counted in full.

A phrase that occurs often enough has subphrases that do, so every one of
them becomes active; its count is exact after its own cycle.

Phrases are known by the hashes of their words; words are counted by their
text, and if two of them should share a hash, the count starts anew with
another seed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectspark.llm.common import discard, materialize, shuffle_partitions, spread_keys
from aspectspark.session import scratch_path, ship_package

LONGEST = 3
MIN_COUNT = 10
SHARE = 50
TOP = 2000

#: Shards of the cycle.
SHARDS = 3

#: Bytes of text that a task counts before it hands on what it has.
BLOCK = 1 << 24

#: Buckets of an activation table, a byte each: one for so many bytes of text,
#: and at most so many.  Phrases of one bucket become active together, so
#: beyond its capacity more phrases are counted than need be; counts stay
#: exact.
TEXT_PER_BUCKET = 128
MAX_BUCKETS = 1 << 24

#: "Not active yet" in an activation table.
NEVER = 255

#: Ends of pieces become a line feed, tabs a blank, A-Z small letters.
END = b"\n"
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Levels of the ranking below the last one.
RANK_PARTS = 64


def cut(text: bytes) -> Iterator[bytes]:
    """The text in lower case with ``END`` between pieces; a long one in
    parts that end with a piece."""
    text, at = text.translate(TABLE), 0
    while len(text) - at > BLOCK:
        end = text.rfind(END, at, at + BLOCK)
        end = text.find(END, at + BLOCK) if end < 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def numbered(parts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Number of each token of the parts (0: the end of a piece), and the
    words by number; an empty one stands for nothing."""
    text = b"\n " + END.join(parts).replace(END, b" \n ")
    found = pc.split_pattern(pa.array([text], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    ids, names = found.indices.to_numpy(), found.dictionary.cast(pa.large_binary()).to_pylist()
    return ids[ids != names.index(b"")].astype(np.int64) if b"" in names else ids.astype(np.int64), names


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Language, numbers and words of about ``BLOCK`` bytes of text at a
    time."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in cut(text.as_buffer().to_pybytes()):
                held[lang].append(part)
                size[lang] += len(part)
                if size[lang] >= BLOCK:
                    yield lang, *numbered(held.pop(lang))
                    size.pop(lang)
    for lang, parts in held.items():
        yield lang, *numbered(parts)


def word_hash(seed: int) -> Column:
    """Hash of a word under its language; ``_word_hashes`` agrees."""
    return F.xxhash64(F.concat("lang", F.lit(f"/{seed}")), "word")


def _word_hashes(lang: str, names: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    base = xxh64_intdigest(f"{lang}/{seed}".encode(), 42)
    return np.fromiter((xxh64_intdigest(w, base) for w in names), dtype=np.uint64, count=len(names))


def bucket_of(hashes: list[np.ndarray], buckets: int) -> np.ndarray:
    """Bucket of a phrase from the hashes of its words."""
    out = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out & np.uint64(buckets - 1)).astype(np.int64)


def _word_counts(texts: DataFrame) -> DataFrame:
    """lang, word and count, partial per block."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in blocks(batches):
            counts = np.bincount(ids, minlength=len(names))
            counts[0] = 0
            words = pa.array(names, pa.binary()).cast(pa.string()).filter(pa.array(counts > 0))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts[counts > 0])],
                                             names=["lang", "word", "n"])

    return texts.mapInArrow(scan, "lang string, word string, n long")


def _hashed(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


class Activation(NamedTuple):
    """From which scan on the phrases of a block are counted: ``since`` by
    word number, ``tables`` by length and bucket."""

    since: np.ndarray
    hashes: np.ndarray
    tables: list[np.ndarray]
    turn: int

    def begin(self, words: list[np.ndarray]) -> np.ndarray:
        """Of phrases of two words or more: as soon as both subphrases may
        be extended."""
        if len(words) == 2:
            return np.maximum(self.since[words[0]], self.since[words[1]])
        return np.maximum(self.extends(words[:-1]), self.extends(words[1:]))

    def extends(self, words: list[np.ndarray], begin: np.ndarray | None = None) -> np.ndarray:
        begin = self.begin(words) if begin is None else begin
        known = np.flatnonzero(begin <= self.turn)
        table = self.tables[len(words) - 1]
        out = np.full(len(begin), NEVER, dtype=np.uint8)
        out[known] = np.maximum(begin[known], table[bucket_of([self.hashes[w[known]] for w in words], len(table))])
        return out


def distinct(words: list[np.ndarray], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different phrases, as word numbers by place, and their counts."""
    if n_words ** len(words) >= 1 << 63:
        rows, count = np.unique(np.stack(words, axis=1), axis=0, return_counts=True)
        return list(rows.T), count
    code = words[0]
    for w in words[1:]:
        code = code * n_words + w
    code, count = np.unique(code, return_counts=True)
    places = []
    for _ in words:
        code, place = np.divmod(code, n_words)
        places.append(place)
    return places[::-1], count


def _phrase_counts(texts: DataFrame, active: Broadcast, turn: int, shards: int, seed: int, longest: int) -> DataFrame:
    """w1, w2, ... (null beyond the phrase), since and count, partial per
    block, of the phrases whose cycle takes in this scan."""
    columns = _hashed(longest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = active.value
        for lang, ids, names in blocks(batches):
            hashes = _word_hashes(lang, names, seed)
            since = tables[0][bucket_of([hashes], len(tables[0]))]
            since[0] = NEVER
            act = Activation(since, hashes, tables, turn)
            ready = since[ids]  # the scan from which on the phrase that begins here may be extended
            for n in range(2, longest + 1):
                begin = np.maximum(ready[:-1], ready[1:])
                at = np.flatnonzero((begin <= turn) & (begin.astype(np.int16) + shards > turn))
                if len(at):
                    words, count = distinct([ids[at + i] for i in range(n)], len(names))
                    parts = [pa.array(hashes[w].view(np.int64)) for w in words]
                    parts += [pa.nulls(len(count), pa.int64())] * (longest - n)
                    since_ = pa.array(act.begin(words).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*parts, since_, pa.array(count)], names=[*columns, "since", "n"])
                if n < longest:
                    ready = act.extends([ids[i:i + len(begin)] for i in range(n)], begin)

    return texts.mapInArrow(scan, ", ".join(f"{c} long" for c in columns) + ", since int, n long")


def _activate(table: np.ndarray, reached: DataFrame, columns: list[str], since: int) -> bool:
    """Activate the buckets of ``reached`` from scan ``since`` on; whether
    any is new.  One row per 64 buckets comes to the driver at most."""
    buckets = len(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bucket_of([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns], buckets)
            bits = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bits.view(np.int64))], names=["block", "bits"])

    marks = reached.select(*columns).mapInArrow(scan, "block long, bits long")
    rows = marks.groupBy("block").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = rows["bits"].to_numpy(np.int64).view(np.uint64)
    on = (bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) > 0
    at = (rows["block"].to_numpy(np.int64)[:, None] * 64 + np.arange(64))[on]
    new = at[table[at] == NEVER]
    table[new] = since
    return len(new) > 0


def count_phrases(texts: DataFrame, size: int, min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS,
                  seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The words (lang, word, n, w) of ``texts`` (lang, text, shard) and the
    phrases of two words or more that occur ``min_count`` times (w1, w2, ...,
    n); ``size`` is that of all texts in bytes.

    The state between two scans is the phrases in the middle of their cycle;
    those at its end leave it, and only frequent ones are kept.
    """
    spark = texts.sparkSession
    columns = _hashed(longest)
    buckets = min(MAX_BUCKETS, max(1 << 12, 1 << (size // TEXT_PER_BUCKET).bit_length()))
    tables = [np.full(buckets, NEVER, dtype=np.uint8) for _ in range(longest - 1)]
    words = state = None
    done, turn, last_new = [], 0, -1
    while turn < shards or turn <= last_new + shards:
        shard, new = texts.where(F.col("shard") == turn % shards).drop("shard"), False
        if turn < shards:
            fresh, old = _word_counts(shard), words
            fresh = fresh if old is None else old.drop("w").unionByName(fresh)
            words = materialize(fresh.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("w", word_hash(seed)),
                                "phrase-words")
            if old is not None:
                discard(old)
            new = _activate(tables[0], words.where(F.col("n") >= min_count), ["w"], turn + 1)
        if turn:
            # what was activated just now counts from the next scan on
            active = spark.sparkContext.broadcast([np.where(t > turn, NEVER, t).astype(np.uint8) for t in tables])
            fresh, old = _phrase_counts(shard, active, turn, shards, seed, longest), state
            fresh = fresh if old is None else old.where("NOT full").drop("full").unionByName(fresh)
            full = F.col("since") + shards - 1 <= turn
            counts = fresh.groupBy(*columns).agg(F.min("since").alias("since"), F.sum("n").alias("n")).withColumn("full", full)
            state = materialize(counts.where(~full | (F.col("n") >= min_count)), "phrase-counts")
            active.unpersist()
            if old is not None:
                discard(old)
            if turn >= shards:
                done.append(materialize(state.where("full").select(*columns, "n"), "phrase-frequent"))
            for n in range(2, longest):
                reached = state.where((F.col("n") >= min_count) & F.col(columns[n - 1]).isNotNull() & F.col(columns[n]).isNull())
                new = _activate(tables[n - 1], reached, columns[:n], turn + 1) or new
        if new:
            last_new = turn
        turn += 1
    if not words.groupBy("w").count().where("count > 1").isEmpty():
        return count_phrases(texts, size, min_count, longest, shards, seed + 1)
    none = spark.createDataFrame([], ", ".join(f"{c} long" for c in [*columns, "n"]))
    return words, reduce(DataFrame.unionByName, done, none)


def _scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """key (the words' hashes), a, and score, k, l, r of the cut that scores
    lowest (ties: the shortest first part)."""
    known = words.select(F.array("w").alias("part"), "n").unionByName(phrases.select(F.col("key").alias("part"), "n"))
    known = materialize(known, "phrase-known")
    cuts = phrases.select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    for side, part in (("l", F.slice("key", 1, F.col("k"))), ("r", F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")))):
        other = spread_keys(known.select(F.col("part").alias("p"), F.col("n").alias(side)), [F.xxhash64("p", F.lit(3))])
        cuts = cuts.withColumn("part", part).join(other, F.col("part") == F.col("p")).drop("part", "p")
    # exact up to 10^14 occurrences: 10^6 a^2 has 35 digits then
    a, l, r = (F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r"))
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r)
    best = cuts.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("key", "a", "best.*")


def _outside(scored: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """Without phrases inside a longer one that has ``share`` percent of
    their occurrences."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("key") - n + 1), lambda i: F.slice("key", i, n))))
    inside = phrases.where(F.size("key") > 2).select(F.explode(inner).alias("inner"), "n")
    longer = inside.groupBy("inner").agg(F.max("n").alias("longer"))
    return scored.join(longer, F.col("key") == F.col("inner"), "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("inner", "longer")


def _ranked(named: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language.  Losers fall out in two rounds
    over hashed parts of a language first, so no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(max(RANK_PARTS, shuffle_partitions(named.sparkSession))))
    parted = named.withColumn("part", spread)
    for part in ("part", F.col("part") % RANK_PARTS):
        window = Window.partitionBy("lang", part).orderBy(*order)
        parted = parted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
    window = Window.partitionBy("lang").orderBy(*order)
    return parted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                 min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of two
    to ``longest`` words per language.

    Words are the runs between tabs, blanks and ends of pieces (``.,;:!?``
    and line breaks) in lower case (A-Z); phrases stay within a piece and
    occur ``min_count`` times or more (a).  Of the cuts into two parts that
    occur l and r times the one with the lowest score, a million a^2 / (l r)
    rounded down, counts; n is the number of words of the language.  Phrases
    inside a longer one with ``share`` percent of their occurrences are
    dropped.  Higher scores come first, then more occurrences, then the
    phrase in byte order.

    A null language is ``und``; a null text has no words; equal rows all
    count; other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "phrase-shards")
    # dealt by place, so a group of copies fills all shards alike
    dealt = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("text") != "").withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
    dealt.write.partitionBy("shard").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words, phrases = count_phrases(texts, size, min_count, longest, shards)
    phrases = phrases.select(F.array_compact(F.array(*_hashed(longest))).alias("key"), "n")
    named = _outside(_scored(words.where(F.col("n") >= min_count), phrases), phrases, share)
    frequent = words.where(F.col("n") >= min_count)
    for i in range(longest):
        name = spread_keys(frequent.select(F.col("w").alias("w_"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 0 else [])),
                           [F.xxhash64("w_", F.lit(3))])
        named = named.withColumn("own", F.get("key", F.lit(i))).join(name, F.col("own") == F.col("w_"), "left").drop("w_", "own")
    named = named.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(longest)]))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = _ranked(named.select("lang", "phrase", "a", "l", "r", "score"), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
