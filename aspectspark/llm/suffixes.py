"""Byte-exact removal of repeated passages by a logarithmic family of sparse
suffix arrays.

Every window of ``length`` bytes is represented by one suffix: that which
starts at the window's least k-byte string (by hash, the first of equals),
so equal windows have equal suffixes at equal offsets, and only one suffix in
about ``(length - k) / 2`` bytes is indexed.  A batch's sorted suffix keys
are scanned against the levels that exist, in one merge per level, and two
levels of the same size merge into one of twice the size.  Suffixes found
more than once are followed to the windows themselves, which are compared in
full.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.llm.common import (
    bloom_filter, discard, materialize, might_contain, shuffle_partitions, spread_keys, text_key,
)
from aspectspark.session import scratch_path, ship_package

LENGTH = 200
PREFIX = 96
BATCHES = 4

#: Bytes of a text that are hashed at a time; a longer text goes on where
#: the last full window began.
CHUNK = 1 << 18

#: Runs under one suffix key that a task compares at a time (some 800,000
#: windows); the windows of a key with more are counted as rows of their own.
GROUP = 8192

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    def powers(x: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, x, dtype=np.uint64)]), dtype=np.uint64)

    return powers(int(_BASE)), powers(pow(int(_BASE), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _chunk_runs(data: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    width, n = length - k + 1, len(data)
    up, down = _powers()
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * up[:n], out=sums[1:])
    hashes = _mixed((sums[k:] - sums[:-k]) * down[:n - k + 1])
    # the place stands in the low bits, so of equal hashes the first is least
    low = np.uint64(CHUNK - 1)
    placed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    grid = np.concatenate([placed, np.full(-len(placed) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[width - 1:width - 1 + windows]) & low
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.append(first[1:] - 1, windows - 1)
    anchor = least[first].astype(np.int64)
    return hashes[anchor].view(np.int64), first, last, anchor


def suffix_runs(data: bytes, length: int = LENGTH, k: int = PREFIX) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with the same indexed suffix, in order: the
    suffix key, first and last window, and where the suffix starts.  No two
    windows of a run are equal, as their suffix is at different offsets."""
    if len(data) < length:
        return (np.empty(0, dtype=np.int64),) * 4
    if len(data) <= CHUNK:
        return _chunk_runs(data, length, k)
    parts = []
    for at in range(0, len(data) - length + 1, CHUNK - length + 1):
        key, *places = _chunk_runs(data[at:at + CHUNK], length, k)
        parts.append((key, *(p + at for p in places)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _store(df: DataFrame, name: str, by: tuple[str, ...], buckets: int, ordered: bool = False) -> str:
    """Write a bucketed table, its files in the shared folder."""
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    writer = df.write.option("path", scratch_path(df.sparkSession, name)).bucketBy(buckets, *by)
    (writer.sortBy(*by) if ordered else writer).saveAsTable(name)
    return name


def _drop(spark: SparkSession, name: str) -> None:
    discard(spark.table(name))
    spark.sql(f"DROP TABLE {name}")


class SuffixFamily:
    """Levels of sorted suffix keys, each a table bucketed and sorted by key,
    so that scans and merges read both sides in order without a shuffle.
    Level r holds 2^r batches; a key is one row there however often it
    occurred, so no level has a hot key.

    The levels stay until :meth:`drop`, so a new batch can be added at any
    time and is scanned against all that came before."""

    def __init__(self, spark: SparkSession, length: int, k: int):
        self.spark, self.length, self.k = spark, length, k
        self.buckets = shuffle_partitions(spark)
        self.levels: list[tuple[int, str]] = []
        self.repeated: list[DataFrame] = []

    def _level(self, keys: DataFrame) -> str:
        return _store(keys, "suffix_level", ("key",), self.buckets, ordered=True)

    def _merge_equal(self) -> None:
        """Merge the two youngest levels while they are of one size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (_, a), (rank, b) = self.levels[-2:]
            both = self.spark.table(a).select("key").hint("merge").join(self.spark.table(b).select("key"), "key", "full")
            self.levels[-2:] = [(rank + 1, self._level(both.withColumn("n", F.lit(1).cast("long"))))]
            for name in (a, b):
                _drop(self.spark, name)

    def add(self, texts: DataFrame) -> None:
        """A batch of texts (t1, t2, text): its suffix array is scanned
        against all levels and becomes one."""
        self._merge_equal()
        keys = run_rows(texts, self.length, self.k).groupBy("key").agg(F.count("*").alias("n"))
        older = list(self.levels)
        self.levels.append((0, self._level(keys)))
        array = self.spark.table(self.levels[-1][1])
        found = array.where("n > 1").select("key")
        for _, level in older:
            found = found.union(array.select("key").hint("merge").join(self.spark.table(level).select("key"), "key"))
        self.repeated.append(materialize(found.distinct(), "suffix-repeats"))

    def drop(self) -> None:
        """Delete the levels."""
        while self.levels:
            _drop(self.spark, self.levels.pop()[1])

    def repeats(self) -> DataFrame:
        """Keys of the suffixes that occur more than once in the batches so far."""
        out = self.repeated[0]
        for more in self.repeated[1:]:
            out = out.union(more)
        return materialize(out.distinct(), "suffix-keys")


def _bytes(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", F.col("text").cast("binary"))


def run_rows(texts: DataFrame, length: int, k: int) -> DataFrame:
    """t1, t2, number and key of all runs of the texts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in range(2))
            keys = [suffix_runs(t.as_py(), length, k)[0] for t in batch.column(2)]
            sizes = [len(x) for x in keys]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(t1, sizes)), pa.array(np.repeat(t2, sizes)),
                     pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                     pa.array(np.concatenate(keys))], names=["t1", "t2", "run", "key"])

    return _bytes(texts.select("t1", "t2", "text")).mapInArrow(scan, "t1 long, t2 long, run int, key long")


def _digests(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Of the runs listed in ``runs``: key, 128-bit digest of the bytes that
    the run's windows cover, and ``n``, the documents with this text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for t1, t2, text, runs, n in zip(*(c.to_pylist() for c in batch.columns)):
                key, first, last, _ = suffix_runs(text, length, k)
                rows += [(t1, t2, r, int(key[r]), xxh3_128_digest(text[first[r]:last[r] + length]), n) for r in runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)],
                                                 names=["t1", "t2", "run", "key", "digest", "n"])

    return _bytes(texts.select("t1", "t2", "text", "runs", "n")).mapInArrow(
        scan, "t1 long, t2 long, run long, key long, digest binary, n long")


def _contents(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Of the runs in ``asked``: the bytes, and where in them the suffix starts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                key, first, last, anchor = suffix_runs(text, length, k)
                for a in asked:
                    r = a["run"]
                    rows.append((int(key[r]), t1, t2, r, a["once"], int(anchor[r] - first[r]),
                                 text[first[r]:last[r] + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)],
                                                 names=["key", "t1", "t2", "run", "once", "anchor", "bytes"])

    return _bytes(texts.select("t1", "t2", "text", "asked")).mapInArrow(
        scan, "key long, t1 long, t2 long, run long, once boolean, anchor long, bytes binary")


def _shared_windows(contents: DataFrame, length: int) -> DataFrame:
    """Windows (numbers ``at`` within their run) of the runs found once that
    another run under the same key has too.

    A key's runs meet in one task, unless they are more than ``GROUP``; the
    windows of such a key are rows that are counted by digest, so no task
    holds a large group.
    """
    counts = contents.groupBy("key").count().where(F.col("count") > GROUP).select(F.col("key").alias("hot"))
    marked = materialize(contents.join(spread_keys(counts.withColumn("many", F.lit(True)), [F.xxhash64("hot", F.lit(3))]),
                                       F.col("key") == F.col("hot"), "left").drop("hot"), "suffix-contents")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def shared(group: list[tuple]) -> Iterator[tuple]:
            if len(group) < 2:
                return
            windows = [[(anchor - i, xxh3_128_digest(data[i:i + length])) for i in range(len(data) - length + 1)]
                       for *_, anchor, data in group]
            seen = Counter(w for own in windows for w in own)
            for (t1, t2, run, once, _, _), own in zip(group, windows):
                if once and (at := [i for i, w in enumerate(own) if seen[w] > 1]):
                    yield t1, t2, run, at

        def groups() -> Iterator[list[tuple]]:
            now, group = None, []
            for batch in batches:
                for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != now and group:
                        yield group
                        group = []
                    now = key
                    group.append(tuple(row))
            yield group

        rows = []
        for group in groups():
            rows += shared(group)
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["t1", "t2", "run", "at"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["t1", "t2", "run", "at"])

    few = marked.where("many IS NULL").drop("many").repartition("key").sortWithinPartitions("key")
    near = few.mapInArrow(compare, "t1 long, t2 long, run long, at array<long>")
    windows = marked.where("many").select(
        "t1", "t2", "run", "once", "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("bytes") - length)).alias("i")).select(
        "t1", "t2", "run", "once", "i", F.md5(F.substring("bytes", F.col("i") + 1, F.lit(length))).alias("digest"))
    twice = windows.groupBy("digest").count().where("count > 1").select("digest")
    far = windows.where("once").join(spread_keys(twice, [F.xxhash64("digest")]), "digest", "left_semi").groupBy(
        "t1", "t2", "run").agg(F.collect_set("i").alias("at"))
    return near.unionByName(far)


def _removed(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Spans of removed bytes by text, from its ``marks``: whole runs, or
    windows of runs."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
                _, first, last, _ = suffix_runs(text, length, k)
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                for mark in marks:
                    r = mark["run"]
                    if mark["at"] is None:
                        edge[first[r]] += 1
                        edge[last[r] + length] -= 1
                    else:
                        at = first[r] + np.unique(mark["at"])
                        edge[at] += 1
                        edge[at + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                rows.append((t1, t2, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], kind), pa.array([r[3] for r in rows], pa.string())],
                names=["t1", "t2", "spans", "kept_sha256"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return _bytes(texts.select("t1", "t2", "text", "marks")).mapInArrow(
        scan, "t1 long, t2 long, spans array<struct<start: long, end: long>>, kept_sha256 string")


def _removed_spans(texts: DataFrame, length: int, k: int) -> DataFrame:
    """t1, t2, spans and kept_sha256 of the texts (t1, t2, n, text, runs)
    that lose bytes, written."""
    # runs whose whole content occurs more than once need no further look
    digests = materialize(_digests(texts, length, k), "suffix-digests")
    stats = digests.groupBy("digest").agg(F.sum("n").alias("total"), F.min(F.struct("t1", "t2", "run")).alias("least"))
    known = materialize(digests.join(spread_keys(stats, [F.xxhash64("digest")]), "digest").select(
        "t1", "t2", "run", "key", (F.col("total") == 1).alias("once"),
        (F.col("least") == F.struct("t1", "t2", "run")).alias("first")), "suffix-known")
    # the others are compared with each other and with one of each of those
    open_keys = known.where("once").select("key").distinct()
    asked = known.where("first").join(spread_keys(open_keys, [F.xxhash64("key", F.lit(3))]), "key", "left_semi").groupBy(
        "t1", "t2").agg(F.collect_list(F.struct("run", "once")).alias("asked"))
    shared = _shared_windows(_contents(texts.join(asked, ["t1", "t2"]), length, k), length)

    whole = known.where("NOT once").select("t1", "t2", "run", F.lit(None).cast("array<long>").alias("at"))
    marks = whole.unionByName(shared).groupBy("t1", "t2").agg(F.collect_list(F.struct("run", "at")).alias("marks"))
    return materialize(_removed(texts.join(marks, ["t1", "t2"]), length, k), "suffix-removed")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 k: int = PREFIX, batches: int = BATCHES) -> DataFrame:
    """``id_col``, n_bytes, spans (byte ranges to remove) and kept_sha256
    (digest of the bytes that stay) of every row.

    A byte is removed if a string of ``length`` bytes that covers it also
    starts anywhere else in the texts, in the same one included.  Null texts
    are empty; texts shorter than ``length`` keep all.  Results depend on the
    text alone, so equal rows get equal results and a group of copies is one
    text with a count; ids may be null or repeated; other columns are not
    read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("id", *text_key(F.col("text")), "text")
    long = keyed.where(F.octet_length("text") >= length)

    family = SuffixFamily(spark, length, k)
    try:
        for number in range(batches):
            family.add(long.where(F.pmod(F.col("t2"), F.lit(batches)) == number))
        repeats = family.repeats()
    finally:
        family.drop()

    # texts with a repeated suffix, once each, with the numbers of such runs
    probed = might_contain(run_rows(long, length, k), bloom_filter(repeats, "key"), F.col("key"), "maybe")
    runs = materialize(probed.where("maybe").drop("maybe").join(repeats, "key", "left_semi")
                       .groupBy("t1", "t2").agg(F.sort_array(F.collect_set("run")).alias("runs")), "suffix-runs")
    some = might_contain(long, bloom_filter(runs, "t1"), F.col("t1"), "maybe").where("maybe")
    texts = some.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first("text").alias("text")).join(runs, ["t1", "t2"])
    table = _store(texts, "suffix_texts", ("t1", "t2"), shuffle_partitions(spark))
    try:
        removed = _removed_spans(spark.table(table), length, k)
    finally:
        _drop(spark, table)

    base = keyed.select("id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2("text", 256).alias("all_sha256"))
    return base.join(spread_keys(removed, [F.xxhash64("t1", F.lit(3))]), ["t1", "t2"], "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.coalesce("spans", F.array().cast(removed.schema["spans"].dataType)).alias("spans"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))
