"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.session import scratch_path

#: The ASCII white space that separates words: tab, LF, VT, FF, CR, space.
SPACES = "\t\n\u000b\f\r "
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_RUN = "[^\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space (null: none)."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that identify a text.

    Operators whose result depends on the text alone work on distinct
    texts under this key, so a group of copies, however large, is one row.
    """
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def rest_key(df: DataFrame, without: Sequence[str]) -> Column:
    """Hash of the columns beyond ``without``, of any type, maps too: rows
    that agree in those and in this are equal."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.xxhash64(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})) if rest else F.lit(0).cast("long")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends in files
    that every executor sees, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_keys(df: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Deal an aggregated side by something other than its grouping keys.

    A join would otherwise reuse the aggregate's partitioning, and then
    adaptive execution cannot split a hot key of the other side.
    """
    return df.repartition(*by) if by else df.repartition(shuffle_partitions(df.sparkSession))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: 64-bit words of a block of a blocked Bloom filter; a key sets one bit in each.
BLOOM_WORDS = 8

#: Keys per block: about one miss in 400 passes.
BLOOM_KEYS = 40

#: Blocks at most (32 MB of bits): up to 2 * 10^7 keys keep that rate, 4 * 10^7
#: let one miss in 20 through.
BLOOM_BLOCKS = 1 << 19


class Bloom(NamedTuple):
    """A blocked Bloom filter: one row per block that has keys."""

    frame: DataFrame
    blocks: int


def _bloom_bits(key: Column) -> list[Column]:
    """One bit for each word of the key's block."""
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BLOOM_WORDS)]


def _bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(8)), F.lit(blocks)).cast("int")


def bloom_blocks(keys: int) -> int:
    """Blocks for a number of keys: a power of two, up to ``BLOOM_BLOCKS``."""
    return min(BLOOM_BLOCKS, 1 << max(0, -(-keys // BLOOM_KEYS) - 1).bit_length())


def bloom_filter(keys: DataFrame, column: str, blocks: int | None = None) -> Bloom:
    """Blocked Bloom filter of a column.  Its size follows the number of rows
    of ``keys`` (a written table, as they are counted first) unless
    ``blocks`` is given."""
    blocks = bloom_blocks(keys.count()) if blocks is None else blocks
    key, words = F.col(column), [f"bloom_{i}" for i in range(BLOOM_WORDS)]
    bits = keys.where(key.isNotNull()).select(
        _bloom_block(key, blocks).alias("bloom_block"), *[b.alias(w) for w, b in zip(words, _bloom_bits(key))])
    return Bloom(bits.groupBy("bloom_block").agg(*[F.bit_or(w).alias(w) for w in words]), blocks)


def might_contain(df: DataFrame, bloom: Bloom, key: Column, flag: str) -> DataFrame:
    """Add a boolean column: false means that the filter's keys lack ``key``.

    The filter is broadcast: it has at most ``BLOOM_BLOCKS`` rows whatever
    the number of keys.  Beyond its capacity it lets more rows through, which
    the exact join behind it removes.
    """
    joined = df.withColumn("bloom_block", _bloom_block(key, bloom.blocks)).join(
        F.broadcast(bloom.frame), "bloom_block", "left")
    hit = key.isNotNull() & F.col("bloom_0").isNotNull()
    for i, bit in enumerate(_bloom_bits(key)):
        hit = hit & (F.col(f"bloom_{i}").bitwiseAND(bit) != 0)
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(
        "bloom_block", *[f"bloom_{i}" for i in range(BLOOM_WORDS)])
