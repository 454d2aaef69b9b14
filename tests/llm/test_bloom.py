"""Bloom filters that follow the number of keys."""

import pytest
from pyspark.sql import functions as F

from aspectspark.llm.common import BLOOM_BLOCKS, BLOOM_KEYS, bloom_blocks, bloom_filter, might_contain


@pytest.mark.parametrize("n", [0, 1, 3000, 10**6])
def test_keys_pass_and_misses_do_not(spark, n):
    keys = spark.range(n).select(F.col("id").alias("key"))
    rows = spark.range(n, n + 200_000).union(spark.range(n)).select("id")
    bloom = bloom_filter(keys, "key")
    assert bloom.frame.count() <= bloom.blocks <= max(1, 2 * -(-n // BLOOM_KEYS))
    found = might_contain(rows, bloom, F.col("id"), "maybe").where("maybe")
    assert found.where(F.col("id") < n).count() == n
    assert found.where(F.col("id") >= n).count() <= 200_000 * 0.005


def test_size_has_a_bound_and_null_is_no_key(spark):
    assert [bloom_blocks(n) for n in (0, 40, 41, 10**12)] == [1, 1, 2, BLOOM_BLOCKS]
    keys = spark.createDataFrame([(None,), (5,)], "key long")
    rows = spark.createDataFrame([(None, 1), (5, 2), (6, 3)], "id long, n int")
    out = might_contain(rows, bloom_filter(keys, "key"), F.col("id"), "maybe")
    assert out.columns == ["id", "n", "maybe"]
    assert {r.n: r.maybe for r in out.collect()} == {1: False, 2: True, 3: False}
