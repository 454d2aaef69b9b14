"""The mix comes in training order."""

from aspectspark.llm.mixing import mix
from aspectspark.llm.queries import op5_mixing
from tests.conftest import SF001


def test_mix_is_range_sorted(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(5)
    rows = mix(docs).collect()
    first = [min(r.positions) if r.positions else float("inf") for r in rows]
    assert len(set(first)) > 100 and first == sorted(first)
    again = [r.position for r in op5_mixing(spark, SF001).collect()]
    assert again == [None if f == float("inf") else f for f in first]
