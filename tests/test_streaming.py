"""Streaming inference equals the batch cascade on the same records."""

import os
import tempfile

from pyspark.sql import functions as F

from aspectspark.plans.cascade import cascade_predict, default_scorers
from aspectspark.sources import corpus as io
from aspectspark.streaming import stream_predictions
from tests.conftest import SF001


def test_stream_matches_batch(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("sentence_form"),
        F.array().cast("array<struct<aspect:string,span:string,polarity:string>>")
        .alias("annotation"))
    root = tempfile.mkdtemp(prefix="stream-")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    # all documents, arriving as two files
    io.write_corpus(docs.filter(F.col("id").cast("int") % 2 == 0), src + "/a")
    io.write_corpus(docs.filter(F.col("id").cast("int") % 2 == 1), src + "/b")
    start = lambda: stream_predictions(spark, src + "/*", out, os.path.join(root, "ckpt"),
                                       default_scorers())
    start().awaitTermination(300)
    epochs = sorted(os.listdir(out))
    start().awaitTermination(300)       # a restart goes on: nothing is read again
    assert sorted(os.listdir(out)) == epochs
    got = io.read_predictions(spark, out + "/*")
    want = cascade_predict(docs.select("id", "sentence_form"))
    key = lambda r: (r.id, [(a.aspect, a.polarity) for a in r.annotation])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_cascade_stage_counts_in_one_pass(spark):
    import duckdb

    from aspectspark import oracle

    # Observations get their own session: once one is used, Spark ML model
    # transforms in the same session fail to serialize (Spark 4.1.2).
    spark = spark.newSession()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("sentence_form"))
    obs = {}
    cascade_predict(docs, observations=obs).write.format("noop").mode("overwrite").save()
    got = {k: o.get["n"] for k, o in obs.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    base = oracle.W(oracle.cascade_sql(False))
    want = {n: con.sql(base + f"SELECT count(*) FROM {t}").fetchall()[0][0]
            for n, t in (("stage0", "d"), ("stage1", "need1"), ("stage2", "cats"),
                         ("stage3", "asp"))}
    assert got == want
