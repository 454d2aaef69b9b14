"""The registered queries over whole small tables: against their SQL, or
against plain Python where SQL cannot express them."""

import hashlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from aspectspark.llm import queries, sql
from tests.conftest import SF001
from tests.llm import brute

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(sql.SQL) <= set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF001)
    columns = sorted(frame.columns)
    found = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    want = con.sql(sql.SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert found == Counter(tuple(r[i] for i in places) for r in want.fetchall())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sentencepiece(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    found = {r.doc_id: tuple(r)[1:4] for r in queries.op2_sentencepiece(spark, SF001).collect()}
    for i, text in texts:
        ids = library.encode(text)
        assert found[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_nearest(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    found = sorted(tuple(r) for r in queries.op4_nearest(spark, SF001).collect())
    assert found == sorted(brute.nearest(table, lambda i: i % 20 == 0))


def test_mixing(spark):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    by = brute.group(queries.op5_mixing(spark, SF001).collect(), lambda r: sources[r.doc_id])
    names = sorted(by)
    goals = brute.mix_targets([sum(r.size for r in by[s]) for s in names], [1 + i % 3 for i in range(len(names))])
    for name, goal in zip(names, goals):
        assert abs(by[name][0].target - goal) < 1e-6 * goal
        assert abs(sum(r.taken for r in by[name]) - goal) <= 0.1 * goal
        assert all(r.taken <= 3 * r.size for r in by[name])


def test_personal_data(spark, texts):
    found = {r.doc_id: r for r in queries.op6_personal_data(spark, SF001).collect()}
    for i, text in texts:
        base = brute.private_base(text)
        counts = Counter(k for k, *_ in base)
        assert [found[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            counts[k] for k in ("email", "ip", "card", "phone")]
        joined = ",".join(":".join(map(str, s)) for s in base)
        assert found[i].base_sha256 == sha(joined) and found[i].spans.startswith(joined)


def test_licenses(spark, texts):
    found = {r.doc_id: r for r in queries.op7_license_scan(spark, SF001).collect()}
    for i, text in texts:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_suffix_dedup(spark, texts):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, SF001).collect()}
    want = brute.removed_bytes([t for _, t in texts])
    assert found == {i: w for (i, _), w in zip(texts, want)}


def test_simhash(spark, texts):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF001).collect()}
    prints = [brute.simhash(t) for _, t in texts]
    own = brute.components(prints)
    assert found == {i: (f"{prints[k]:016x}", texts[own[k]][0]) for k, (i, _) in enumerate(texts)}


def test_pipeline_stages(spark):
    """Each stage against plain Python on what the one before it kept."""
    import sentencepiece

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    rows, results = [tuple(r) for r in docs.collect()], {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF001), f"test-{name}")
        if name != names[-1]:
            assert out.columns == docs.columns
        results[name], docs = [tuple(r) for r in out.collect()], out

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.QUALITY}) WHERE kept").fetchall()}
    assert sorted(results["quality_rules"]) == sorted(r for r in rows if r[0] in good)

    kept = brute.line_dedup([(r[0], r[1]) for r in results["quality_rules"]])
    assert {(r[0], r[1], r[4]) for r in results["line_dedup"]} == {(i, k, len(k)) for (i, _), k in kept.items()}

    deduped = sorted(results["line_dedup"])
    own = brute.components([brute.simhash(r[1]) for r in deduped])
    assert sorted(results["simhash_near_dedup"]) == [deduped[i] for i in sorted(set(own))]

    once, mixed = set(results["simhash_near_dedup"]), Counter(results["mixing"])
    assert set(mixed) <= once and max(mixed.values()) <= 3
    size = lambda r: len(brute.WORD.findall(r[1]))
    by = brute.group(once, lambda r: r[3])
    sources = sorted(by)
    goals = brute.mix_targets([sum(map(size, by[s])) for s in sources], [1 + i % 3 for i in range(len(sources))])
    for s, goal in zip(sources, goals):
        taken = sum(n * size(r) for r, n in mixed.items() if r[3] == s)
        assert abs(taken - goal) <= max(map(size, by[s])) / 2 + 1

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = Counter()
    for r, n in mixed.items():
        ids = library.encode(r[1])
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += n
    assert Counter(r[:4] for r in results["sentencepiece"]) == want
