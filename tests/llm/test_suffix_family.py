"""The family of suffix levels: batches added one by one, its files, its end."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aspectspark.llm import suffixes
from aspectspark.llm.common import text_key
from aspectspark.session import shared_dir, ship_package


@pytest.fixture
def batches(spark):
    ship_package(spark)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(6)]
    texts = [" ".join([*(rng.choice(words) for _ in range(40)), rng.choice(passages), *(rng.choice(words) for _ in range(9))])
             for _ in range(45)]
    return [texts[i::9] for i in range(9)]


def frame(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return df.select(*text_key(F.col("text")), "text")


def found(family):
    return {r.key for r in family.repeats().collect()}


def test_a_batch_added_later_meets_all_before_it(spark, batches):
    family, counts, ranks = suffixes.SuffixFamily(spark, suffixes.LENGTH, suffixes.PREFIX), Counter(), set()
    try:
        for number, texts in enumerate(batches, 1):
            family.add(frame(spark, texts))
            counts.update(int(k) for t in texts for k in suffixes.suffix_runs(t.encode())[0])
            ranks |= {rank for rank, _ in family.levels}
            # levels of 1, 2, 4, 8 batches, all batches in them
            assert sum(2 ** rank for rank, _ in family.levels) == number
            assert found(family) == {k for k, n in counts.items() if n > 1}
        assert ranks == {0, 1, 2, 3} and len(family.levels) == 2
    finally:
        family.drop()


def test_files_stand_in_the_shared_folder_and_go_with_the_family(spark, batches):
    family = suffixes.SuffixFamily(spark, suffixes.LENGTH, suffixes.PREFIX)
    family.add(frame(spark, batches[0]))
    family.add(frame(spark, []))
    places = [spark.table(name).inputFiles() for _, name in family.levels]
    root = shared_dir(spark).removeprefix("file:").lstrip("/")
    assert places[0] and all(f.removeprefix("file:").lstrip("/").startswith(root) for f in places[0])
    names = [name for _, name in family.levels]
    family.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in places[0])


def test_a_run_that_fails_leaves_no_table(spark, monkeypatch):
    def fail(*_):
        raise RuntimeError("stopped")

    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, "some words " * 60) for i in range(3)], "doc_id long, text string")
    for name in ("_removed_spans", "run_rows"):
        with monkeypatch.context() as m:
            m.setattr(suffixes, name, fail)
            with pytest.raises(RuntimeError, match="stopped"):
                suffixes.find_repeats(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
