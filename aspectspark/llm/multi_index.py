"""Nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised apart; a cell is a pair of
centroids.  A query first walks the cells by summed centroid score with a
heap until they hold enough entries; the k-th best of these, scored exactly,
bounds the rest of the search: all cells whose score can reach it are
visited, so the k nearest found are the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectspark.llm.common import materialize, spread_keys
from aspectspark.session import ship_package

#: Vectors the centroids are fitted on at most.  All vectors are indexed.
SAMPLE = 20_000

#: Centroids of a half at most, and entries of a cell on average below that.
MAX_CENTROIDS = 256
CELL = 50

#: Parts in which copies of a vector are looked through.
PARTS = 64

#: Entries that the first walk visits, and entries or queries of one block.
FIRST = 500
BLOCK = 4096


class Index(NamedTuple):
    """Centroids of the halves, the largest distance to each, and the
    entries of each cell."""

    left: np.ndarray
    right: np.ndarray
    left_radius: np.ndarray
    right_radius: np.ndarray
    counts: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]


def k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(0)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


def first_cells(index: Index, query: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in order of the summed inner product with their centroids,
    until they hold ``enough`` entries."""
    left, right = index.left @ query[:index.half], index.right @ query[index.half:]
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen, out, held = [(-(left[a[0]] + right[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := int(index.counts[a[i], b[j]]):
            out.append((int(a[i]), int(b[j])))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(left[a[x]] + right[b[y]]), x, y))
    return out


def open_cells(index: Index, query: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Cells that can hold an inner product of ``bound``: the centroids'
    plus what the distances to them can add."""
    q1, q2 = query[:index.half], query[index.half:]
    left = index.left @ q1 + np.linalg.norm(q1) * index.left_radius
    right = index.right @ q2 + np.linalg.norm(q2) * index.right_radius
    reach = left[:, None] + right[None, :] >= bound - 1e-9 * (1 + abs(bound))
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(reach & (index.counts > 0)))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _filled(vector: str, width: int) -> Column:
    """The vector with zeros up to ``width``."""
    return F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row (a number of its own), id and v of every row that takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).select(
        F.monotonically_increasing_id().alias("row"), "id", "v")


def _leading(entries: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows that can be among the ``k`` nearest of any
    query: those of the k + 1 smallest ids, k of each at most.  Copies fall
    out in hashed parts first, so no task holds all copies of a vector."""
    keys = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]
    for part in ([F.pmod(F.xxhash64("row", F.lit(29)), F.lit(PARTS))], []):
        by_id = Window.partitionBy(*keys, *part).orderBy("id")
        own = Window.partitionBy(*keys, *part, "id").orderBy("row")
        entries = entries.withColumns({"nth": F.dense_rank().over(by_id), "copy": F.row_number().over(own)}).where(
            (F.col("nth") <= k + 1) & (F.col("copy") <= k)).drop("nth", "copy")
    return entries


def _fit(entries: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    rows = entries.orderBy(F.xxhash64("id", F.lit(17)), "id", "v").limit(SAMPLE).collect()
    points = np.array([r["v"] for r in rows], dtype=np.float64)
    k = int(min(MAX_CENTROIDS, len(points), max(2, round((total / CELL) ** 0.5))))
    half = max(1, points.shape[1] // 2)
    return k_means(points[:, :half], k), k_means(points[:, half:], k)


def _assign(entries: DataFrame, centres) -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = centres.value
        for frame in frames:
            if not len(frame):
                continue
            points = _matrix(frame["v"])
            p1, p2 = points[:, :left.shape[1]], points[:, left.shape[1]:]
            c1, c2 = nearest_centre(p1, left), nearest_centre(p2, right)
            yield frame.assign(c1=c1, c2=c2, d1=np.linalg.norm(p1 - left[c1], axis=1),
                               d2=np.linalg.norm(p2 - right[c2], axis=1))

    return entries.select("id", "v").mapInPandas(scan, "id long, v array<double>, c1 int, c2 int, d1 double, d2 double")


def _search(cells: DataFrame, queries: DataFrame, blocks: DataFrame, query_parts: int, k: int) -> DataFrame:
    """query (a row number), id and exact score of the k best entries in each
    block of the cells that a query visits, if they reach its bound.

    Entries with one left centroid are dealt to as many blocks as they fill,
    and so are the queries that visit it; an entry is copied to the blocks of
    queries that do, to no others.  No task holds more than a block of each.
    """
    asked = queries.join(F.broadcast(blocks), "c1").withColumn(
        "query_part", F.pmod(F.xxhash64("query", F.lit(23)), F.lit(query_parts)).cast("int"))
    visiting = asked.select(F.col("c1").alias("of"), F.col("query_part").alias("by")).distinct()
    entries = cells.join(F.broadcast(blocks), "c1").withColumn(
        "part", F.pmod(F.xxhash64("id", "c2", F.lit(19)), F.col("parts")).cast("int")).join(
        spread_keys(visiting, [F.xxhash64("of", F.lit(3))]), F.col("c1") == F.col("of")).select(
        "c1", "part", F.col("by").alias("query_part"), "id", "v", "c2")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "c1", "part", "query_part", "query", "own_id", "v", "bound", "visits")

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asking):
            points, wanted = _matrix(own["v"]), _matrix(asking["v"])
            ids, names, own_ids = own["id"].to_numpy(), asking["query"].to_numpy(), asking["own_id"].to_numpy()
            bound, c2 = asking["bound"].to_numpy(np.float64), own["c2"].to_numpy()
            open_ = np.zeros((len(asking), int(c2.max()) + 1), dtype=bool)
            for i, visits in enumerate(asking["visits"]):
                visits = np.asarray(visits)
                open_[i, visits[visits < open_.shape[1]]] = True
            least = bound - 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
            for at in range(0, len(asking), 256):
                rows = slice(at, at + 256)
                near = (wanted[rows] @ points.T >= least[rows, None]) & open_[rows][:, c2]
                q, e = np.nonzero(near & (own_ids[rows, None] != ids[None, :]))
                q += at
                score = np.zeros(len(q))
                for c in range(points.shape[1]):  # in order, so equal vectors score equally
                    score += wanted[q, c] * points[e, c]
                order = np.lexsort((ids[e], -score, q))
                q, e, score = q[order], e[order], score[order]
                start = np.searchsorted(q, q, side="left")
                keep = (np.arange(len(q)) - start < k) & (score >= bound[q])
                found.append(pd.DataFrame({"query": names[q[keep]], "id": ids[e[keep]], "score": score[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "id": [], "score": []})

    keys = ["c1", "part", "query_part"]
    return entries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visits(queries: DataFrame, index, walk) -> DataFrame:
    """A row per query and left centroid: the right centroids it visits."""
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query, own_id, vector, bound in zip(frame["query"], frame["own_id"], frame["v"], frame["bound"]):
                by: dict[int, list[int]] = {}
                for i, j in walk(index.value, np.asarray(vector, dtype=np.float64), bound):
                    by.setdefault(i, []).append(j)
                rows += [(query, own_id, vector, bound, i, js) for i, js in by.items()]
            yield pd.DataFrame(rows, columns=["query", "own_id", "v", "bound", "c1", "visits"])

    return queries.select("query", "own_id", "v", "bound").mapInPandas(
        scan, "query long, own_id long, v array<double>, bound double, c1 int, visits array<int>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col`` and score (inner product) of the ``k``
    nearest entries of each query, other than itself; fewer entries: all.

    ``is_query`` is a condition on ``id`` (the id as a long).  Vectors that
    are null, zero, or hold a null or non-finite component take no part, nor
    do rows without an id; shorter vectors count as filled up with zeros.
    Rows of one id are entries of their own, and none of them is another's
    neighbour; several query rows of one id have a result each.  Ties go to
    the smaller id.  No usable vector: no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = f"query_id long, rank int, {id_col} long, score double"
    entries = materialize(_entries(vectors, id_col, vector_col), "vectors")
    shape = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    entries = entries.withColumn("v", _filled("v", shape["width"]))
    centres = spark.sparkContext.broadcast(_fit(entries, shape["n"]))
    cells = materialize(_assign(_leading(entries, k), centres), "vector-cells")

    left, right = centres.value
    size = cells.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect()
    counts = np.zeros((len(left), len(right)), dtype=np.int64)
    radius = np.zeros(len(left)), np.zeros(len(right))
    for r in size:  # at most MAX_CENTROIDS squared
        counts[r["c1"], r["c2"]] = r["n"]
        radius[0][r["c1"]] = max(radius[0][r["c1"]], r["d1"])
        radius[1][r["c2"]] = max(radius[1][r["c2"]], r["d2"])
    index = spark.sparkContext.broadcast(Index(left, right, *radius, counts))
    blocks = spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(counts.sum(1).tolist()) if n],
                                   "c1 int, parts int")
    queries = entries.where(is_query).select(F.col("row").alias("query"), F.col("id").alias("own_id"), "v",
                                             F.lit(float("-inf")).alias("bound"))
    query_parts = max(1, -(-queries.count() // BLOCK))

    enough = max(FIRST, 4 * k)
    walked = materialize(_visits(queries, index, lambda i, q, _: first_cells(i, q, enough)), "vector-walks")
    bounds = _best(_search(cells, walked, blocks, query_parts, k), k).where(F.col("rank") == k).select(
        F.col("query").alias("of"), F.col("score").alias("kth"))
    bounded = queries.join(spread_keys(bounds, [F.col("kth")]), F.col("query") == F.col("of"), "left").select(
        "query", "own_id", "v", F.coalesce("kth", "bound").alias("bound"))
    visited = materialize(_visits(bounded, index, open_cells), "vector-visits")
    found = _best(_search(cells, visited, blocks, query_parts, k), k)
    named = queries.select(F.col("query").alias("of"), F.col("own_id").alias("query_id"))
    return found.join(spread_keys(named, [F.xxhash64("of", F.lit(3))]), F.col("query") == F.col("of")).select(
        "query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
