"""Hard negatives by an STR-packed R-tree.

Vectors are sorted and tiled recursively, coordinate by coordinate, into
pages; a page is tiled the same way into leaves.  Pages are written, each one
row with its entries and the minimum bounding boxes of itself and its leaves.
A box gives an interval of inner products with a query: per coordinate the
query's component times the box's near and far side.  A query opens the pages
whose interval meets one of its score windows and reaches the k-th best score
known so far, and walks a page's tree best-first by the same two tests.

Components are integers, so sums are exact and ties are real ties.
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

#: Vectors that the tiles of the upper levels are cut from at most.  All
#: vectors are packed; the sample sets only where tiles end.
SAMPLE = 16_384

#: Entries of a page, of a leaf, leaves of an inner box, pages of a
#: directory node, and queries of a block.
PAGE = 4096
LEAF = 64
FAN = 8
NODE = 1024
BLOCK = 1024

#: Coordinates that are cut, those of the largest variance.
CUTS = 3

#: Bounds of a window that is open at a side, beyond all scores.
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Cut(NamedTuple):
    """A slab boundary list along a coordinate, and what lies in the slabs;
    a tile has a number instead."""

    coordinate: int
    bounds: np.ndarray | None
    slabs: tuple
    tile: int


def tiles(points: np.ndarray, capacity: float, numbers: Iterator[int], coordinates: list[int] | None = None) -> Cut:
    """Sort-tile-recursive cuts: with p tiles to make and c coordinates left,
    the first is cut into p^(1/c) slabs of equally many points."""
    if coordinates is None:
        coordinates = np.argsort(-points.var(axis=0), kind="stable")[:CUTS].tolist() if len(points) else []
    wanted = int(np.ceil(len(points) / capacity))
    if wanted <= 1 or not coordinates:
        return Cut(0, None, (), next(numbers))
    along = points[:, coordinates[0]]
    slabs = int(np.ceil(wanted ** (1 / len(coordinates))))
    bounds = np.unique(np.sort(along)[[len(along) * i // slabs for i in range(1, slabs)]])
    own = np.searchsorted(bounds, along, side="right")
    return Cut(coordinates[0], bounds, tuple(tiles(points[own == i], capacity, numbers, coordinates[1:])
                                             for i in range(len(bounds) + 1)), -1)


def tile_of(cut: Cut, points: np.ndarray) -> np.ndarray:
    if cut.bounds is None:
        return np.full(len(points), cut.tile, dtype=np.int64)
    own = np.searchsorted(cut.bounds, points[:, cut.coordinate], side="right")
    out = np.empty(len(points), dtype=np.int64)
    for i, slab in enumerate(cut.slabs):
        out[own == i] = tile_of(slab, points[own == i])
    return out


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T``, exactly: in doubles if no sum can leave their
    integers, in Python's integers otherwise."""
    size = max(1, left.shape[1])
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * size
    if most < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(object) @ right.astype(object).T


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with each box: a
    positive component takes the low and the high side, a negative one the
    high and the low."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _boxes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not points.shape[1]:
        return np.zeros((len(starts), 0), dtype=np.int64), np.zeros((len(starts), 0), dtype=np.int64)
    return np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)


class Page:
    """Entries in leaf order with the boxes of leaves and of inner nodes."""

    def __init__(self, row: dict, width: int):
        def numbers(name: str) -> np.ndarray:
            return np.frombuffer(row[name], dtype=np.int64)

        self.ids, self.labels, self.starts = numbers("ids"), numbers("labels"), numbers("starts")
        self.points = numbers("points").reshape(len(self.ids), width)
        self.ends = np.append(self.starts[1:], len(self.ids))
        self.leaves = _boxes(self.points, self.starts)
        self.first = np.arange(0, len(self.starts), FAN)
        self.inner = np.minimum.reduceat(self.leaves[0], self.first), np.maximum.reduceat(self.leaves[1], self.first)


def packed(frame: pd.DataFrame, width: int) -> dict:
    """One page of entries: sorted into leaves by the same tiling."""
    points = matrix(frame["v"], width)
    leaf = tile_of(tiles(points, LEAF, iter(range(1 << 30))), points)
    order = np.lexsort((frame["row"], leaf))
    points, leaf = points[order], leaf[order]
    starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]).astype(np.int64)
    labels = frame["label"].to_numpy(np.int64)[order]
    return {"ids": frame["id"].to_numpy(np.int64)[order].tobytes(), "labels": labels.tobytes(),
            "points": points.tobytes(), "starts": starts.tobytes(), "low": points.min(axis=0), "high": points.max(axis=0),
            "label_set": np.unique(labels)}


def _suits(labels: np.ndarray, label: int, same: bool) -> np.ndarray:
    return (labels == label) == same


def best_first(page: Page, query: np.ndarray, label: int, own: int, windows: list[list[int]], k: int, same: bool,
               spans: tuple) -> list[list[tuple[int, int]]]:
    """Per window (low, high, bound) the ``k`` best (-score, id) among the
    page's entries of the same (or of another) label and another id.

    The queue holds inner nodes and leaves by their largest inner product.  A
    node goes if its interval misses a window or lies strictly below the
    window's k-th best score, for every window; ties at the k-th stay, as
    smaller ids win them.
    """
    inner_low, inner_high, leaf_low, leaf_high = spans
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    least = [max(low, bound) for low, _, bound in windows]

    def open_(low: int, high: int) -> bool:
        return any(high >= floor and low <= w[1] for floor, w in zip(least, windows))

    queue = [(-inner_high[i], False, i) for i in range(len(page.first)) if open_(inner_low[i], inner_high[i])]
    heapq.heapify(queue)
    while queue:
        top, is_leaf, at = heapq.heappop(queue)
        if not any(-top >= floor for floor in least):
            break  # nothing behind it reaches higher
        if not is_leaf:
            for leaf in range(page.first[at], min(page.first[at] + FAN, len(page.starts))):
                if open_(leaf_low[leaf], leaf_high[leaf]):
                    heapq.heappush(queue, (-leaf_high[leaf], True, leaf))
            continue
        if not open_(leaf_low[at], -top):
            continue
        rows = slice(page.starts[at], page.ends[at])
        fits = _suits(page.labels[rows], label, same) & (page.ids[rows] != own)
        if not fits.any():
            continue
        score = products(query[None, :], page.points[rows][fits])[0]
        ids = page.ids[rows][fits]
        for i, (_, high, _) in enumerate(windows):
            inside = (score >= least[i]) & (score <= high)
            if inside.any():
                best[i] = heapq.nsmallest(k, best[i] + list(zip((-score[inside]).tolist(), ids[inside].tolist())))
                if len(best[i]) == k:
                    least[i] = max(least[i], -best[i][-1][0])
    return best


def _entries(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """row (a number of its own), id, label and v, the scaled components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("v"))


def _pages(entries: DataFrame, total: int, width: int) -> DataFrame:
    """The tree's pages: node, page, the packed entries and their box."""
    spark = entries.sparkSession
    sample = entries.orderBy(F.xxhash64("row", F.lit(17)), "row").limit(SAMPLE).toPandas()
    points, labels = matrix(sample["v"], width), sample["label"].to_numpy(np.int64)
    capacity, numbers = max(8.0, PAGE * len(sample) / total), iter(range(1 << 30))
    # a label that fills a page has tiles of its own; the others share theirs
    names, counts = np.unique(labels, return_counts=True)
    own = {int(n): tiles(points[labels == n], capacity, numbers) for n, c in zip(names, counts) if c >= capacity / 2}
    rest = tiles(points[~np.isin(labels, list(own))], capacity, numbers)
    cuts = spark.sparkContext.broadcast((own, rest))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rest = cuts.value
        for frame in frames:
            points, labels = matrix(frame["v"], width), frame["label"].to_numpy(np.int64)
            tile = tile_of(rest, points)
            for label in np.unique(labels):
                if label in own:
                    tile[labels == label] = tile_of(own[label], points[labels == label])
            yield frame.assign(tile=tile)

    tiled = materialize(entries.mapInPandas(assign, "row long, id long, label long, v array<long>, tile long"), "negative-tiles")
    # a tile that outgrew a page is several pages
    parts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("parts"))
    parted = tiled.join(spread_keys(parts, [F.xxhash64("tile", F.lit(3))]), "tile").withColumn(
        "part", F.pmod(F.xxhash64("row", F.lit(19)), F.col("parts")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"page": int(frame["tile"].iloc[0]) << 24 | int(frame["part"].iloc[0]), **packed(frame, width)}])

    schema = ("page long, ids binary, labels binary, points binary, starts binary, low array<long>, high array<long>, "
              "label_set array<long>")
    pages = parted.select("tile", "part", "row", "id", "label", "v").groupBy("tile", "part").applyInPandas(pack, schema)
    return materialize(pages, "negative-pages")


class _Tree(NamedTuple):
    pages: DataFrame
    nodes: int
    width: int


def _opened(tree: _Tree, asks: DataFrame, blocks: int, same: bool, first: bool) -> DataFrame:
    """page, block and the asks that open the page; if ``first``, each asks
    only the page of each directory node that reaches highest.

    The directory is the boxes of the pages, dealt to nodes; a node meets
    every block of asks, so a task holds one node and one block.
    """
    boxes = tree.pages.select("page", "low", "high", "label_set", F.pmod(F.xxhash64("page"), F.lit(tree.nodes)).alias("node"))
    boxes = boxes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asks.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tree.nodes - 1).cast("long"))))
    width = tree.width

    def look(boxes: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(boxes) and len(asking):
            queries = matrix(asking["v"], width)
            least, most = intervals(queries, matrix(boxes["low"], width), matrix(boxes["high"], width))
            only = np.array([s[0] if len(s) == 1 else None for s in boxes["label_set"]], dtype=object)
            among = [set(map(int, s)) for s in boxes["label_set"]]
            for i, (ask, label, lows, highs, bounds) in enumerate(zip(
                    asking["ask"], asking["label"], asking["lows"], asking["highs"], asking["bounds"])):
                meets = np.zeros(len(boxes), dtype=bool)
                for low, high, bound in zip(lows, highs, bounds):
                    meets |= (most[i] >= max(low, bound)) & (least[i] <= high)
                fits = np.array([label in s for s in among]) if same else only != label
                at = np.flatnonzero(meets & fits)
                if first and len(at):
                    at = at[[int(np.argmax(most[i][at]))]]
                found.append(pd.DataFrame({"page": boxes["page"].to_numpy()[at], "ask": ask}))
        return pd.concat(found) if found else pd.DataFrame({"page": [], "ask": []})

    keys = ["node", "block"]
    return boxes.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(look, "page long, ask long")


def _search(tree: _Tree, asks: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
    """ask, window, rank, id and score of the ``k`` best entries of each
    window of each ask (ask, id, label, v, lows, highs, bounds), from all
    pages that the ask opens.  An ask is copied to those pages alone, and a
    page to the blocks of asks that open it."""
    total = asks.count()
    blocks = max(1, -(-total // BLOCK))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("ask", F.lit(23)), F.lit(blocks)).cast("int"))
    opened = materialize(_opened(tree, asks, blocks, same, first), "negative-opened")
    asking = opened.join(asks, "ask")
    visits = opened.withColumn("block", F.pmod(F.xxhash64("ask", F.lit(23)), F.lit(blocks)).cast("int")).select(
        "page", "block").distinct()
    entries = tree.pages.select("page", "ids", "labels", "points", "starts").join(visits, "page")
    width = tree.width

    def search(entries: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(asking):
            page = Page(entries.iloc[0], width)
            queries = matrix(asking["v"], width)
            spans = [*intervals(queries, *page.inner), *intervals(queries, *page.leaves)]
            for i, r in enumerate(asking.itertuples()):
                windows = [list(map(int, w)) for w in zip(r.lows, r.highs, r.bounds)]
                best = best_first(page, queries[i], r.label, r.id, windows, k, same, tuple(s[i] for s in spans))
                found += [(r.ask, w, -score, id_) for w, some in enumerate(best) for score, id_ in some]
        return pd.DataFrame(found, columns=["ask", "window", "score", "id"])

    keys = ["page", "block"]
    some = entries.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(
        search, "ask long, window int, score long, id long")
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounded(asks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The asks with the k-th best score that each window has so far."""
    kth = found.where(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    joined = asks.join(spread_keys(kth.withColumnRenamed("ask", "of"), [F.xxhash64("of", F.lit(3))]), F.col("ask") == F.col("of"), "left")
    bounds = F.transform("bounds", lambda b, i: F.coalesce(F.when(F.col("kth").isNotNull(), F.try_element_at("kth", i)), b))
    return joined.withColumn("bounds", bounds).drop("kth", "of")


def _nearest(tree: _Tree, asks: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """One look at the most promising pages sets the bounds, the next one
    opens all pages that can still matter."""
    asks = materialize(asks, f"{name}-asks")
    bounded = materialize(_bounded(asks, _search(tree, asks, k, same, True), k), f"{name}-bounds")
    return materialize(_search(tree, bounded, k, same, False), name)


def _percent(score: Column, share: int) -> Column:
    """Floor of a share in percent, in integers that stay in range."""
    rest = F.pmod(score, F.lit(100))
    return F.call_function("div", score - rest, F.lit(100)) * share + F.call_function("div", rest * share, F.lit(100))


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                        high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score: for each of an anchor's nearest ``positives`` of its own
    label, the nearest ``negatives`` of other labels whose score is between
    ``low`` and ``high`` percent of the positive's.

    Scores are inner products of the components, each ``floor(scale * x)``;
    higher ones come first, ties go to the smaller id; scores beyond 62 bits
    are an error.  ``is_anchor`` is a
    condition on ``id``.  Rows without an id, a label or a vector, or with a
    null or non-finite component, take no part.  Rows of one id are entries
    of their own, and none of them is another's positive or negative; equal
    anchors and equal positives have their rows of the result each.  Shorter
    vectors count as filled up with zeros.  A negative positive's window is
    empty.  Columns beyond the three named are not read; an empty table, or
    one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    entries = materialize(_entries(vectors, id_col, vector_col, label_col, scale), "negative-entries")
    shape = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    pages = _pages(entries, shape["n"], shape["width"])
    tree = _Tree(pages, max(1, -(-pages.count() // NODE)), shape["width"])

    one = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("lows", LOWEST), ("highs", HIGHEST), ("bounds", LOWEST))]
    anchors = entries.where(is_anchor).select(F.col("row").alias("ask"), "id", "label", "v", *one)
    found = _nearest(tree, anchors, positives, True, "negative-positives")

    # a window per positive, numbered by its rank
    scores = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    windows = found.groupBy("ask").agg(scores.alias("positives"))
    asked = anchors.select("ask", "id", "label", "v").join(
        spread_keys(windows.withColumnRenamed("ask", "of"), [F.xxhash64("of", F.lit(3))]), F.col("ask") == F.col("of")).drop("of")
    asked = materialize(asked, "negative-windows")

    def bottom(p: Column) -> Column:  # rounded up
        return -_percent(-p["score"], low)

    def top(p: Column) -> Column:
        return _percent(p["score"], high)

    asks = asked.select("ask", "id", "label", "v", F.transform("positives", bottom).alias("lows"),
                        F.transform("positives", top).alias("highs"),
                        F.transform("positives", lambda p: F.lit(LOWEST).cast("long")).alias("bounds"))
    mined = _nearest(tree, asks, negatives, False, "negative-mined")
    named = asked.select(F.col("ask").alias("of"), F.col("id").alias("anchor_id"), "positives")
    joined = mined.join(spread_keys(named, [F.xxhash64("of", F.lit(3))]), F.col("ask") == F.col("of"))
    own = F.get("positives", F.col("window"))
    return joined.select("anchor_id", own["id"].alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"),
                         own["score"].alias("positive_score"), F.col("score").alias("negative_score"))
