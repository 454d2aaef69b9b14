"""SimHash near-duplicates by vantage-point trees.

Fingerprints are dealt to the leaves of a vantage-point tree by Hamming
distance; those near a branch's boundary also visit the other branch
(triangle bounds); leaves are searched exactly; and linked fingerprints are
contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectspark.llm.common import materialize, rest_key, spread_keys, text_key
from aspectspark.session import ship_package

SHINGLE = 3
MAX_BITS = 3
SEED = 42

#: Fingerprints the tree is built from: so many, or 16 per leaf where that is
#: more, up to the last number (2 MB on the driver; enough for leaves of
#: ``LEAF`` up to 10^9 fingerprints).  Their distances to the vantage points
#: set the boundaries.  A bound on the driver's work, not on the search: all
#: fingerprints are dealt and compared.
SAMPLE = 1 << 14
LARGEST_SAMPLE = 1 << 18

#: Fingerprints that live in a leaf on average, and members (visitors too)
#: of a block, in pairs of which larger leaves are searched.  Distances
#: between unrelated fingerprints lie close together, so every level of the
#: tree adds visitors: a leaf is as large as a task can search in seconds.
LEAF = 1 << 15
BLOCK = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes (no word: 0)."""
    from xxhash import xxh64_intdigest

    # of bytes, lower() changes A-Z alone and split() knows ASCII white space alone
    words = text.encode().lower().split()
    if not words:
        return 0
    rolled = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)]))) or [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in rolled), dtype=np.uint64, count=len(rolled))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(rolled), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, text key and fingerprint (as a signed long) of every row."""
    ship_package(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("id", *text_key(F.col("text")), "text")
    fields = [keyed.schema["id"], keyed.schema["t1"], keyed.schema["t2"], T.StructField("fp", T.LongType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(3)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))],
                                             names=["id", "t1", "t2", "fp"])

    return keyed.mapInArrow(scan, T.StructType(fields))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


class Branch(NamedTuple):
    """Points within ``radius`` of ``vantage`` go inside, others outside;
    a leaf has neither and a number."""

    vantage: np.uint64 | None
    radius: int
    inside: Branch | None
    outside: Branch | None
    leaf: int


def grow(points: np.ndarray, depth: int, numbers: Iterator[int], seed: int = 0) -> Branch:
    """Tree over a sample: of a few candidates the vantage point whose median
    ball leaves the fewest points near its boundary."""
    if depth > 0 and len(points) > 1:
        rng = np.random.default_rng(seed + depth)
        best = None
        for vantage in points[rng.permutation(len(points))[:24]]:
            d = distances(points, vantage)
            radius = int(np.median(d))
            inside = d <= radius
            if inside.all():
                radius -= 1
                inside = d <= radius
            share = inside.mean()
            near = ((d > radius - MAX_BITS) & (d <= radius + MAX_BITS)).mean()
            if 0 < share < 1 and (best is None or near + abs(share - 0.5) < best[0]):
                best = (near + abs(share - 0.5), vantage, radius, inside)
        if best:
            _, vantage, radius, inside = best
            return Branch(vantage, radius, grow(points[inside], depth - 1, numbers, 2 * seed + 1),
                          grow(points[~inside], depth - 1, numbers, 2 * seed + 2), -1)
    return Branch(None, 0, None, None, next(numbers))


def deal(tree: Branch, points: np.ndarray, home: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, points, home) of all leaves that points live in or visit.

    Two points within ``bits`` of each other that part at a boundary lie
    within ``bits`` of it, so the inner one visits the outside, and a
    visitor follows every branch that the bounds leave open.
    """
    if not len(points):
        return
    if tree.vantage is None:
        yield tree.leaf, points, home
        return
    d = distances(points, tree.vantage)
    inner = d <= tree.radius
    go_in = np.where(home, inner, d <= tree.radius + bits)
    yield from deal(tree.inside, points[go_in], home[go_in], bits)
    go_out = np.where(home, ~inner, d > tree.radius - bits) | (home & inner & (d > tree.radius - bits))
    yield from deal(tree.outside, points[go_out], (home & ~inner)[go_out], bits)


def merge_close(points: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """For each point the smallest index of the points it is linked to,
    directly or through others; pairs of two visitors are not looked at.

    Points are sorted by their distance to one of them: partners lie within
    ``bits`` of each other there, so a block is compared with a narrow band.
    """
    d = distances(points, points[0])
    order = np.argsort(d, kind="stable")
    points, d = points[order], d[order]
    own = np.flatnonzero(home[order])
    label = np.arange(len(points))
    for at in range(0, len(own), 64):
        rows = own[at:at + 64]
        low = np.searchsorted(d, d[rows[0]] - bits, side="left")
        high = np.searchsorted(d, d[rows[-1]] + bits, side="right")
        near = np.bitwise_count(points[rows, None] ^ points[None, low:high]) <= bits
        i, j = np.nonzero(near)
        pairs = np.unique(np.stack([label[rows[i]], label[low + j]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            continue
        root = {int(x): int(x) for x in np.unique(pairs)}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in pairs.tolist():
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        to = np.arange(len(points))
        for x in root:
            to[x] = find(x)
        label = to[label]
    out = np.empty(len(points), dtype=np.int64)
    out[order] = order[label]
    return out


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect the
    same ones as all pairs within ``bits`` bits do: in each leaf a star per
    group, never all pairs of a group."""
    spark = prints.sparkSession
    ship_package(spark)
    total = prints.count()
    # by hash, so reruns agree; the first condition keeps what tasks send small
    order = F.xxhash64("fp", F.lit(11))
    size = min(LARGEST_SAMPLE, max(SAMPLE, 16 * (total // LEAF)))
    some = F.shiftrightunsigned(order, 32) < min(1.0, 2 * size / max(1, total)) * 2**32
    sample = [r[0] for r in prints.select("fp").where(some).orderBy(order, "fp").limit(size).collect()]
    depth = max(0, min((total // LEAF).bit_length(), (len(sample) // 8).bit_length() - 1))
    tree = spark.sparkContext.broadcast(grow(np.array(sample, dtype=np.int64).view(np.uint64), depth, iter(range(1 << 30))))

    def to_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for leaf, some, home in deal(tree.value, points, np.ones(len(points), dtype=bool), bits):
                yield pd.DataFrame({"leaf": leaf, "fp": some.view(np.int64), "home": home})

    dealt = materialize(prints.select("fp").mapInPandas(to_leaves, "leaf int, fp long, home boolean"), "simhash-leaves")
    # a leaf above BLOCK is searched in pairs of blocks
    sizes = dealt.groupBy("leaf").count().select(
        "leaf", F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int").alias("parts"))
    parted = dealt.join(F.broadcast(sizes), "leaf").withColumn(
        "part", F.pmod(F.xxhash64("fp", F.lit(13)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = parted.withColumn("other", other).select(
        "leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", "home")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64)
        first = merge_close(points.view(np.uint64), frame["home"].to_numpy(bool), bits)
        linked = first != np.arange(len(first))
        return pd.DataFrame({"a": points[linked], "b": points[first[linked]]})

    return paired.groupBy("leaf", "p", "q").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the same for all nodes that edges (a, b)
    connect).

    Every round points each node at its smallest neighbour, follows the
    pointers twice, and keeps the edges between different targets; each
    round at least halves the nodes that have edges, so rounds grow with the
    logarithm.  Rounds are written, so lineage stays short.
    """
    edges = materialize(edges.where("a <> b").distinct(), "links-0")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found, turn = nodes.select("node", F.col("node").alias("root")), 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), f"links-up-{turn}")
        top = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        jump = materialize(up.join(spread_keys(top, [F.xxhash64("up", F.lit(3))]), "up").select(F.col("a").alias("x"), F.col("top").alias("to")),
                           f"links-jump-{turn}")
        a_to, b_to = (jump.select(F.col("x").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = edges.join(a_to, "a").join(b_to, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        found = materialize(found.join(jump, found["root"] == jump["x"], "left").select(
            "node", F.coalesce("to", "root").alias("root")), f"links-root-{turn}")
        edges = materialize(moved.where("a <> b").distinct(), f"links-{turn}")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bits: int = MAX_BITS) -> DataFrame:
    """id, t1, t2 (key of the text), fp and component of every row; rows are
    in one component if fingerprints within ``bits`` bits connect them, and
    it is named by ``first``: its smallest (id, t1, t2), null ids last.

    Texts without words (null, empty) have fingerprint 0 and link like any
    other.  Rows with equal fingerprints, however many, are one fingerprint
    in the search.  Columns beyond the two named are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2"))
    prints = materialize(rows.groupBy("fp").agg(least.alias("first")), "simhash-prints")
    found = components(links(prints, bits))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("component"))
    firsts = rooted.groupBy("component").agg(F.min("first").alias("first"))
    named = rooted.drop("first").join(spread_keys(firsts, [F.xxhash64("component", F.lit(3))]), "component")
    return rows.join(spread_keys(named, [F.xxhash64("fp", F.lit(3))]), "fp").select("id", "t1", "t2", "fp", "component", "first")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that with the smallest id (null
    last, then by text); of rows of one id and text one stays.  Other columns
    may have any type and are never sorted."""
    first = near_duplicates(docs, id_col, text_col, **options).select("first.*").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"),
                       *text_key(F.coalesce(F.col(text_col), F.lit(""))), rest_key(docs, [id_col, text_col]).alias("rest"))
    # rows of one id and text: that with the least hash of its other columns
    elected = rows.groupBy("id", "t1", "t2").agg(F.min("rest").alias("r"), F.count("*").alias("n"))
    null_safe = F.col("id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b"))
    keys = first.select(F.col("id").alias("i"), F.col("t1").alias("a"), F.col("t2").alias("b"))
    kept = elected.join(spread_keys(keys, [F.col("a")]), null_safe, "left_semi").select(
        F.col("id").alias("i"), F.col("t1").alias("a"), F.col("t2").alias("b"), "r", "n")
    own = rows.join(spread_keys(kept, [F.xxhash64("a", F.lit(3))]), null_safe & (F.col("rest") == F.col("r")))
    # equal rows are interchangeable
    one = own.where("n > 1").groupBy("id", "t1", "t2").agg(F.first("doc").alias("doc"))
    return own.where("n = 1").select("doc.*").unionByName(one.select("doc.*"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
