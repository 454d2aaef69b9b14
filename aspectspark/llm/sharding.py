"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots that never change; the bytes of
each slot are added up; a versioned table maps slots to shards.  Rebalancing
edits the map: most slots stay where they are, and no record is hashed anew.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectspark.llm.common import materialize, spread_keys

#: Virtual slots.  Their number stays for the life of a data set, and bounds
#: every table of slots below.
SLOTS = 4096

#: Bytes that a record takes besides its text.
OVERHEAD = 8

#: A shard keeps its slots up to so much more than an even share.
SLACK = 0.02

#: Equal records that one task numbers at once.
CHUNK = 4096


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("digest")]


def slot_of(copy: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: by its id, text and number among equals."""
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", copy.cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") % slots).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32, digest, copy and virtual_slot of every row.

    Rows of one id and text are numbered (``copy``), so a group of them,
    however large, fills many slots.  They are counted before they are
    shuffled and dealt in chunks when they come apart again.
    """
    same = docs.select(*_keys(id_col, text_col)).groupBy("id", "size", "text_crc32", "digest").agg(F.count("*").alias("n"))
    few = same.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    last = F.floor((F.col("n") - 1) / CHUNK)
    many = same.where(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = spread_keys(many, [F.xxhash64("chunk", "digest")]).withColumn("copy", F.explode(F.sequence(
        F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))).drop("chunk")
    return few.unionByName(many).drop("n").withColumn("virtual_slot", slot_of(F.col("copy"), slots))


def slot_sizes(placed: DataFrame) -> DataFrame:
    """virtual_slot, bytes and rows: at most one row per slot."""
    return placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(freed: Column, loads: Column) -> Column:
    """Shards of the ``freed`` slots in order: each goes to the shard with
    the fewest bytes so far (ties: the smallest number)."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def put(held: Column, one: Column) -> Column:
        at = F.array_position(held["loads"], F.array_min(held["loads"])).cast("int") - 1
        return F.struct(F.transform(held["loads"], lambda x, i: F.when(i == at, x + one["bytes"]).otherwise(x)).alias("loads"),
                        F.concat(held["shards"], F.array(at)).alias("shards"))

    return F.aggregate(freed, start, put)["shards"]


def edited_map(sizes: DataFrame, n_shards: int, current: DataFrame | None = None, slots: int = SLOTS,
               slack: float = SLACK) -> DataFrame:
    """The next version of a slot map: version, virtual_slot, shard.

    A shard of the current map keeps its largest slots as long as they fit
    into an even share of all bytes and ``slack``; slots beyond that, and
    those of shards that are no more, are dealt to the shards with the
    fewest bytes, largest first.  Without a current map all slots are dealt.
    Slots without a record stay where they are, or go round by number.  All
    tables here have a row per slot at most.
    """
    spark = sizes.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    known = every.join(F.broadcast(sizes.select("virtual_slot", "bytes")), "virtual_slot", "left")
    if current is None:
        known = known.withColumns({"held": F.lit(None).cast("int"), "version": F.lit(0)})
    else:
        held = current.select("virtual_slot", F.col("shard").alias("held"), "version")
        known = known.join(F.broadcast(held), "virtual_slot", "left").withColumn(
            "held", F.when(F.col("held") < n_shards, F.col("held")))
    version = (F.coalesce(F.max("version").over(Window.partitionBy()), F.lit(0)) + 1).cast("int")
    even = F.coalesce(F.sum("bytes").over(Window.partitionBy()), F.lit(0)) / n_shards
    before = Window.partitionBy("held").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    fits = F.col("held").isNotNull() & (F.sum("bytes").over(before) <= F.col("even") * (1 + slack))
    known = known.withColumns({"version": version, "even": even}).withColumn("stays", fits)
    # one row: what each shard keeps, and the slots to deal
    load = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("held") == s), F.col("bytes"))), F.lit(0)).cast("long")
            for s in range(n_shards)] if current is not None else [F.lit(0).cast("long")] * n_shards
    open_ = F.col("bytes").isNotNull() & ~F.coalesce("stays", F.lit(False))
    freed = F.array_sort(F.collect_list(F.when(open_, F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes"))))
    one = known.groupBy().agg(freed.alias("freed"), F.array(*load).alias("loads")).select(
        "freed", _dealt(F.col("freed"), F.col("loads")).alias("shards"))
    dealt = one.select(F.posexplode("freed").alias("at", "slot"), "shards").select(
        F.col("slot.virtual_slot").alias("virtual_slot"), F.get("shards", F.col("at")).alias("dealt"))
    round_ = F.coalesce("held", F.col("virtual_slot") % n_shards)
    return known.join(F.broadcast(dealt), "virtual_slot", "left").select(
        "version", "virtual_slot", F.coalesce("dealt", round_).cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Append a version to the stored map, and read it back."""
    slot_map.write.mode("append").parquet(path)
    return stored_map(slot_map.sparkSession, path, slot_map.first()["version"])


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the latest by default."""
    table = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    wanted = table.agg(F.max("version")).first()[0] if version is None else version
    return table.where(F.col("version") == wanted)


def place(placed: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """The records with version, shard, and ``slot``, their place in the
    shard, without gaps from 0: slots by number, records by id.

    Places are counted per virtual slot, so no task ranks a whole shard.
    """
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(F.broadcast(sizes), "virtual_slot").select(
        "version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("start"))
    inner = Window.partitionBy("virtual_slot").orderBy(F.asc_nulls_last("id"), "digest", "copy")
    ranked = placed.withColumn("nth", F.row_number().over(inner) - 1)
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn(
        "slot", (F.col("start") + F.col("nth")).cast("long")).drop("start", "nth")


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    slots: int = SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """id, size (UTF-8 bytes of the text and 8), text_crc32, digest, copy,
    virtual_slot, version, shard and slot of every row.

    Without a ``slot_map`` a first one is made, by which the shards hold
    nearly equal bytes as far as single records allow.  A null text counts
    as an empty one; a null id is an id of its own; equal rows are numbered
    and spread like other rows.  Columns beyond the two named are not read.
    An empty table gives no rows.
    """
    placed = materialize(records(docs, id_col, text_col, slots), "shard-records")
    sizes = materialize(slot_sizes(placed), "shard-slots")
    if slot_map is None:
        slot_map = materialize(edited_map(sizes, n_shards, slots=slots), "shard-map")
    return place(placed, slot_map, sizes)


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 slots: int = SLOTS) -> None:
    """Write whole rows, all columns, into one folder ``shard=N`` per shard.

    Rows of one id and text are numbered within the part of the input that
    they come from and then across parts, so a large group of them is many
    tasks' work; the shuffle deals by virtual slot.
    """
    keys = ["id", "digest"]
    kept = materialize(docs.select(F.struct("*").alias("doc"), *_keys(id_col, text_col),
                                   F.monotonically_increasing_id().alias("row")), "shard-rows")
    part = F.shiftright("row", 33)
    narrow = kept.select(*keys, "row", part.alias("part"))
    counts = narrow.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    repeated = counts.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").select(
        *[F.col(k).alias(f"of_{k}") for k in keys])
    on = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col("part").alias("of_part"), "start")
    many = narrow.join(spread_keys(repeated, [F.xxhash64("of_digest", F.lit(3))]), on, "left_semi").withColumn(
        "nth", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row")) - 1)
    copies = many.join(starts, on & (F.col("part") == F.col("of_part"))).select(
        F.col("row").alias("of_row"), (F.col("start") + F.col("nth")).alias("copy"))
    numbered = kept.join(copies, F.col("row") == F.col("of_row"), "left")
    slotted = numbered.withColumn("virtual_slot", slot_of(F.coalesce("copy", F.lit(0)), slots))
    dealt = slotted.join(F.broadcast(slot_map.select("virtual_slot", F.col("shard").alias("to_shard"))), "virtual_slot")
    named = dealt.repartition("virtual_slot").select("doc.*", F.col("to_shard").alias("shard"))
    if "shard" in docs.columns:
        raise ValueError("the rows have a column shard, which names the folders")
    named.write.partitionBy("shard").parquet(path)
