"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id, one of ``SLOTS``. Bytes are added up per
slot, and the slots are dealt to the shards: largest first, each to the shard
with the fewest bytes so far. The map from slots to shards is a table with a
version. Rebalancing edits it: a slot stays where it is as long as its shard has
room, and the rest move. Records themselves never move between slots.

A slot with over ``HOT_SHARE`` of a shard's fair bytes (an id that holds many of
the rows) is split into pieces by what its records hold, equal ones dealt in turn, so
that its pieces can go to different shards. There are at most SLOTS + 1 / HOT_SHARE
pieces a shard of these, whatever the input's size, and the same ones however the input
is read, so a stored map fits the next reading.

A row's position in its shard is gapless. It is the number of rows in the
shard's earlier parts plus the row's number in its own part of a slot, so no
window covers more than one slot of one input part.

Edge cases: NULL ids hash like a value of their own and, being one hot id when
there are many, are split as such. A NULL text counts 16 bytes and has the
CRC of nothing. Repeated rows each get a position. Without rows there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowseg.functions.tables import materialize, scratch_path
from flowseg.sources.stages import path_exists

SLOTS = 4096
HOT_SHARE = 1 / 64
HEAD_BYTES = 16
_MAP = "virtual_slot int, sub int, shard int, version int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every document, with the input part it came from."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(HEAD_BYTES)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.spark_partition_id().alias("part"),
    )


def with_sub(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``sub``: 0, or for rows of a hot slot the piece of it that they belong to.

    Equal rows are numbered through, over all input parts, and dealt in turn, from a
    piece that their content names. So it depends on what is there, not on how it was read.
    """
    slots = rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"))
    fair = F.sum("slot_bytes").over(W.partitionBy()) / shards * HOT_SHARE  # one row a slot
    pieces = slots.select("virtual_slot", F.greatest(F.lit(1), F.ceil(F.col("slot_bytes") / fair)).cast("int").alias("pieces"))
    pieces = materialize(pieces.filter("pieces > 1"))
    if pieces.isEmpty():
        return rows.withColumn("sub", F.lit(0))
    marked = rows.join(F.broadcast(pieces), "virtual_slot", "left").withColumn("content", F.xxhash64("doc_id", "text_crc32", "size"))  # SLOTS rows at most
    hot = marked.filter("pieces IS NOT NULL")
    counts = hot.groupBy("virtual_slot", "content", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("virtual_slot", "content").orderBy("part")) - F.col("c")
    number = F.row_number().over(W.partitionBy("virtual_slot", "content", "part").orderBy("size")) - 1
    dealt = hot.withColumn("k", number).join(counts.withColumn("before", before).drop("c"), ["virtual_slot", "content", "part"])
    dealt = dealt.withColumn("sub", F.pmod(F.pmod("content", "pieces") + F.col("before") + F.col("k"), F.col("pieces")).cast("int"))
    rest = marked.filter("pieces IS NULL").withColumn("sub", F.lit(0))
    return materialize(rest.select(*rows.columns, "sub").unionByName(dealt.select(*rows.columns, "sub")))


def slot_parts(rows: DataFrame) -> DataFrame:
    """Rows and bytes by virtual slot, ``sub`` and input part."""
    return rows.groupBy("virtual_slot", "sub", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def _choose(unit: Column, shards: int, most: Column) -> Column:
    """Folds units, largest first, into the loads of the shards; keeps a unit on its old shard while that has room."""
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,sub:int,shard:int>>").alias("placed"),
    )

    def place(state: Column, u: Column) -> Column:
        loads = state["loads"]
        least = F.array_position(loads, F.array_min(loads)).cast("int") - 1
        kept = u["old"].isNotNull() & (u["old"] < shards) & (F.get(loads, u["old"]) + u["bytes"] <= most)
        to = F.when(kept, u["old"]).otherwise(least)
        return F.struct(
            F.transform(loads, lambda x, i: F.when(i == to, x + u["bytes"]).otherwise(x)).alias("loads"),
            F.array_append(state["placed"], F.struct(u["virtual_slot"].alias("virtual_slot"), u["sub"].alias("sub"), to.alias("shard"))).alias("placed"),
        )

    return F.aggregate(unit, start, place, lambda state: state["placed"])


def slot_map(units: DataFrame, shards: int, previous: DataFrame | None = None, version: int = 1, tolerance: float = 0.005) -> DataFrame:
    """version, virtual_slot, sub, shard. ``units`` has virtual_slot, sub, bytes: a bounded number of rows.

    With ``previous`` (an earlier version) it is that map edited: a slot leaves its
    shard only if the shard would exceed the mean by ``tolerance``.
    """
    old = units.withColumn("old", F.lit(None).cast("int"))
    if previous is not None:
        old = units.join(previous.select("virtual_slot", "sub", F.col("shard").alias("old")), ["virtual_slot", "sub"], "left")
    ordered = old.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "sub", "bytes", "old"))).alias("units"),
        F.sum("bytes").alias("total"),
    )
    most = F.col("total") / shards * (1 + tolerance)
    placed = ordered.select(F.explode(_choose(F.col("units"), shards, most)).alias("p"))
    return placed.select(F.lit(version).alias("version"), "p.*")


def edit_map(units: DataFrame, shards: int, path: str) -> DataFrame:
    """The map table at ``path`` gets its next version, an edit of the last one, which is returned.

    Versions are partitions of the table, so earlier ones stay as they were.
    """
    spark = units.sparkSession
    last = spark.read.schema(_MAP).parquet(path).agg(F.max("version")).first()[0] if path_exists(spark, path) else None
    previous = None if last is None else spark.read.schema(_MAP).parquet(path).filter(F.col("version") == last)
    version = 1 if last is None else last + 1
    slot_map(units, shards, previous, version).write.mode("append").partitionBy("version").parquet(path)
    return spark.read.schema(_MAP).parquet(path).filter(F.col("version") == version).select("version", "virtual_slot", "sub", "shard")


def shard_documents(docs: DataFrame, shards: int = 40, map_path: str | None = None) -> DataFrame:
    """Every document's shard by the law of near equal bytes, and its position there.

    ``map_path`` is where the map is kept from one run to the next.
    """
    rows = with_sub(materialize(records(docs)), shards)
    parts = materialize(slot_parts(rows))
    units = parts.groupBy("virtual_slot", "sub").agg(F.sum("bytes").alias("bytes"))
    placed = edit_map(units, shards, map_path or scratch_path(docs.sparkSession, "slot_map"))
    runs = parts.select("virtual_slot", "part", "sub", "rows").join(placed, ["virtual_slot", "sub"])
    # positions: shards' units one after the other, in each unit the input parts one after the other
    in_unit = F.sum("rows").over(W.partitionBy("virtual_slot", "sub").orderBy("part")) - F.col("rows")
    unit_rows = runs.groupBy("shard", "version", "virtual_slot", "sub").agg(F.sum("rows").alias("unit_rows"))
    before = F.sum("unit_rows").over(W.partitionBy("shard").orderBy("virtual_slot", "sub")) - F.col("unit_rows")
    starts = unit_rows.withColumn("before", before).select("virtual_slot", "sub", "before")
    offsets = (
        runs.withColumn("in_unit", in_unit)
        .join(starts, ["virtual_slot", "sub"])
        .select("virtual_slot", "sub", "part", "shard", "version", (F.col("before") + F.col("in_unit")).alias("offset"))
    )
    number = F.row_number().over(W.partitionBy("virtual_slot", "sub", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("number", number)
        .join(materialize(offsets), ["virtual_slot", "sub", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("version").alias("map_version"),
        )
    )
