"""Table-level helpers: lineage cuts, global row numbers, size-checked and skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted

BROADCAST_ROWS = 200_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHARES = 8  # of a salted join, per shuffle partition


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="flowseg-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path below the shared folder, private to this application."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/flowseg-{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read back: cuts lineage, survives executor loss, gives the planner sizes."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffle files when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application once their results are stored."""
    discard(spark, f"{shared_folder(spark)}/flowseg-{spark.sparkContext.applicationId}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan of fewer splits than cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def with_row_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """Dense 0-based position in the global order, without a single-task window.

    The order must be total. Rows are range-partitioned and sorted; only one
    count per partition is gathered to turn local positions into global ones.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    sizes = placed.groupBy("_part").agg(
        (F.max("_mid") - F.shiftleft(F.col("_part"), 33) + 1).alias("_n")
    )
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in sizes.collect()):  # one row per partition
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_mid") - F.shiftleft(F.col("_part"), 33))
        .drop("_mid", "_part", "_start")
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (materialized) table holds at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    rows: int = BROADCAST_ROWS,
    lookup_rows: int | None = None,
    position: str | None = None,
) -> DataFrame:
    """Left join on a lookup table with one row per ``key`` that counts its own matches.

    Small lookups (checked) are broadcast. Otherwise a key gets salts in proportion
    to its ``weight``: as many as it has shares of the whole, of which there are
    ``SHARES`` a shuffle partition, so a task gets several shares and a heavy key is in
    many tasks. The lookup grows by as many rows as there are shares at most.
    A row's salt is its place modulo its key's salts, so equal rows are spread too.
    ``position`` names a stored column with that place; without one, the table is
    written with it first, since a repeated task must deal a row the same way, unless
    no key has more than a share, NULL included: then rows go by their key alone.
    Rows meet sorted by the hash of their key first, since text and structs compare slowly.
    ``lookup`` should be materialized, or come with its known number of rows; rows
    with a NULL key keep NULLs.
    """
    if lookup_rows <= rows if lookup_rows is not None else is_small(lookup, rows):
        return df.join(F.broadcast(lookup), key, "left")
    names = df.columns
    at = position or "_lookup_at"
    shares = SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    salts = F.greatest(F.ceil(F.col(weight) * shares / max(total, 1)), F.lit(1)).cast("long")
    heavy = lookup.withColumn("_salts", salts).filter("_salts > 1").select(key, "_salts")
    if position is None:
        if heavy.isEmpty() and is_small(df.filter(F.col(key).isNull()).select(key), max(total // shares, 1)):
            joined = df.withColumn("_lookup_hash", F.xxhash64(key)).join(lookup.withColumn("_lookup_hash", F.xxhash64(key)), ["_lookup_hash", key], "left")
            return joined.select(*[quoted(c) for c in names], *[quoted(c) for c in lookup.columns if c != key])
        df = materialize(df.withColumn(at, F.monotonically_increasing_id()))
    left = df.join(F.broadcast(heavy), key, "left")  # fewer keys than shares
    left = left.withColumn("_salt", F.pmod(F.col(at), F.coalesce("_salts", F.when(F.col(key).isNull(), shares).otherwise(1))))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    left, right = (x.withColumn("_lookup_hash", F.xxhash64(key)) for x in (left.drop("_salts"), right))
    joined = left.join(right, ["_lookup_hash", "_salt", key], "left")
    return joined.select(*[quoted(c) for c in names], *[quoted(c) for c in lookup.columns if c != key])


def follow_pointers(pointers: DataFrame, keys: list[str], vertex: str, target: str) -> DataFrame:
    """Replace every pointer by the root it leads to (a root points to itself).

    Pointer doubling: as many joins as the logarithm of the longest chain. The
    looked-up side has one row per vertex, so a popular target is a skewed left
    side, which adaptive execution splits.
    """
    while True:
        ahead = pointers.select(*keys, F.col(vertex).alias(target), F.col(target).alias("_next"))
        moved = materialize(pointers.join(ahead, [*keys, target]))
        pointers = moved.select(*keys, vertex, F.col("_next").alias(target))
        if moved.filter(F.col("_next") != F.col(target)).isEmpty():
            return pointers
