"""Consolidation of very many small files into few well-sized ones, each record once.

1. Every record gets a canonical key (station, instant, element, number), so
   notations of the same record meet.
2. One partial-then-final aggregation keeps, of each key, the record with the
   lowest (file_id, rec_no). A key delivered a million times collapses on the map
   side; no task ever holds a group.
3. A REBALANCE hint shuffles the kept rows round-robin; with adaptive execution
   the runtime sizes of the shuffle blocks merge or split output partitions
   towards the target size.
4. The files are written to a staging folder, read back, and committed by renames
   only if count and multiset checksum (sum and xor of row hashes) equal those of
   the rows that were meant to be written. What was there before is set aside,
   not deleted, until the new files have its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import with_epoch
from ..session import publish, shared_dir

#: What a consolidated file should hold, before compression.
TARGET_BYTES = 128_000_000

RECORD = ("file_id", "rec_no", "station_id", "obs_time", "element", "value_text")


class ChecksumMismatch(RuntimeError):
    """What was written isn't the multiset that was meant to be written."""


@dataclass(frozen=True)
class Consolidated:
    path: str
    rows: int
    kept: DataFrame
    repeats: DataFrame


def keyed(fragments: DataFrame) -> DataFrame:
    """RECORD and the canonical key of each record.

    Blanks and letter case of the station id don't count, nor the notation of
    time and number. A time or number that can't be read is compared as text
    without blanks at its ends; NULL equals NULL.
    """
    number = F.trim("value_text").try_cast("double")
    return with_epoch(fragments.select(*RECORD), "obs_time", "k_time").select(
        *RECORD,
        F.upper(F.regexp_replace("station_id", r"\s+", "")).alias("k_station"),
        "k_time",
        F.when(F.col("k_time").isNull(), F.trim("obs_time")).alias("k_time_text"),
        F.trim("element").alias("k_element"),
        (number + F.lit(0.0)).alias("k_value"),  # -0.0 becomes 0.0
        F.when(number.isNull(), F.trim("value_text")).alias("k_value_text"),
    )


KEYS = ["k_station", "k_time", "k_time_text", "k_element", "k_value", "k_value_text"]


def first_deliveries(fragments: DataFrame) -> DataFrame:
    """Each record once, as its delivery with the lowest (file_id, rec_no) wrote it.

    A NULL file_id or rec_no counts as lower than any number. Repeated rows with
    the same (file_id, rec_no) come out once.
    """
    return keyed(fragments).groupBy(*KEYS).agg(F.min(F.struct(*RECORD)).alias("r")).select("r.*")


def repeats_of(fragments: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, rec_no) of every record that isn't the kept delivery.

    The anti join runs on the record's address, which is unique, so a hot record
    is no hot join key.
    """
    here, there = fragments.select("file_id", "rec_no"), kept.select(
        F.col("file_id").alias("kept_file"), F.col("rec_no").alias("kept_rec")
    )
    same = F.col("file_id").eqNullSafe(F.col("kept_file")) & F.col("rec_no").eqNullSafe(F.col("kept_rec"))
    return here.join(there, same, "left_anti")


def multiset_checksum(df: DataFrame) -> tuple[int, int, int]:
    """(rows, sum of row hashes, xor of row hashes): equal for equal multisets of rows, in any order."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    r = df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"),
    ).first()
    return int(r["n"]), int(r["s"]), int(r["x"])


def rebalanced(df: DataFrame, *keys: str) -> DataFrame:
    """df under a REBALANCE hint: adaptive execution splits and merges the output partitions.

    The size that they get is that of `sized`. With keys, rows of a key stay
    together unless the key alone exceeds the size, in which case it is split.
    """
    return df.hint("rebalance", *[F.col(k) for k in keys])


@contextmanager
def sized(spark: SparkSession, target_bytes: int | None) -> Iterator[None]:
    """Adaptive execution aims at partitions of target_bytes, not at one per core; the session's own values return after.

    The size is that of the shuffled rows; compressed files come out smaller.
    None leaves the session's size.
    """
    names = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    if target_bytes:
        names["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(target_bytes)
    held = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in held.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def consolidate(
    fragments: DataFrame, path: str | None = None, target_bytes: int | None = None
) -> Consolidated:
    """Write the fragments' records, each once, to well-sized files at path.

    path defaults to a new folder of the shared scratch space. Raises
    ChecksumMismatch and leaves path untouched when the files read back differ
    from the rows meant. An empty input gives an empty table. The files are
    written before this returns.
    """
    spark = fragments.sparkSession
    path = path or shared_dir(spark)
    kept = first_deliveries(fragments)
    staging = f"{path.rstrip('/')}__staging"
    with sized(spark, target_bytes):
        rebalanced(kept).write.mode("overwrite").option("compression", "zstd").parquet(staging)
    written = spark.read.schema(kept.schema).parquet(staging)
    meant, found = multiset_checksum(kept), multiset_checksum(written)
    if meant != found:
        raise ChecksumMismatch(f"meant {meant}, found {found}; {path} is unchanged")
    publish(spark, staging, path)
    kept = spark.read.schema(kept.schema).parquet(path)
    return Consolidated(path, found[0], kept, repeats_of(fragments, kept))


def small_files(inventory: DataFrame, small_bytes: int = 1_000_000) -> DataFrame:
    """Files worth merging: known to be at most small_bytes, each file once, its path in one notation.

    NULL sizes are left out: nothing says that they're small. Of rows listed
    twice (same file_id) one stays.
    """
    tidy = F.regexp_replace(F.regexp_replace(F.trim("filepath"), r"\\", "/"), "/+", "/")
    return (
        inventory.where(F.col("file_size_bytes") <= small_bytes)
        .groupBy("file_id")
        .agg(
            F.min(tidy).alias("path"),
            F.min("file_size_bytes").alias("file_size_bytes"),
            F.min(F.upper("station_id_raw")).alias("station_id_raw"),
            F.min("source").alias("source"),
            F.min("subfolder").alias("subfolder"),
        )
    )


def merge_plan(inventory: DataFrame, small_bytes: int = 1_000_000, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Per (source, subfolder): how many small files there are and how many files they need at target size."""
    files = small_files(inventory, small_bytes)
    n = F.count(F.lit(1))
    total = F.sum("file_size_bytes")
    return files.groupBy("source", "subfolder").agg(
        n.alias("files_before"),
        total.cast("bigint").alias("bytes_total"),
        F.greatest(F.ceil(total / F.lit(float(target_bytes))), F.lit(1)).cast("bigint").alias("files_after"),
    )
