"""Writing and changing stored tables: files, partitions, and replacing, ignoring or updating rows by key.

Plain Parquet has no MERGE, so a change by key rewrites what it touches and no
more: the partitions of the new rows. They are staged first, since a partition
can't be overwritten while it is being read, and a failure while staging leaves
the table as it was. Applying a change twice gives what applying it once gives.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, publish, shared_dir
from .crosswalk import first_rows


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """The result of a query as Parquet files."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", one_file: bool = False) -> None:
    """The result as delimited files with a header; one_file brings all rows to one task, for small exports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def append_csv(path: str, header: Sequence[str], rows: Sequence[Sequence]) -> None:
    """Append a few rows to a CSV file of this driver; the header is written once."""
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="") as f:
        w = csv.writer(f)
        if new:
            w.writerow(header)
        w.writerows(rows)


def csv_text(df: DataFrame) -> str:
    """A small table (a station list, a tidy extract) as CSV text on the driver."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(df.columns)
    for row in df.toLocalIterator():
        w.writerow(["" if v is None else v for v in row])
    return out.getvalue()


def append_partitions(df: DataFrame, path: str, keys: Sequence[str] = ("year", "state"), spread: int = 1) -> None:
    """Append rows to a table partitioned by keys, each partition by `spread` tasks; NULL keys have a partition of their own."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    salted.repartition(*keys, "_salt").drop("_salt").write.partitionBy(*keys).mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Overwrite exactly the partitions that df has rows of."""
    df.repartition(*keys).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def touched(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows of the partitions that new has rows of: a broadcast of distinct partition keys prunes the scan."""
    held = spark.read.schema(new.schema).parquet(path)
    parts = new.select(*keys).distinct()
    same = None
    for k in keys:
        c = held[k].eqNullSafe(parts[k])
        same = c if same is None else same & c
    return held.join(parts, same, "left_semi")


def keyed_replace(new: DataFrame, path: str, partition: Sequence[str], key: str) -> None:
    """Replace, in the partitions of the new rows, all rows of the new rows' keys by the new rows.

    Rows of other keys and other partitions stay. A table that isn't there yet
    is made.
    """
    spark = new.sparkSession
    new = materialise(new)
    if exists(spark, path):
        held = touched(spark, path, new, partition)
        both = [*partition, key]
        gone = new.select(*[F.col(c).alias(f"_{c}") for c in both]).distinct()
        same = None
        for c in both:
            x = F.col(c).eqNullSafe(F.col(f"_{c}"))
            same = x if same is None else same & x
        new = materialise(held.join(gone, same, "left_anti").unionByName(new))
    replace_partitions(new, path, partition)


def insert_or_ignore(held: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """held and those new rows whose key it lacks; of new rows of one key the first in the order."""
    fresh = first_rows(new, list(key), list(order)).join(held.select(*key), list(key), "left_anti")
    return held.unionByName(fresh)


def upsert(held: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """held with the rows of new keys added and those of known keys replaced; of new rows of one key the first in the order."""
    fresh = first_rows(new, list(key), list(order))
    return held.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)


def without(held: DataFrame, column: str, value: str) -> DataFrame:
    """held without the rows of one value, or of groups 'value|...' of it; NULLs stay."""
    mine = (F.col(column) == value) | F.substring(column, 1, len(value) + 1).eqNullSafe(F.lit(f"{value}|"))
    return held.where(~F.coalesce(mine, F.lit(False)))


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Make a stored table anew from a query that may read it: written beside it, then swapped by renames."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}__new"
    df.write.mode("overwrite").parquet(staged)
    publish(spark, staged, path)
    return spark.read.schema(df.schema).parquet(path)


def staged_replace(new: DataFrame, partition: Sequence[str], key: str, base: DataFrame | None = None) -> DataFrame:
    """The table that keyed_replace leaves, built in a scratch folder from base; for reading it back at once."""
    path = shared_dir(new.sparkSession)
    if base is not None:
        replace_partitions(base, path, partition)
    keyed_replace(new, path, partition, key)
    return new.sparkSession.read.schema(new.schema).parquet(path)
