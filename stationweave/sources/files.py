"""Files themselves: trees, listings, archives, row counts and ranges, schemas, and the small state beside them."""

from __future__ import annotations

import io
import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.files import DATA, date_part, extension, station_of_file, subfolder

#: Folders that are never looked into.
SKIPPED = (".git", "__pycache__", ".DS_Store", "recon")


def union_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet files or folders as one table; columns are matched by name, missing ones NULL."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def partitioned(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """A tree of key=value folders. The declared schema keeps keys like state=01 text and spares a look at every file."""
    return spark.read.schema(schema).parquet(root)


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(filepath, filename, modified, file_size_bytes) of all files under root, without their contents.

    Folders named in SKIPPED are left out. Empty files have no time: a scan skips
    them, so they are taken from the list of files that the scan was planned with.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = spark.createDataFrame([(unquote(p),) for p in scan.inputFiles()], "filepath string").select(plain("filepath").alias("filepath"))
    found = scan.select(plain("path").alias("filepath"), F.col("modificationTime").alias("modified"), F.col("length").alias("file_size_bytes"))
    df = listed.join(found, "filepath", "left").withColumn("file_size_bytes", F.coalesce("file_size_bytes", F.lit(0)))
    skipped = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return df.where(~F.col("filepath").rlike(f"/({skipped})/")).select(
        "filepath", F.element_at(F.split("filepath", "/"), -1).alias("filename"), "modified", "file_size_bytes"
    )


def catalogued(files: DataFrame, source: str, root: str) -> DataFrame:
    """file_inventory rows, with `failed`, of a table with filepath, filename and file_size_bytes."""
    ext, s, sub = extension(F.col("filename")), station_of_file(F.col("filename")), subfolder(F.col("filepath"), root)
    flag = F.when(F.col("file_size_bytes") == 0, "empty_file").when(F.col("file_size_bytes").isNull(), "unknown_size")
    return files.withColumns({"_e": ext, "_s": s, "_f": sub}).select(
        "filepath", "filename", F.col("_e").alias("extension"), "file_size_bytes", F.lit(source).alias("source"), F.col("_f").alias("subfolder"),
        F.concat(F.lit(f"{source}|"), "_f", F.lit("|"), "_e").alias("schema_group"), "_s.station_id_raw", "_s.id_format",
        date_part(F.col("filename")).alias("date_part"), F.col("_e").isin(*DATA).alias("is_data_file"), flag.alias("anomaly_flag"), "_s.failed",
    )


def listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, name, modified) of the files that directory listings name.

    Two layouts (a table's next cell, or text behind the link) and two notations
    of time; the table's entry wins for a name given in both. Folders and links
    with a query are left out.
    """
    stamp = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}|\d{2}-\w{3}-\d{4} \d{2}:\d{2})"
    link = r'href="([^"?/][^"]*)"[^>]*>[^<]*</a>'
    keep = [c for c in pages.columns if c != html]

    def found(pattern: str, rank: int):
        one = lambda n: F.regexp_extract_all(F.col(html), F.lit(f"(?is){pattern}"), n)
        return F.zip_with(one(1), one(2), lambda a, b: F.struct(a.alias("name"), b.alias("text"), F.lit(rank).alias("rank")))

    rows = pages.select(
        *keep, F.explode(F.concat(found(rf"{link}\s*</td>\s*<td[^>]*>\s*{stamp}", 1), found(rf"{link}\s+{stamp}", 2))).alias("x")
    )
    t = F.coalesce(
        F.try_to_timestamp(F.col("x.text"), F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(F.initcap(F.col("x.text")), F.lit("dd-MMM-yyyy HH:mm")),
    ).cast("timestamp_ntz")
    rows = rows.select(*keep, F.col("x.name").alias("name"), F.col("x.rank").alias("rank"), t.alias("modified"))
    rows = rows.where(~F.col("name").endswith("/") & F.col("modified").isNotNull())
    return rows.groupBy(*keep, "name").agg(F.min_by("modified", F.struct("rank", "modified")).alias("modified"))


def archive_members(spark: SparkSession, path: str, suffix: str = "", prefix: str = "") -> DataFrame:
    """(archive, member, value): the text lines of the members of tar.gz archives whose names begin and end so.

    One task reads an archive, a member at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        base = os.path.basename(m.name)
                        if m.isfile() and base.endswith(suffix) and base.startswith(prefix):
                            text = tar.extractfile(m).read().decode("latin-1").splitlines()
                            yield pd.DataFrame({"archive": name, "member": m.name, "value": text})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, "archive string, member string, value string")


def profile(spark: SparkSession, path: str, time_column: str | None = None) -> DataFrame:
    """(filepath, total_rows, min_datetime, max_datetime, has_data) of the Parquet files under path, from one scan of one column."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    t = F.col(time_column).cast("string") if time_column and time_column in df.columns else F.lit(None).cast("string")
    return (
        df.select(F.col("_metadata.file_path").alias("filepath"), t.alias("t"))
        .groupBy("filepath")
        .agg(F.count(F.lit(1)).alias("total_rows"), F.min("t").alias("min_datetime"), F.max("t").alias("max_datetime"))
        .withColumn("has_data", F.col("total_rows") > 0)
    )


def described(df: DataFrame) -> DataFrame:
    """(position, column_name, column_type, nullable) of a table's schema."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string, nullable boolean")


def sample_schema(spark: SparkSession, path: str, ext: str) -> dict:
    """{columns, note} of one file by its extension; what goes wrong is the note."""
    try:
        if ext.endswith(".parquet"):
            return {"columns": spark.read.parquet(path).columns, "note": ""}
        if ext in (".csv", ".csv.gz"):
            return {"columns": spark.read.csv(path, header=True).columns, "note": ""}
        if ext == ".dly":
            return {"columns": ["station", "date", "element", "value", "mflag", "qflag", "sflag"], "note": "fixed width"}
        if ext in (".txt", ".dat"):
            return {"columns": ["raw_line"], "note": "text lines"}
        if ext in (".tar.gz", ".zip", ".gz"):
            return {"columns": [], "note": "archive"}
        return {"columns": [], "note": f"not read: {ext or 'no extension'}"}
    except Exception as e:  # noqa: BLE001 - the note is the result
        return {"columns": [], "note": str(e)[:200]}


def sampled_files(files: DataFrame, per_group: int = 3) -> DataFrame:
    """At most per_group files of each schema group, picked by a hash of their path: the same at every run."""
    from ..operators.crosswalk import first_rows

    return first_rows(files, ["schema_group"], [F.xxhash64("filepath"), F.col("filepath")], per_group)


def read_state(path: str, default: dict | None = None) -> dict:
    """A small JSON file of this driver; the default where it's absent or broken."""
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return {} if default is None else default


def write_state(path: str, state: dict) -> None:
    """Replace a small JSON file at once: a reader sees the old one or the new one."""
    new = f"{path}.{uuid.uuid4().hex}"
    with open(new, "w") as f:
        json.dump(state, f, indent=1, sort_keys=True, default=str)
    os.replace(new, path)


def unchanged(path: str, token: str) -> bool:
    """Whether a source's version token is the one saved at path."""
    try:
        with open(path) as f:
            return f.read().strip() == token.strip()
    except OSError:
        return False
