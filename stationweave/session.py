"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the plans here are written for. A cluster's own values win; these are what `build` sets.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state=01 and wban folders must stay text
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", app: str = "stationweave", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf overrides them (dots written as double underscores)."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    It lies under spark.checkpoint.dir. Only where that is unset, as in local
    tests, is a folder of this machine used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = "file://" + os.path.join(tempfile.gettempdir(), "stationweave")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written out so far; tables that still read it can't be used any more."""
    at, fs = _file_system(spark, shared_dir(spark).rpartition("/")[0])
    fs.delete(at, True)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Give a written folder its name. At any time the old one or the new one is whole, under path or path__old."""
    new, fs = _file_system(spark, staged)
    at, _ = _file_system(spark, path)
    old, _ = _file_system(spark, f"{path.rstrip('/')}__old")
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"{path} can't be set aside")
    if not fs.rename(new, at):
        if fs.exists(old):
            fs.rename(old, at)
        raise OSError(f"{staged} can't be renamed to {path}")
    fs.delete(old, True)


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back.

    The lineage ends at files that outlive any executor, so what is read
    several times is computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    staged = Path(tempfile.mkdtemp(prefix="stationweave-"))
    shutil.copytree(package, staged / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(staged / f"stationweave-{app}"), "zip", staged / "src"))
    shutil.rmtree(staged / "src")
    _shipped.add(app)
