"""Keeping stored tables fresh: which files are due, each file once, keyed replacement, dependent tables.

The file source's checkpoint is the set of files done; availableNow works off
what has come since and stops. Every batch goes into the table by keyed
replacement, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.tables import keyed_replace

#: Refresh date of a source that was never refreshed (fixed value).
NEVER = date(2020, 1, 1)
#: Days after which a source is fetched whole instead of file by file (fixed value).
STALE_DAYS = 60
#: Years before the last refresh that are looked at again: late files change old partitions.
LATE_YEARS = {"1min": 2, "hourly": 1, "daily": 1, "15min": 0, "hpd": 0}


def last_refresh(state: dict, source: str) -> date:
    """The day of a source's last refresh."""
    text = state.get("last_refresh", {}).get(source, {}).get("date")
    return date.fromisoformat(text) if text else NEVER


def latest_refresh(state: dict) -> date | None:
    """The latest day of any source's refresh."""
    days = [date.fromisoformat(v["date"]) for v in state.get("last_refresh", {}).values() if isinstance(v, dict) and "date" in v]
    return max(days, default=None)


def recorded(state: dict, source: str, day: date, updated: int, new: int) -> dict:
    """state with a refresh added."""
    held = dict(state.get("last_refresh", {}))
    held[source] = {"date": day.isoformat(), "stations_updated": updated, "new_stations": new}
    return {**state, "last_refresh": held}


def cutoff(mark: date, source: str) -> datetime:
    """Files changed after this are due: the end of the day before the mark, so that the mark's own day is read again; for hpd its start."""
    if source == "hpd":
        return datetime(mark.year, mark.month, mark.day)
    before = mark - timedelta(days=1)
    return datetime(before.year, before.month, before.day, 23, 59, 59)


def first_year(mark: date, source: str) -> int:
    """The earliest year whose partitions are looked at again."""
    return mark.year - LATE_YEARS[source]


def method(mark: date, today: date) -> str:
    """'full' for a source that is stale, else 'incremental'."""
    return "full" if (today - mark).days >= STALE_DAYS else "incremental"


def due(listing: DataFrame, done: DataFrame, after: datetime, force: bool = False, must_exist: DataFrame | None = None) -> DataFrame:
    """Files of a listing (name, modified) that changed after the cutoff and aren't done (name, modified); force takes all.

    A file done before counts as due again if it changed since. must_exist:
    names that are there already; others aren't due.
    """
    late = listing if force else listing.where(F.col("modified") > F.lit(after))
    if must_exist is not None:
        late = late.join(must_exist.select("name").distinct(), "name", "left_semi")
    return late if force else late.join(done.select("name", "modified").distinct(), ["name", "modified"], "left_anti")


def dry_run(due_files: DataFrame) -> DataFrame:
    """(files): how many files a refresh would fetch."""
    return due_files.agg(F.count(F.lit(1)).alias("files"))


def refresh(
    spark: SparkSession, source: str, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], partition: Sequence[str], key: str,
    format: str = "text", schema: StructType | None = None, options: dict[str, str] | None = None,  # noqa: A002
    after: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Work off the new files of a folder and stop: parse, replace by key within partitions, then update dependent tables.

    after(rows, batch) gets the rows of each batch once they are in the table,
    to rebuild only what depends on their partitions.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = parse(batch)
        keyed_replace(rows, target, partition, key)
        if after:
            after(rows, number)

    reader = spark.readStream.format(format).options(**(options or {}))
    rows = (reader.schema(schema) if schema else reader).load(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def affected(table: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the partitions that a batch changed: what a dependent table has to be computed from again."""
    return table.join(changed.select(*keys).distinct(), list(keys), "left_semi")


# ---------------------------------------------------------------- event-time windows


def windowed(events: DataFrame, ts: str, keys: Sequence[str], aggregates: Sequence[Column], length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggregates) over tumbling windows, or sliding ones with slide.

    late: how late rows may come before a stream drops them; a batch drops none.
    Windows and their ends are in the session's zone, UTC by default.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    out = rows.groupBy(F.window(ts, length, slide), *keys).agg(*aggregates)
    return _spread(out)


def sessions(events: DataFrame, ts: str, keys: Sequence[str], aggregates: Sequence[Column], gap: str, late: str | None = None) -> DataFrame:
    """The same over sessions: rows of a key belong together until a gap without any."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    return _spread(rows.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates))


def _spread(df: DataFrame) -> DataFrame:
    ends = {f"window_{k}": F.col(f"window.{k}").cast("timestamp_ntz") for k in ("start", "end")}
    return df.withColumns(ends).drop("window")
