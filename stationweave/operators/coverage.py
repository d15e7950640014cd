"""Analytics of coverage: by state, year, decade, place and grid cell, and gaps in the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decode import leading_year
from .selection import in_box

RESOLUTIONS = ("1min", "15min", "hourly", "hourly_precip", "daily")
YEARS = (1900, 2026)
#: The states and the District of Columbia.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()


def placed(geo: DataFrame) -> DataFrame:
    """The rows of a coverage table with a place."""
    return geo.where(in_box(F.col("lat"), F.col("lon"), "world"))


def by_state(geo: DataFrame, top: int = 20) -> DataFrame:
    """The states of most stations, with their number by resolution; equals by name. A report of the top states."""
    named = geo.where("state IS NOT NULL AND state <> ''")
    counts = [F.count_if(F.col("temporal_resolution") == r).alias(f"s_{r}") for r in RESOLUTIONS]
    return named.groupBy("state").agg(*counts, F.count(F.lit(1)).alias("total")).orderBy(F.col("total").desc(), "state").limit(top)


def stations_by_state(geo: DataFrame) -> DataFrame:
    """Distinct stations by state and resolution, states and DC only."""
    rows = geo.where(F.col("state").isin(*STATES)).select("state", "temporal_resolution", "station_id_raw").distinct()
    return rows.groupBy("state").pivot("temporal_resolution", list(RESOLUTIONS)).agg(F.count("station_id_raw")).na.fill(0)


def _years(geo: DataFrame) -> DataFrame:
    a, b = leading_year(F.col("earliest_date")), leading_year(F.col("latest_date"))
    df = geo.select("temporal_resolution", a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # counted by span first, so that no year of a station is ever written out
    return df.groupBy("temporal_resolution", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def active_per_year(geo: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """(temporal_resolution, year, stations): how many stations have data of each year; years without one are left out."""
    spans = _years(geo).select("temporal_resolution", "n", F.greatest("a", F.lit(years[0])).alias("a"), F.least("b", F.lit(years[1])).alias("b"))
    each = spans.where("a <= b").select("temporal_resolution", "n", F.explode(F.sequence("a", "b")).alias("year"))
    return each.groupBy("temporal_resolution", "year").agg(F.sum("n").alias("stations"))


def decade_density(geo: DataFrame, first: int = 1900, last: int = 2020) -> DataFrame:
    """(decade, a column per resolution): stations with data in each decade."""
    ten = lambda c: F.floor(F.col(c) / 10).cast("int")
    spans = _years(geo).select("temporal_resolution", "n", F.greatest(ten("a"), F.lit(first // 10)).alias("a"), F.least(ten("b"), F.lit(last // 10)).alias("b"))
    each = spans.where("a <= b").select("temporal_resolution", "n", F.explode(F.sequence("a", "b")).alias("ten"))
    return each.groupBy((F.col("ten") * 10).alias("decade")).pivot("temporal_resolution", list(RESOLUTIONS)).agg(F.sum("n")).na.fill(0)


def resolutions_by_place(geo: DataFrame) -> DataFrame:
    """(lat, lon, n_res, dominant): how many resolutions a place has, and its only one or 'multi'."""
    found = placed(geo).groupBy("lat", "lon").agg(F.collect_set("temporal_resolution").alias("r"))
    out = F.when(F.size("r") > 1, "multi")
    for r in RESOLUTIONS:
        out = out.when(F.array_contains("r", r), r)
    return found.select("lat", "lon", F.size("r").alias("n_res"), out.otherwise("none").alias("dominant"))


def span_cap(geo: DataFrame, q: float = 0.98, most: int = 130) -> DataFrame:
    """(cap): the exact quantile of the years of record, cut to a whole number, plus one, at most `most`."""
    return placed(geo).agg(F.least(F.percentile("years_span", q).cast("int") + 1, F.lit(most)).alias("cap"))


def density(geo: DataFrame, degrees: float = 0.5) -> DataFrame:
    """(temporal_resolution, cell_lon, cell_lat, total_rows): rows per grid cell of the contiguous states; negative counts are 0, empty cells left out."""
    rows = geo.where(in_box(F.col("lat"), F.col("lon"), "conus") & F.col("total_rows").isNotNull())
    cell = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(degrees)).cast("int")
    return (
        rows.groupBy("temporal_resolution", cell("lon", -126.0).alias("cell_lon"), cell("lat", 23.0).alias("cell_lat"))
        .agg(F.sum(F.greatest("total_rows", F.lit(0))).alias("total_rows"))
        .where("total_rows > 0")
    )


def gaps(df: DataFrame, key: str, t: Column, low: float = 0, high: float = 50, bucket_days: int = 30) -> DataFrame:
    """(key, t, minutes): readings less than `high` and more than `low` minutes after the one before of their key.

    t: epoch seconds. Windows run over (key, bucket of days), and a reading late
    in a bucket is shown to the next one, so a key with most of the rows is many
    tasks. high must be less than a bucket.
    """
    size = bucket_days * 86400
    at = lambda s: F.floor((F.col("t") + s) / size).cast("bigint")
    rows = df.select(F.col(key).alias("k"), t.alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = rows.withColumn("b", F.explode(F.array_distinct(F.array(at(0), at(int(high * 60) + 1)))))
    before = F.lag("t").over(Window.partitionBy("k", "b").orderBy("t"))
    rows = rows.withColumn("minutes", (F.col("t") - before) / F.lit(60.0)).where(F.col("b") == at(0))
    return rows.where((F.col("minutes") > low) & (F.col("minutes") < high)).select(F.col("k").alias(key), "t", "minutes")


def mean_by_place(df: DataFrame, lat: str, lon: str, measures: Sequence[str]) -> DataFrame:
    """The mean of each measure by place; missing values don't count."""
    return df.groupBy(lat, lon).agg(*[F.avg(m).alias(m) for m in measures])


def raster(places: DataFrame, lat: str, lon: str, measures: Sequence[str], degrees: float = 1.0) -> DataFrame:
    """(cell_lat, cell_lon, measures): means of places by grid cell."""
    cell = lambda c: F.floor(F.col(c) / F.lit(degrees)).cast("int")
    return places.groupBy(cell(lat).alias("cell_lat"), cell(lon).alias("cell_lon")).agg(*[F.avg(m).alias(m) for m in measures])


def top_states(stations: DataFrame, top: int = 20) -> DataFrame:
    """(state, n) of the states of most stations; those without a state are a group of their own."""
    return stations.groupBy("state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("state").asc_nulls_last()).limit(top)
