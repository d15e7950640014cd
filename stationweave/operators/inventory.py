"""Inventories and coverage of the archive: what each station has, by resolution and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import leading_year
from .crosswalk import first_rows


def resolution_of(source: Column, folder: Column) -> Column:
    """The resolution of a file by its source and folder."""
    return (
        F.when((source == "ASOS") & (folder == "1min"), "1min").when((source == "ASOS") & (folder == "15min"), "15min")
        .when(source == "GHCNd", "daily").when(source == "GHCNh", "hourly").otherwise("other")
    )


def _span(date: Column, year: Column) -> list[Column]:
    return [F.min(date).alias("earliest_dt"), F.max(date).alias("latest_dt"), F.count(F.lit(1)).alias("row_count"), F.countDistinct(year).alias("file_count")]


def daily_inventory(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """The station inventory of daily rows (station, date) that the station table (station, lat, lon, state) knows."""
    found = obs.groupBy("station").agg(*_span(F.col("date"), F.year("date")))
    return found.join(meta.select("station", "lat", "lon", "state"), "station").select(
        F.col("station").alias("station_id"), "lat", "lon", "state", "earliest_dt", "latest_dt", "row_count", "file_count"
    )


def hourly_inventory(obs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The station inventory of hourly rows by station and state; a date that can't be read counts as a row only.

    places: (wban_id, lat_dec, lon_dec), any number of rows an id; the first with coordinates serves, by latitude and longitude.
    """
    day = F.substring(F.trim("date"), 1, 10).try_cast("date")
    found = obs.where("station_id IS NOT NULL").groupBy("station_id", "state").agg(*_span(day, F.col("year")))
    if places is None:
        return found.select("station_id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "state", "earliest_dt", "latest_dt", "row_count", "file_count")
    at = places.where("wban_id IS NOT NULL AND lat_dec IS NOT NULL").groupBy("wban_id").agg(F.min(F.struct("lat_dec", "lon_dec")).alias("p"))
    return found.join(at, F.substring("station_id", 7, 5) == F.col("wban_id"), "left").select(
        "station_id", F.col("p.lat_dec").alias("lat"), F.col("p.lon_dec").alias("lon"), "state", "earliest_dt", "latest_dt", "row_count", "file_count"
    )


def quarter_inventory(obs: DataFrame) -> DataFrame:
    """The station inventory of 15-minute rows, whose place is their own: the one of their lowest latitude."""
    day = F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0")).try_cast("date")
    place = F.min(F.struct("lat", "lon")).alias("p")
    found = obs.where("station_id IS NOT NULL").groupBy("station_id", "state").agg(place, *_span(day, F.col("year")))
    return found.select("station_id", "p.lat", "p.lon", "state", "earliest_dt", "latest_dt", "row_count", "file_count")


def minute_inventory(inventory: DataFrame, places: DataFrame) -> DataFrame:
    """The station inventory of one-minute files, from the catalogue alone: months of the first and last file, no row counts.

    places: (icao_id, lat_dec, lon_dec, state); the first with coordinates serves.
    """
    rows = inventory.where("source = 'ASOS' AND subfolder = '1min' AND id_format = 'ICAO_ASOS' AND station_id_raw IS NOT NULL")
    found = rows.groupBy(F.substring("station_id_raw", 2, 4).alias("station_id")).agg(
        F.min("date_part").alias("a"), F.max("date_part").alias("b"), F.count(F.lit(1)).alias("file_count")
    )
    at = places.where("icao_id IS NOT NULL AND lat_dec IS NOT NULL").groupBy("icao_id").agg(F.min(F.struct("lat_dec", "lon_dec", "state")).alias("p"))
    month = lambda c: F.concat(c, F.lit("-01")).try_cast("date")
    return found.join(at, F.col("station_id") == F.col("icao_id"), "left").select(
        "station_id", F.col("p.lat_dec").alias("lat"), F.col("p.lon_dec").alias("lon"), F.col("p.state").alias("state"), month("a").alias("earliest_dt"),
        month("b").alias("latest_dt"), F.lit(0).cast("bigint").alias("row_count"), "file_count",
    )


def station_coverage(inventory: DataFrame, profile: DataFrame) -> DataFrame:
    """Per station, id format, source and resolution: files, rows, GB, first and last date, years between, empty and broken files.

    Files that hold data and have both a station and a profile; a file listed twice counts once.
    """
    data = inventory.where("is_data_file AND station_id_raw IS NOT NULL AND station_id_raw <> ''")
    files = first_rows(data, ["filepath"], [F.col("file_size_bytes").desc_nulls_last(), F.col("station_id_raw")])
    files = files.select("filepath", "station_id_raw", "id_format", "source", "file_size_bytes", resolution_of(F.col("source"), F.col("subfolder")).alias("temporal_resolution"))
    p = profile.select("filepath", "total_rows", "min_datetime", "max_datetime", "has_data", "error")
    first, last = F.min("min_datetime"), F.max("max_datetime")
    return files.join(p, "filepath").groupBy("station_id_raw", "id_format", "source", "temporal_resolution").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("total_rows").alias("total_rows"), F.round(F.sum("file_size_bytes") / 1e9, 3).alias("total_gb"),
        first.alias("earliest_date"), last.alias("latest_date"), (leading_year(last) - leading_year(first)).alias("years_span"),
        F.count_if(~F.col("has_data")).alias("empty_files"), F.count_if(F.col("error").isNotNull()).alias("error_files"),
    )


#: Formats of an id, the list of the master table that it is looked up in, and the part of the id that is looked up.
KEYS = (
    (("GHCND_DLY", "GHCND_HPD", "GHCND"), "ghcnd_ids", 1, 1 << 20),
    (("ICAO_ASOS",), "icao_ids", 2, 4),
    (("USAF_WBAN", "ASOS_A"), "usaf_id", 1, 6),
)
GEO = ("station_name", "state", "county", "lat", "lon", "elev_m")


def with_places(coverage: DataFrame, master: DataFrame) -> DataFrame:
    """coverage with name, state, county and place of the master station that its id names.

    One equi-join on (kind of id, id). Of several stations of an id the first
    with coordinates serves, then by ncei_id, so no row is multiplied.
    """
    m = master.withColumnsRenamed({"lat_dec": "lat", "lon_dec": "lon"})
    tables = [
        m.where(f"{c} IS NOT NULL AND {c} <> ''").select(F.lit(n).alias("_kind"), F.col(c).alias("_key"), "ncei_id", *GEO) for n, (_, c, _, _) in enumerate(KEYS)
    ]
    known = first_rows(reduce(DataFrame.unionByName, tables), ["_kind", "_key"], [F.col("lat").isNull(), F.col("ncei_id")]).drop("ncei_id")
    kind = reduce(lambda a, k: F.when(F.col("id_format").isin(*k[1][0]), k[0]).otherwise(a), enumerate(KEYS), F.lit(None).cast("int"))
    key = reduce(lambda a, k: F.when(F.col("id_format").isin(*k[0]), F.substring("station_id_raw", k[2], k[3])).otherwise(a), KEYS, F.lit(None).cast("string"))
    return coverage.withColumns({"_kind": kind, "_key": key}).join(known, ["_kind", "_key"], "left").drop("_kind", "_key")


def tagged(inventories: dict[str, DataFrame]) -> DataFrame:
    """All station inventories as one table with temporal_resolution."""
    parts = [df.withColumn("temporal_resolution", F.lit(r)) for r, df in inventories.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coverage_by_resolution(inventories: dict[str, DataFrame]) -> DataFrame:
    """(temporal_resolution, earliest_date, latest_date, n_stations, total_rows)."""
    return tagged(inventories).groupBy("temporal_resolution").agg(
        F.min("earliest_dt").alias("earliest_date"), F.max("latest_dt").alias("latest_date"), F.count(F.lit(1)).alias("n_stations"), F.sum("row_count").alias("total_rows")
    )


def located(inventories: dict[str, DataFrame]) -> DataFrame:
    """(temporal_resolution, lat, lon) of the stations with a place."""
    return tagged(inventories).where("lat IS NOT NULL AND lon IS NOT NULL").select("temporal_resolution", "lat", "lon")


def resolution_source_summary(geo: DataFrame) -> DataFrame:
    """Stations, files, rows, GB and dates by resolution and source."""
    return geo.groupBy("temporal_resolution", "source").agg(
        F.countDistinct("station_id_raw").alias("stations"), F.sum("file_count").alias("files"), F.sum("total_rows").alias("total_rows"),
        F.round(F.sum("total_gb"), 2).alias("gb"), F.min("earliest_date").alias("earliest"), F.max("latest_date").alias("latest"),
    )


def quality_by_source(geo: DataFrame) -> DataFrame:
    """Stations, empty files, broken files and spans of less than a year by source."""
    return geo.groupBy("source").agg(
        F.countDistinct("station_id_raw").alias("stations"), F.sum("empty_files").alias("empty"), F.sum("error_files").alias("errors"),
        F.count_if(F.col("years_span") < 1).alias("short"),
    )


def source_breakdown(inventory: DataFrame) -> DataFrame:
    """Files, GB, stations and formats of ids by source; a format that's missing is named UNKNOWN."""
    return inventory.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.round(F.sum("file_size_bytes") / 1e9, 2).alias("gb"), F.countDistinct("station_id_raw").alias("stations"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("id_format", F.lit("UNKNOWN")))), ",").alias("formats"),
    )


def profile_totals(profile: DataFrame) -> DataFrame:
    """(files, total_rows, errors, empty) of a profile."""
    return profile.agg(
        F.count(F.lit(1)).alias("files"), F.sum("total_rows").alias("total_rows"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(~F.col("has_data")).alias("empty")
    )


def unprofiled(inventory: DataFrame, profile: DataFrame) -> DataFrame:
    """Data files of the inventory that have no profile."""
    data = inventory.where("is_data_file AND extension LIKE '%.parquet'")
    return data.join(profile.select("filepath"), "filepath", "left_anti")
