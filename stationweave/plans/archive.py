"""Queries of the archive: inventories, coverage, identities, selections, tidy observations, raw formats, changes by key, windows.

Each query runs over its whole tables and has the SQL that states the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, files as names
from ..functions.temporal import epoch_of
from ..operators import coverage, crosswalk, inventory, selection, tables, tidy
from ..session import materialise
from ..sources import delimited, files, fixed
from ..streaming import refresh
from ..tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    """df with float columns as doubles of n decimals, NaN as NULL, no negative zeros."""
    return df.withColumns({c: F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), n) + F.lit(0.0) for c in columns})


# ---------------------------------------------------------------- inventories

_PLACES = """places AS (SELECT station_id_raw AS station, lat, lon, state FROM (SELECT *, row_number() OVER (PARTITION BY station_id_raw ORDER BY cov_id) AS rn
    FROM station_coverage_geo WHERE lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon)) WHERE rn = 1)"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    geo = read(spark, d, "station_coverage_geo", "cov_id", "station_id_raw", "lat", "lon", "state")
    held = geo.where("lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon)")
    return crosswalk.first_rows(held, ["station_id_raw"], [F.col("cov_id")]).withColumnRenamed("station_id_raw", "station")


@_query(f"""WITH {_PLACES} SELECT d.station AS station_id, lat, lon, state, min(date) AS earliest_dt, max(date) AS latest_dt, count(*) AS row_count,
    count(DISTINCT year(date)) AS file_count FROM obs_daily d JOIN places p ON d.station = p.station GROUP BY ALL""")
def station_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Daily stations with place, first and last day, rows and years."""
    return inventory.daily_inventory(read(spark, d, "obs_daily"), _places(spark, d))


_DAY = "TRY_CAST(CASE WHEN regexp_matches(left(trim(date), 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN left(trim(date), 10) END AS DATE)"


def _dated(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """obs_hourly with dates that aren't written with hyphens as NULL: the inventory reads no others."""
    held = F.when(F.substring(F.trim("date"), 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date"))
    return read(spark, d, "obs_hourly", "station_id", "state", "date", "year", *columns).withColumn("date", held)


@_query(f"""WITH spot AS (SELECT wban, min(struct_pack(a := lat, o := lon)) AS p FROM isd_history WHERE wban IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lat)
    AND lon IS NOT NULL AND NOT isnan(lon) GROUP BY wban),
g AS (SELECT station_id, state, min({_DAY}) AS earliest_dt, max({_DAY}) AS latest_dt, count(*) AS row_count, count(DISTINCT year) AS file_count
    FROM obs_hourly WHERE station_id IS NOT NULL GROUP BY ALL)
SELECT station_id, p.a AS lat, p.o AS lon, state, earliest_dt, latest_dt, row_count, file_count FROM g LEFT JOIN spot ON substring(station_id, 7, 5) = wban""")
def hourly_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Hourly stations by state, with the place of their WBAN in the history list."""
    h = read(spark, d, "isd_history", F.col("wban").alias("wban_id"), F.col("lat").alias("lat_dec"), F.col("lon").alias("lon_dec"))
    return inventory.hourly_inventory(_dated(spark, d), h.where("NOT isnan(lat_dec) AND lon_dec IS NOT NULL AND NOT isnan(lon_dec)"))


_MINUTE = """spot AS (SELECT icao, min(struct_pack(a := lat, o := lon, s := st)) AS p FROM isd_history WHERE icao IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lat)
    AND lon IS NOT NULL AND NOT isnan(lon) AND st IS NOT NULL GROUP BY icao),
f AS (SELECT substring(station_id_raw, 2, 4) AS station_id, min(date_part) AS a, max(date_part) AS b, count(*) AS file_count FROM file_inventory
    WHERE source = 'ASOS' AND subfolder = '1min' AND id_format = 'ICAO_ASOS' AND station_id_raw IS NOT NULL GROUP BY ALL)"""


@_query(f"""WITH {_MINUTE} SELECT station_id, p.a AS lat, p.o AS lon, p.s AS state, TRY_CAST(f.a || '-01' AS DATE) AS earliest_dt, TRY_CAST(b || '-01' AS DATE) AS latest_dt,
    CAST(0 AS BIGINT) AS row_count, file_count FROM f LEFT JOIN spot ON station_id = icao""")
def minute_inventory(spark: SparkSession, d: str) -> DataFrame:
    """One-minute stations, from the catalogue alone."""
    h = read(spark, d, "isd_history", F.col("icao").alias("icao_id"), F.col("lat").alias("lat_dec"), F.col("lon").alias("lon_dec"), F.col("st").alias("state"))
    h = h.where("NOT isnan(lat_dec) AND lon_dec IS NOT NULL AND NOT isnan(lon_dec) AND state IS NOT NULL")
    return inventory.minute_inventory(read(spark, d, "file_inventory"), h)


_PROFILE = """prof AS (SELECT DISTINCT filepath, source, station_id_raw, id_format, CASE WHEN file_size_bytes IS NULL THEN 0 ELSE file_size_bytes // 50 END AS total_rows,
    date_part AS min_datetime, date_part AS max_datetime, coalesce(file_size_bytes // 50 > 0, FALSE) AS has_data,
    CASE WHEN file_size_bytes IS NULL THEN 'no size' END AS error FROM file_inventory WHERE is_data_file),
inv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY file_size_bytes DESC NULLS LAST, station_id_raw NULLS FIRST) AS rn
    FROM file_inventory WHERE is_data_file AND station_id_raw IS NOT NULL AND station_id_raw <> '') WHERE rn = 1)"""


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """A profile of the catalogue's data files: 50 bytes a row, dates as the file names say."""
    f = read(spark, d, "file_inventory").where("is_data_file")
    n = F.coalesce(F.floor(F.col("file_size_bytes") / 50), F.lit(0))
    return f.select(
        "filepath", "source", "station_id_raw", "id_format", n.alias("total_rows"), F.col("date_part").alias("min_datetime"), F.col("date_part").alias("max_datetime"),
        (n > 0).alias("has_data"), F.when(F.col("file_size_bytes").isNull(), "no size").alias("error"),
    ).distinct()


_RES = """CASE WHEN i.source = 'ASOS' AND subfolder = '1min' THEN '1min' WHEN i.source = 'ASOS' AND subfolder = '15min' THEN '15min'
    WHEN i.source = 'GHCNd' THEN 'daily' WHEN i.source = 'GHCNh' THEN 'hourly' ELSE 'other' END"""


@_query(f"""WITH {_PROFILE} SELECT i.station_id_raw, i.id_format, i.source, {_RES} AS temporal_resolution, count(*) AS file_count,
    CAST(sum(p.total_rows) AS BIGINT) AS total_rows, round(sum(file_size_bytes) / 1e9, 3) AS total_gb, min(min_datetime) AS earliest_date, max(max_datetime) AS latest_date,
    TRY_CAST(left(max(max_datetime), 4) AS INT) - TRY_CAST(left(min(min_datetime), 4) AS INT) AS years_span,
    CAST(sum(CASE WHEN NOT has_data THEN 1 ELSE 0 END) AS BIGINT) AS empty_files, CAST(sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS error_files
FROM inv i JOIN prof p ON i.filepath = p.filepath GROUP BY ALL""")
def station_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the archive has of each station, by source and resolution."""
    return inventory.station_coverage(read(spark, d, "file_inventory"), _profile(spark, d))


def _cov(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "station_coverage_geo", "cov_id", "station_id_raw", "id_format", "source", "temporal_resolution")


_BY = """(SELECT {0} AS join_key, station_name, state, county, lat_dec AS lat, lon_dec AS lon, elev_m FROM (SELECT *, row_number() OVER (PARTITION BY {0}
    ORDER BY lat_dec IS NOT NULL DESC, ncei_id) AS rn FROM master_station_list WHERE {0} IS NOT NULL AND {0} <> '') WHERE rn = 1)"""


@_query(f"""SELECT c.cov_id, c.station_id_raw, c.id_format, c.source, c.temporal_resolution, coalesce(a.station_name, b.station_name, u.station_name) AS station_name,
    coalesce(a.state, b.state, u.state) AS state, coalesce(a.county, b.county, u.county) AS county, round(coalesce(a.lat, b.lat, u.lat), 6) AS lat,
    round(coalesce(a.lon, b.lon, u.lon), 6) AS lon, round(coalesce(a.elev_m, b.elev_m, u.elev_m), 6) AS elev_m FROM station_coverage_geo c
LEFT JOIN {_BY.format("ghcnd_ids")} a ON c.id_format IN ('GHCND_DLY', 'GHCND_HPD', 'GHCND') AND c.station_id_raw = a.join_key
LEFT JOIN {_BY.format("icao_ids")} b ON c.id_format = 'ICAO_ASOS' AND substring(c.station_id_raw, 2, 4) = b.join_key
LEFT JOIN {_BY.format("usaf_id")} u ON c.id_format IN ('USAF_WBAN', 'ASOS_A') AND substring(c.station_id_raw, 1, 6) = u.join_key""")
def geo_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Coverage rows with the name and place of the station that their id names."""
    return _r(inventory.with_places(_cov(spark, d), read(spark, d, "master_station_list")), "lat", "lon", "elev_m")


def _inventories(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"daily": station_inventory(spark, d), "hourly": hourly_inventory(spark, d), "1min": minute_inventory(spark, d)}


def _all_inventories() -> str:
    parts = {"daily": ORACLE["station_inventory"], "hourly": ORACLE["hourly_inventory"], "1min": ORACLE["minute_inventory"]}
    return " UNION ALL BY NAME ".join(f"SELECT '{r}' AS temporal_resolution, * FROM ({q})" for r, q in parts.items())


@_query(f"""SELECT temporal_resolution, min(earliest_dt) AS earliest_date, max(latest_dt) AS latest_date, count(*) AS n_stations, CAST(sum(row_count) AS BIGINT) AS total_rows
FROM ({_all_inventories()}) GROUP BY ALL""")
def coverage_by_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The inventories of all resolutions, summed up."""
    return inventory.coverage_by_resolution(_inventories(spark, d))


@_query(f"SELECT temporal_resolution, lat, lon FROM ({_all_inventories()}) WHERE lat IS NOT NULL AND lon IS NOT NULL")
def located_stations(spark: SparkSession, d: str) -> DataFrame:
    """The places of all inventories."""
    return inventory.located(_inventories(spark, d))


@_query("""SELECT temporal_resolution, source, count(DISTINCT station_id_raw) AS stations, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(total_rows) AS BIGINT) AS total_rows,
    round(sum(total_gb), 2) AS gb, min(earliest_date) AS earliest, max(latest_date) AS latest FROM station_coverage_geo GROUP BY ALL""")
def resolution_source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Stations, files, rows and dates by resolution and source."""
    return inventory.resolution_source_summary(read(spark, d, "station_coverage_geo"))


@_query("""SELECT source, count(DISTINCT station_id_raw) AS stations, CAST(sum(empty_files) AS BIGINT) AS empty, CAST(sum(error_files) AS BIGINT) AS errors,
    CAST(sum(CASE WHEN years_span < 1 THEN 1 ELSE 0 END) AS BIGINT) AS short FROM station_coverage_geo GROUP BY source""")
def quality_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Empty and broken files and short records by source."""
    return inventory.quality_by_source(read(spark, d, "station_coverage_geo"))


@_query("""SELECT source, count(*) AS files, round(sum(file_size_bytes) / 1e9, 2) AS gb, count(DISTINCT station_id_raw) AS stations,
    string_agg(DISTINCT coalesce(id_format, 'UNKNOWN'), ',' ORDER BY coalesce(id_format, 'UNKNOWN')) AS formats FROM file_inventory GROUP BY source""")
def source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Files, GB, stations and id formats by source."""
    return inventory.source_breakdown(read(spark, d, "file_inventory"))


@_query(f"""WITH {_PROFILE} SELECT count(*) AS files, CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(count(error) AS BIGINT) AS errors,
    CAST(sum(CASE WHEN NOT has_data THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM prof""")
def profile_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, rows, errors and empty files of the profile."""
    return inventory.profile_totals(_profile(spark, d))


@_query("""SELECT file_id, filepath FROM file_inventory f WHERE is_data_file AND extension LIKE '%.parquet'
    AND NOT EXISTS (SELECT 1 FROM file_inventory p WHERE p.filepath = f.filepath AND p.file_size_bytes > 1000)""")
def unprofiled_files(spark: SparkSession, d: str) -> DataFrame:
    """Data files without a profile, where only files above 1000 bytes have one."""
    f = read(spark, d, "file_inventory")
    return inventory.unprofiled(f, f.where("file_size_bytes > 1000").select("filepath")).select("file_id", "filepath")


# ---------------------------------------------------------------- coverage analytics

_COUNTS = ", ".join(f"CAST(sum(CASE WHEN temporal_resolution = '{r}' THEN 1 ELSE 0 END) AS BIGINT) AS s_{r}" for r in coverage.RESOLUTIONS)


@_query(f"""SELECT state, {_COUNTS}, count(*) AS total FROM station_coverage_geo WHERE state IS NOT NULL AND state <> '' GROUP BY state ORDER BY total DESC, state LIMIT 20""")
def state_resolution_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The twenty states of most stations, by resolution."""
    return coverage.by_state(read(spark, d, "station_coverage_geo", "state", "temporal_resolution"))


@_query("SELECT state, " + ", ".join(f"count(DISTINCT CASE WHEN temporal_resolution = '{r}' THEN station_id_raw END) AS \"{r}\"" for r in coverage.RESOLUTIONS)
    + f" FROM station_coverage_geo WHERE state IN ({', '.join(repr(s) for s in coverage.STATES)}) GROUP BY state")
def stations_by_state(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stations by state and resolution."""
    return coverage.stations_by_state(read(spark, d, "station_coverage_geo"))


_SPAN = "TRY_CAST(left(earliest_date, 4) AS INT) AS a, TRY_CAST(left(latest_date, 4) AS INT) AS b"


@_query(f"""WITH s AS (SELECT temporal_resolution, {_SPAN} FROM station_coverage_geo), y AS (SELECT CAST(unnest(range(1900, 2027)) AS INT) AS year)
SELECT temporal_resolution, year, count(*) AS stations FROM s JOIN y ON a <= year AND b >= year GROUP BY ALL""")
def active_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Stations with data of each year, by resolution."""
    return coverage.active_per_year(read(spark, d, "station_coverage_geo"))


@_query(f"""WITH s AS (SELECT temporal_resolution AS r, {_SPAN} FROM station_coverage_geo), t AS (SELECT CAST(unnest(range(1900, 2030, 10)) AS INT) AS decade)
SELECT decade, {", ".join(f"CAST(sum(CASE WHEN r = '{r}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{r}\"" for r in coverage.RESOLUTIONS)} FROM s JOIN t ON a <= decade + 9 AND b >= decade GROUP BY decade""")
def decade_density(spark: SparkSession, d: str) -> DataFrame:
    """Stations with data in each decade, by resolution."""
    return coverage.decade_density(read(spark, d, "station_coverage_geo"))


_AT = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"


@_query(f"""SELECT lat, lon, CAST(count(DISTINCT temporal_resolution) AS INT) AS n_res, CASE WHEN count(DISTINCT temporal_resolution) > 1 THEN 'multi' ELSE min(temporal_resolution) END AS dominant
FROM station_coverage_geo WHERE {_AT} GROUP BY lat, lon""")
def resolutions_by_place(spark: SparkSession, d: str) -> DataFrame:
    """How many resolutions each place has, and which."""
    return coverage.resolutions_by_place(read(spark, d, "station_coverage_geo"))


@_query(f"SELECT least(CAST(floor(quantile_cont(years_span, 0.98)) AS INT) + 1, 130) AS cap FROM station_coverage_geo WHERE {_AT}")
def span_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The cap of the years of record: their 0.98 quantile."""
    return coverage.span_cap(read(spark, d, "station_coverage_geo"))


@_query("""SELECT temporal_resolution, CAST(floor((lon + 126.0) / 0.5) AS INT) AS cell_lon, CAST(floor((lat - 23.0) / 0.5) AS INT) AS cell_lat, CAST(sum(greatest(total_rows, 0)) AS BIGINT) AS total_rows
FROM station_coverage_geo WHERE lat > 23 AND lat < 51 AND lon > -126 AND lon < -65 AND total_rows IS NOT NULL GROUP BY ALL HAVING sum(greatest(total_rows, 0)) > 0""")
def grid_density(spark: SparkSession, d: str) -> DataFrame:
    """Rows per half-degree cell."""
    return coverage.density(read(spark, d, "station_coverage_geo"))


@_query("""WITH t AS (SELECT icao, epoch_us(timestamp_utc) // 1000000 AS t FROM obs_1min WHERE icao IS NOT NULL AND timestamp_utc IS NOT NULL),
g AS (SELECT icao, t, (t - lag(t) OVER (PARTITION BY icao ORDER BY t)) / 60.0 AS minutes FROM t)
SELECT icao, t, round(minutes, 6) AS minutes FROM g WHERE minutes > 0 AND minutes < 50""")
def gap_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Readings less than 50 minutes after the one before."""
    return _r(coverage.gaps(read(spark, d, "obs_1min", "icao", "timestamp_utc"), "icao", epoch_of(F.col("timestamp_utc"))), "minutes")


@_query("""SELECT lat, lon, round(avg(CAST(file_count AS DOUBLE)), 6) AS file_count, round(avg(CAST(years_span AS DOUBLE)), 6) AS years_span FROM station_coverage_geo
WHERE lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon) GROUP BY lat, lon""")
def spatial_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means of files and years by place."""
    df = read(spark, d, "station_coverage_geo").where("lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon)")
    return _r(coverage.mean_by_place(df, "lat", "lon", ["file_count", "years_span"]), "file_count", "years_span")


@_query(f"""SELECT CAST(floor(lat) AS INT) AS cell_lat, CAST(floor(lon) AS INT) AS cell_lon, round(avg(file_count), 5) AS file_count, round(avg(years_span), 5) AS years_span
FROM ({ORACLE["spatial_mean"]}) WHERE lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66 GROUP BY ALL""")
def raster_mean(spark: SparkSession, d: str) -> DataFrame:
    """The same means by one-degree cell, within a rough box of the country."""
    df = spatial_mean(spark, d).where(selection.in_box(F.col("lat"), F.col("lon"), "usa_rough"))
    return _r(coverage.raster(df, "lat", "lon", ["file_count", "years_span"]), "file_count", "years_span", n=5)


@_query("SELECT state, count(*) AS n FROM master_station_list GROUP BY state ORDER BY n DESC, state NULLS LAST LIMIT 20")
def top_states_nulls(spark: SparkSession, d: str) -> DataFrame:
    """The states of most stations, those without a state as a group."""
    return coverage.top_states(read(spark, d, "master_station_list", "state"))


# ---------------------------------------------------------------- identities

_HIST = """hist AS (SELECT coalesce(nullif(trim(station_name), ''), 'none') AS ncei_id, station_name, st AS state, TRY_STRPTIME(begin_dt, '%Y%m%d')::DATE AS begin_date,
    TRY_STRPTIME(end_dt, '%Y%m%d')::DATE AS end_date, coalesce(end_dt LIKE '9999%', FALSE) AS is_active, nullif(nullif(wban, '99999'), '') AS wban_id, nullif(icao, '') AS icao_id, lat AS lat_dec, lon AS lon_dec, hist_id FROM isd_history)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    """The history list as periods of stations, told apart by name."""
    text = lambda c: F.nullif(c, F.lit(""))
    day = lambda c: F.when(F.col(c).rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)).try_cast("date"))
    no = F.lit(None).cast("string")
    return read(spark, d, "isd_history").select(
        F.coalesce(text(F.trim("station_name")), F.lit("none")).alias("ncei_id"), "station_name", F.col("st").alias("state"), no.alias("county"), F.col("ctry").alias("country_code"),
        F.col("lat").alias("lat_dec"), F.col("lon").alias("lon_dec"), "elev_m", no.alias("station_type"), F.coalesce(F.col("end_dt").startswith("9999"), F.lit(False)).alias("is_active"),
        F.lit(True).alias("has_coordinates"), day("begin_dt").alias("begin_date"), day("end_dt").alias("end_date"), text(F.nullif("wban", F.lit("99999"))).alias("wban_id"),
        text(F.col("icao")).alias("icao_id"), *[no.alias(f"{k}_id") for k in ("ghcnd", "coop", "hpd", "wmo", "faa", "nwsli")],
    )


@_query(f"""WITH {_HIST} SELECT ncei_id, string_agg(DISTINCT wban_id, '|' ORDER BY wban_id) FILTER (WHERE wban_id IS NOT NULL) AS wban_ids,
    string_agg(DISTINCT icao_id, '|' ORDER BY icao_id) FILTER (WHERE icao_id IS NOT NULL) AS icao_ids, bool_or(is_active) AS is_active FROM hist GROUP BY ncei_id""")
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each station once, with the ids of all its periods."""
    return crosswalk.collapsed_history(_history(spark, d)).select("ncei_id", "wban_ids", "icao_ids", "is_active")


@_query("""SELECT hist_id, usaf, wban, end_dt FROM (SELECT *, row_number() OVER (PARTITION BY wban ORDER BY end_dt DESC NULLS LAST, hist_id) AS rn FROM isd_history) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Of each WBAN the entry that ends last."""
    h = read(spark, d, "isd_history", "hist_id", "usaf", "wban", "end_dt")
    return crosswalk.latest_per_key(h, ["wban"], [F.col("end_dt").desc_nulls_last(), F.col("hist_id")])


_ICAO = """icaos AS (SELECT substring(station_id_raw, 2, 4) AS icao, count(*) AS file_count, round(sum(file_size_bytes) / 1e9, 3) AS data_gb, min(date_part) AS earliest_date, max(date_part) AS latest_date
    FROM file_inventory WHERE source = 'ASOS' AND subfolder = '1min' AND id_format = 'ICAO_ASOS' GROUP BY ALL)"""


@_query(f"""WITH {_ICAO} SELECT ncei_id, CAST(sum(file_count) AS BIGINT) AS asos_1min_files, min(earliest_date) AS asos_1min_start, max(latest_date) AS asos_1min_end FROM master_station_list m
LEFT JOIN icaos a ON m.icao_ids = a.icao OR m.icao_ids LIKE a.icao || '|%' OR m.icao_ids LIKE '%|' || a.icao OR m.icao_ids LIKE '%|' || a.icao || '|%' GROUP BY ncei_id""")
def membership_join(spark: SparkSession, d: str) -> DataFrame:
    """One-minute files of each station whose list of airport codes names them."""
    total = [F.sum("file_count").alias("asos_1min_files"), F.min("earliest_date").alias("asos_1min_start"), F.max("latest_date").alias("asos_1min_end")]
    m = crosswalk.with_membership(read(spark, d, "master_station_list", "ncei_id", "icao_ids"), "ncei_id", "icao_ids", crosswalk.minute_sources(read(spark, d, "file_inventory")), "icao", total)
    return m.select("ncei_id", "asos_1min_files", "asos_1min_start", "asos_1min_end")


@_query("""SELECT cov_id, station_id_raw FROM station_coverage_geo c WHERE NOT EXISTS (SELECT 1 FROM (SELECT regexp_replace(trim(ghcnd_ids), '\\s*[|]\\s*', '|', 'g') AS ghcnd_ids FROM master_station_list) m WHERE m.ghcnd_ids IS NOT NULL AND
    (m.ghcnd_ids = c.station_id_raw OR starts_with(m.ghcnd_ids, c.station_id_raw || '|') OR ends_with(m.ghcnd_ids, '|' || c.station_id_raw) OR contains(m.ghcnd_ids, '|' || c.station_id_raw || '|')))""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Coverage rows whose id is in no station's list."""
    c = read(spark, d, "station_coverage_geo", "cov_id", "station_id_raw")
    return crosswalk.without_member(c, "station_id_raw", read(spark, d, "master_station_list", "ncei_id", "ghcnd_ids"), "ncei_id", "ghcnd_ids")


@_query("SELECT DISTINCT station AS station_id FROM obs_daily WHERE station IS NOT NULL AND station NOT IN (SELECT station_id FROM obs_hourly WHERE station_id IS NOT NULL AND temperature_c > 30)")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stations of the daily table that no warm hourly reading knows."""
    hot = read(spark, d, "obs_hourly", "station_id", "temperature_c").where("temperature_c > 30")
    return crosswalk.known_before_new(hot, read(spark, d, "obs_daily", F.col("station").alias("station_id")).where("station_id IS NOT NULL"), "station_id")


_TWO = """WITH dly AS (SELECT station AS station_id, count(*) AS n FROM obs_daily WHERE station IS NOT NULL GROUP BY station), cov AS (SELECT station_id_raw AS station_id, min(state) AS s FROM station_coverage_geo
    WHERE station_id_raw IS NOT NULL GROUP BY ALL)"""


@_query(f"{_TWO} SELECT station_id AS ncei_id, (dly.n IS NOT NULL) AS has_ghcn_daily, (cov.station_id IS NOT NULL) AS has_ncei_15min, station_id AS ghcnd_ids FROM dly FULL OUTER JOIN cov USING (station_id)")
def master_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """The master list without a history: stations of the daily table and of the coverage."""
    no = [F.lit(None).cast("double").alias(c) for c in ("lat", "lon")]
    dly = read(spark, d, "obs_daily", F.col("station").alias("station_id"), F.lit(None).cast("string").alias("state"), *no)
    cov = read(spark, d, "station_coverage_geo", F.col("station_id_raw").alias("station_id"), "state", *no)
    return crosswalk.fallback_master(dly, cov).select("ncei_id", "has_ghcn_daily", "has_ncei_15min", "ghcnd_ids")


def _at(c: str) -> str:
    return f"{c} IS NOT NULL AND NOT isnan({c})"


@_query(f"""WITH n AS (SELECT h.hist_id, m.ncei_id, abs(m.lat_dec - h.lat) + abs(m.lon_dec - h.lon) AS dist FROM isd_history h JOIN master_station_list m ON abs(m.lat_dec - h.lat) <= 0.01 AND abs(m.lon_dec - h.lon) <= 0.01
    WHERE {" AND ".join(map(_at, ("m.lat_dec", "m.lon_dec", "h.lat", "h.lon")))})
SELECT hist_id, ncei_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY hist_id ORDER BY dist, ncei_id) AS rn FROM n) WHERE rn = 1""")
def proximity_match(spark: SparkSession, d: str) -> DataFrame:
    """For each history entry the nearest master station within a hundredth of a degree."""
    h = read(spark, d, "isd_history", "hist_id", "lat", "lon").where("NOT isnan(lat) AND NOT isnan(lon)")
    m = read(spark, d, "master_station_list", "ncei_id", F.col("lat_dec").alias("lat"), F.col("lon_dec").alias("lon")).where("NOT isnan(lat) AND NOT isnan(lon)")
    return _r(crosswalk.nearest_within(h, "hist_id", m, "ncei_id"), "dist")


_XIDS = ("usaf", "wban", "icao")


@_query(" UNION ALL ".join(f"SELECT hist_id, station_name, '{c.upper()}' AS id_type, {c} AS id_value FROM isd_history WHERE {c} IS NOT NULL" for c in _XIDS), name="crosswalk")
def crosswalk_melt(spark: SparkSession, d: str) -> DataFrame:
    """A row per id of each history entry."""
    h = read(spark, d, "isd_history", "hist_id", "station_name", *[F.col(c).alias(f"{c}_id") for c in _XIDS])
    return crosswalk.crosswalk(h, "hist_id", ["station_name"], [f"{c}_id" for c in _XIDS])


@_query("SELECT c AS column_name, n AS n_null, round(n / t, 6) AS null_rate FROM (SELECT count(*) AS t, "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("state", "county", "wban_ids", "icao_ids", "usaf_id")) + " FROM master_station_list) UNPIVOT INCLUDE NULLS (n FOR c IN (state, county, wban_ids, icao_ids, usaf_id))")
def null_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often columns of the master list are NULL."""
    return _r(crosswalk.missing_rates(read(spark, d, "master_station_list"), ["state", "county", "wban_ids", "icao_ids", "usaf_id"]), "null_rate")


def _master(spark: SparkSession, d: str) -> DataFrame:
    inv = _inventories(spark, d)
    c = read(spark, d, "station_coverage_geo", F.col("station_id_raw").alias("station_id"), "state", "lat", "lon", "file_count", "temporal_resolution")
    quarter = c.where("temporal_resolution = '15min'").groupBy("station_id").agg(F.min("state").alias("state"), F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.sum("file_count").alias("file_count"))
    return crosswalk.master_list(
        crosswalk.collapsed_history(_history(spark, d)), crosswalk.minute_sources(read(spark, d, "file_inventory")), inv["hourly"], quarter, inv["daily"]
    )


@_query(f"""WITH {_HIST}, {_ICAO}, ids AS (SELECT DISTINCT ncei_id, icao_id, wban_id FROM hist),
one AS (SELECT ncei_id, CAST(sum(file_count) AS BIGINT) AS f FROM (SELECT DISTINCT ncei_id, icao_id FROM ids WHERE icao_id IS NOT NULL) i JOIN icaos ON icao_id = icao GROUP BY ncei_id),
hr AS (SELECT ncei_id, CAST(sum(file_count) AS BIGINT) AS f FROM (SELECT DISTINCT ncei_id, wban_id FROM ids WHERE wban_id IS NOT NULL) i JOIN
    ({ORACLE["hourly_inventory"]}) h ON substring(h.station_id, 7, 5) = wban_id GROUP BY ncei_id),
st AS (SELECT DISTINCT ncei_id FROM hist),
q AS (SELECT station_id_raw AS ncei_id, CAST(sum(file_count) AS BIGINT) AS f FROM station_coverage_geo WHERE temporal_resolution = '15min' AND station_id_raw IS NOT NULL GROUP BY ALL)
SELECT ncei_id, one.f IS NOT NULL AS has_asos_1min, one.f AS asos_1min_files, hr.f IS NOT NULL AS has_asos_isd, hr.f AS asos_isd_files, FALSE AS has_ncei_15min, NULL AS ncei_files, TRUE AS homr_matched, NULL AS source_if_orphan
FROM st LEFT JOIN one USING (ncei_id) LEFT JOIN hr USING (ncei_id)
UNION ALL SELECT ncei_id, NULL, NULL, NULL, NULL, TRUE, f, FALSE, 'NCEI_15MIN_FALLBACK' FROM q""")
def master_list(spark: SparkSession, d: str) -> DataFrame:
    """The master list built from the history, with what each resolution has, and the 15-minute stations that it misses."""
    return _master(spark, d).select("ncei_id", "has_asos_1min", "asos_1min_files", "has_asos_isd", "asos_isd_files", "has_ncei_15min", "ncei_files", "homr_matched", "source_if_orphan")


# ---------------------------------------------------------------- selections

_LOADED = """loaded AS (SELECT ncei_id, station_name, state, lat_dec AS lat, lon_dec AS lon, coalesce(has_asos_1min, FALSE) AS m, coalesce(has_ncei_15min, FALSE) AS q, coalesce(has_asos_isd, FALSE) AS h,
    coalesce(has_ghcn_daily, FALSE) AS dd, coalesce(asos_1min_files, 0) AS fm, coalesce(ncei_files, 0) AS fq, coalesce(asos_isd_files, 0) AS fh, coalesce(ghcn_daily_files, 0) AS fd, * EXCLUDE (ncei_id, station_name, state)
    FROM master_station_list WHERE lat_dec IS NOT NULL AND NOT isnan(lat_dec) AND lon_dec IS NOT NULL AND NOT isnan(lon_dec)
    AND (coalesce(has_asos_1min, FALSE) OR coalesce(has_ncei_15min, FALSE) OR coalesce(has_asos_isd, FALSE) OR coalesce(has_hpd_1hr, FALSE) OR coalesce(has_ghcn_daily, FALSE)))"""


def _ids(column: str, key: str, table: str, has: str) -> str:
    return f"""SELECT ncei_id, year(min(earliest_dt)) AS a, year(max(latest_dt)) AS b FROM (SELECT ncei_id, trim(unnest(string_split({column}, '|'))) AS id FROM loaded WHERE {has}) JOIN ({table}) i ON id = {key} GROUP BY ncei_id"""


_YEARS = f"""{_LOADED},
yd AS ({_ids("ghcnd_ids", "i.station_id", ORACLE["station_inventory"], "dd")}), yh AS ({_ids("wban_ids", "right(i.station_id, 5)", ORACLE["hourly_inventory"], "h")}),
ym AS ({_ids("icao_ids", "i.station_id", ORACLE["minute_inventory"], "m")}),
s AS (SELECT l.*, CAST(CASE WHEN dd THEN coalesce(yd.a, 1950) ELSE 1950 END AS INT) AS d1, CAST(CASE WHEN dd THEN coalesce(yd.b, 2026) ELSE 2026 END AS INT) AS d2,
    CAST(CASE WHEN h THEN coalesce(yh.a, 1930) ELSE 1930 END AS INT) AS h1, CAST(CASE WHEN h THEN coalesce(yh.b, 2026) ELSE 2026 END AS INT) AS h2,
    CAST(CASE WHEN m THEN coalesce(ym.a, TRY_CAST(left(asos_1min_start, 4) AS INT), 2000) ELSE 2000 END AS INT) AS m1, CAST(CASE WHEN m THEN coalesce(ym.b, TRY_CAST(left(asos_1min_end, 4) AS INT), 2026) ELSE 2026 END AS INT) AS m2
    FROM loaded l LEFT JOIN yd USING (ncei_id) LEFT JOIN yh USING (ncei_id) LEFT JOIN ym USING (ncei_id))"""


def _stations(spark: SparkSession, d: str, years: bool = False) -> selection.Stations:
    """Usable stations; with the inventories' years where a query asks for years."""
    m = read(spark, d, "master_station_list").where("NOT isnan(lat_dec) AND NOT isnan(lon_dec)")
    return selection.Stations(selection.load(m, _inventories(spark, d) if years else {}))


@_query(f"""WITH {_YEARS} SELECT ncei_id, d1 AS daily_start_year, d2 AS daily_end_year, h1 AS hourly_start_year, h2 AS hourly_end_year, m1 AS "1min_start_year", m2 AS "1min_end_year",
    coalesce(least(CASE WHEN dd THEN d1 END, CASE WHEN h THEN h1 END, CASE WHEN q THEN 1970 END, CASE WHEN m THEN m1 END), 1900) AS data_start,
    coalesce(greatest(CASE WHEN dd THEN d2 END, CASE WHEN h THEN h2 END, CASE WHEN q THEN 2026 END, CASE WHEN m THEN m2 END), 2026) AS data_end,
    CASE WHEN m THEN '1min' WHEN q THEN '15min' WHEN h THEN 'hourly' WHEN dd THEN 'daily' ELSE 'none' END AS dominant_res FROM s""")
def station_years(spark: SparkSession, d: str) -> DataFrame:
    """Usable stations with the years of each resolution and their finest resolution."""
    years = [f"{r}_{s}_year" for r in ("daily", "hourly", "1min") for s in ("start", "end")]
    return _stations(spark, d, years=True).df.select("ncei_id", *years, "data_start", "data_end", "dominant_res")


@_query("""SELECT ncei_id, CASE WHEN coalesce(has_asos_1min, FALSE) THEN '1min' WHEN coalesce(has_ncei_15min, FALSE) THEN '15min' WHEN coalesce(has_asos_isd, FALSE) THEN 'hourly'
    WHEN coalesce(has_ghcn_daily, FALSE) THEN 'daily' ELSE 'none' END AS dominant_res FROM master_station_list""")
def dominant_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The finest resolution of every station."""
    best = decode.dominant_resolution(*[F.col(selection.RESOLUTIONS[r][0]) for r in ("1min", "15min", "hourly", "daily")])
    return read(spark, d, "master_station_list").select("ncei_id", best.alias("dominant_res"))


@_query(f"WITH {_YEARS} SELECT ncei_id FROM s WHERE (dd AND d1 <= 2022 AND d2 >= 2021) OR (m AND m1 <= 2022 AND m2 >= 2021)")
def year_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stations with daily or one-minute data of 2021 or 2022."""
    return _stations(spark, d, years=True).with_data(["daily", "1min"], 2021, 2022).df.select("ncei_id")


_PICKED = "WITH " + _LOADED + " SELECT ncei_id FROM loaded WHERE "
_KM = "2 * 6371.0 * asin(sqrt(least(greatest(power(sin(radians(lat - 38.0) / 2), 2) + cos(radians(38.0)) * cos(radians(lat)) * power(sin(radians(lon + 98.0) / 2), 2), 0.0), 1.0)))"


@_query(_PICKED + f"{_KM} <= 800")
def within_radius(spark: SparkSession, d: str) -> DataFrame:
    """Stations within 800 km of a place."""
    return _stations(spark, d).within_km(38.0, -98.0, 800.0).df.select("ncei_id")


@_query(_PICKED + "lat > 23 AND lat < 51 AND lon > -126 AND lon < -65")
def within_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Stations of the contiguous states' box."""
    return _stations(spark, d).in_box("conus").df.select("ncei_id")


#: A concave quadrilateral: a triangle with a bite out of its southern side.
RING = [(-120.0, 25.0), (-95.0, 37.5), (-70.0, 25.0), (-95.0, 52.5)]


@_query(_PICKED + """lat > 25 AND ((lon <= -95 AND lat > 25 + (lon + 120) * 0.5 AND lat < 25 + (lon + 120) * 1.1) OR (lon > -95 AND lat > 25 + (-70 - lon) * 0.5 AND lat < 25 + (-70 - lon) * 1.1))""")
def within_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Stations inside a concave polygon."""
    return _stations(spark, d).within_polygon(RING).df.select("ncei_id")


@_query("WITH " + _LOADED + ", p AS (SELECT lat AS a, lon AS o FROM loaded ORDER BY ncei_id LIMIT 1) SELECT ncei_id FROM loaded, p WHERE sqrt(power(lat - (a + 0.001), 2) + power(lon - (o - 0.002), 2)) < 0.01 "
    "ORDER BY sqrt(power(lat - (a + 0.001), 2) + power(lon - (o - 0.002), 2)), ncei_id LIMIT 1")  # fmt: skip
def nearest_station(spark: SparkSession, d: str) -> DataFrame:
    """The station at a clicked place: near the first station by id."""
    s = _stations(spark, d)
    p = s.df.select("ncei_id", "lat", "lon").orderBy("ncei_id").first()
    return s.nearest(p["lat"] + 0.001, p["lon"] - 0.002).df.select("ncei_id")


@_query("WITH " + _LOADED + ", x AS (SELECT * FROM loaded WHERE state IN ('TX', 'KS', 'CO')) SELECT count(*) AS stations, CAST(sum(CASE WHEN m THEN fm ELSE 0 END + CASE WHEN dd THEN fd ELSE 0 END) AS BIGINT) AS files, "
    "round(sum(CASE WHEN m THEN fm ELSE 0 END * CAST(0.000463 AS DOUBLE) + CASE WHEN dd THEN fd ELSE 0 END * CAST(0.0001 AS DOUBLE)), 6) AS gb FROM x")  # fmt: skip
def size_estimate(spark: SparkSession, d: str) -> DataFrame:
    """What an extraction from three states would read."""
    return _r(_stations(spark, d).in_states(["TX", "KS", "CO"]).size_gb(["1min", "daily"]), "gb")


@_query("WITH " + _LOADED + " SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM loaded")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    """The mean place of the usable stations."""
    return _r(_stations(spark, d).centre(), "lat", "lon")


@_query("WITH " + _LOADED + " SELECT ncei_id, state, station_name FROM loaded ORDER BY state NULLS LAST, station_name NULLS LAST, ncei_id LIMIT 500")
def station_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 stations by state and name."""
    return _stations(spark, d).preview().select("ncei_id", "state", "station_name")


@_query("WITH " + _LOADED + " SELECT ncei_id FROM loaded SEMI JOIN (SELECT DISTINCT ncei_id FROM master_station_list WHERE starts_with(ghcnd_ids, 'USW')) USING (ncei_id)")
def selection_sync(spark: SparkSession, d: str) -> DataFrame:
    """Usable stations that another selection holds."""
    other = read(spark, d, "master_station_list", "ncei_id", "ghcnd_ids").where(F.col("ghcnd_ids").startswith("USW"))
    return _stations(spark, d).of_ids(other).df.select("ncei_id")


# ---------------------------------------------------------------- tidy observations

_META = """meta AS (SELECT id, station_name, state, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ncei_id) AS rn FROM (SELECT DISTINCT ncei_id, station_name, state, lat_dec AS lat, lon_dec AS lon,
    trim(unnest(string_split({0}, '|'))) AS id FROM master_station_list WHERE {0} IS NOT NULL) WHERE id <> '') WHERE rn = 1)"""


def _meta(spark: SparkSession, d: str, resolution: str) -> DataFrame:
    m = read(spark, d, "master_station_list").withColumnsRenamed({"lat_dec": "lat", "lon_dec": "lon"})
    return tidy.station_meta(m, resolution)


def _tidy_sql(rows: str, ids: str, resolution: str, source: str) -> str:
    return f"""WITH {_META.format(ids)}, rows AS ({rows}) SELECT station_id, station_name, state, CASE WHEN NOT isnan(lat) THEN round(lat, 6) END AS lat, CASE WHEN NOT isnan(lon) THEN round(lon, 6) END AS lon, datetime, '{resolution}' AS resolution, variable, round(value, 6) + 0.0 AS value, unit,
    '{source}' AS source, quality_flag FROM rows LEFT JOIN meta ON station_id = id WHERE value IS NOT NULL AND NOT isnan(value)"""


_TIDY_DAILY = _tidy_sql(
    " UNION ALL ".join(f"SELECT station AS station_id, CAST(date AS VARCHAR) AS datetime, '{c.upper()}' AS variable, {c} AS value, '{u}' AS unit, '' AS quality_flag FROM obs_daily WHERE year(date) BETWEEN 2022 AND 2023"
        for c, u in (("prcp", "mm"), ("tmax", "degC"), ("tmin", "degC"), ("tavg", "degC"))), "ghcnd_ids", "daily", "GHCN")


@_query(_TIDY_DAILY)
def tidy_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily observations of 2022 and 2023, tidy."""
    o = read(spark, d, "obs_daily").withColumnRenamed("station", "station_id")
    return _r(tidy.Observations(o, "daily").years(2022, 2023).tidy(_meta(spark, d, "daily")), "lat", "lon", "value")


_TIDY_HOURLY = _tidy_sql(
    " UNION ALL ".join(f"SELECT substring(station_id, 7, 5) AS station_id, date AS datetime, '{v}' AS variable, CAST({c} AS DOUBLE) AS value, '{u}' AS unit, coalesce({q}, '') AS quality_flag FROM obs_hourly"
        for c, (v, u, q) in tidy.HOURLY_VARIABLES.items()), "wban_ids", "hourly", "ASOS_ISD")


@_query(_TIDY_HOURLY)
def tidy_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly observations, tidy."""
    return _r(tidy.hourly(read(spark, d, "obs_hourly"), _meta(spark, d, "hourly")), "lat", "lon", "value")


_TIDY_MINUTE = _tidy_sql(
    """SELECT icao AS station_id, strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') AS datetime, 'precip_1min_in' AS variable, precip_in * 25.4 AS value, 'mm' AS unit, '' AS quality_flag FROM obs_1min
    UNION ALL SELECT icao, strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S'), 'air_temp', (temp_f - 32) * 5 / 9, 'degC', '' FROM obs_1min""", "icao_ids", "1min", "ASOS")  # fmt: skip


@_query(_TIDY_MINUTE)
def tidy_minute(spark: SparkSession, d: str) -> DataFrame:
    """One-minute observations, tidy."""
    return _r(tidy.minute(read(spark, d, "obs_1min"), _meta(spark, d, "1min")), "lat", "lon", "value")


@_query(f"SELECT resolution, variable, unit, count(*) AS n, count(DISTINCT station_id) AS stations FROM ({_TIDY_DAILY} UNION ALL BY NAME SELECT * FROM ({_TIDY_HOURLY}) UNION ALL BY NAME SELECT * FROM ({_TIDY_MINUTE})) GROUP BY ALL")
def tidy_long(spark: SparkSession, d: str) -> DataFrame:
    """All resolutions in one tidy table, counted by variable."""
    all_ = tidy.merged(tidy_daily(spark, d), tidy_hourly(spark, d), tidy_minute(spark, d))
    return all_.groupBy("resolution", "variable", "unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("station_id").alias("stations"))


@_query(f"""SELECT station_id, datetime, max(value) FILTER (WHERE variable = 'PRCP') AS "PRCP", max(value) FILTER (WHERE variable = 'TMAX') AS "TMAX", max(value) FILTER (WHERE variable = 'TMIN') AS "TMIN",
    max(value) FILTER (WHERE variable = 'TAVG') AS "TAVG" FROM ({_TIDY_DAILY}) GROUP BY ALL""")
def element_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Daily observations back in one row per day."""
    return tidy.wide(tidy_daily(spark, d), ["PRCP", "TMAX", "TMIN", "TAVG"])


@_query("""SELECT min_id, icao, round(temp_f, 6) AS temp_f FROM obs_1min WHERE year(timestamp_utc) BETWEEN 2022 AND 2022 AND icao IN (SELECT trim(unnest(string_split(icao_ids, '|'))) FROM master_station_list WHERE state IN ('TX', 'MO', 'CO'))""")
def extract_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw one-minute rows of one year and some states' stations."""
    s = read(spark, d, "master_station_list", "ncei_id", "icao_ids", "state").where(F.col("state").isin("TX", "MO", "CO"))
    raw = tidy.Observations(read(spark, d, "obs_1min"), "1min").for_stations(s).years(2022, 2022).raw()
    return _r(raw.select("min_id", "icao", "temp_f"), "temp_f")


@_query(f"""SELECT 'partition' AS form, count(*) AS n FROM obs_hourly WHERE year BETWEEN 2022 AND 2023 UNION ALL SELECT 'timestamp', count(*) FROM obs_1min WHERE year(timestamp_utc) BETWEEN 2022 AND 2022
UNION ALL SELECT 'text', count(*) FROM obs_hourly WHERE date IS NOT NULL AND year({_DAY}) BETWEEN 2022 AND 2023""")
def year_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a range of years by the three kinds of year columns."""
    h, m = _dated(spark, d), read(spark, d, "obs_1min", "timestamp_utc")
    n = lambda df, form, c, a, b: df.where(tidy.year_range(df, c, a, b)).agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("n"))
    return n(h, "partition", "year", 2022, 2023).unionByName(n(m, "timestamp", "timestamp_utc", 2022, 2022)).unionByName(n(h, "text", "date", 2022, 2023))


# ---------------------------------------------------------------- raw formats, from lines composed of the tables


@_query("""SELECT obs_id, temp_qc, CASE WHEN temperature_c IS NULL OR isnan(temperature_c) OR abs(temperature_c) > 900 THEN NULL ELSE round(round(CAST(temperature_c AS DOUBLE) * 10) / 10, 6) + 0.0 END AS temp, precip_hours AS hours,
    CASE WHEN precip_mm >= 0 AND precip_mm < 900 THEN round(round(CAST(precip_mm AS DOUBLE) * 10) / 10, 6) + 0.0 END AS mm FROM obs_hourly WHERE temp_qc IS NOT NULL AND temp_qc <> '' AND precip_hours IS NOT NULL""")
def isd_decode(spark: SparkSession, d: str) -> DataFrame:
    """Temperatures and precipitation groups written in the hourly feed's notation and decoded again."""
    o = read(spark, d, "obs_hourly", "obs_id", "temperature_c", "temp_qc", "precip_mm", "precip_hours").where("temp_qc IS NOT NULL AND temp_qc <> '' AND precip_hours IS NOT NULL")
    tenths = lambda c: F.round(F.col(c).cast("double") * 10).cast("int")
    t = F.when(F.col("temperature_c").isNull() | F.isnan("temperature_c") | (F.abs("temperature_c") > 900), 9999).otherwise(tenths("temperature_c"))
    p = F.when((F.col("precip_mm") >= 0) & (F.col("precip_mm") < 900), tenths("precip_mm")).otherwise(9999)
    sign = F.when(t < 0, "-").otherwise("+")
    tmp = F.concat(sign, F.lpad(F.abs(t).cast("string"), 4, "0"), F.lit(","), "temp_qc")
    aa = F.concat(F.lpad(F.col("precip_hours").cast("string"), 2, "0"), F.lit(","), F.lpad(p.cast("string"), 4, "0"), F.lit(",9,5"))
    o = o.select("obs_id", decode.isd_temperature(tmp).alias("t"), decode.isd_precipitation(aa).alias("p"))
    return _r(o.select("obs_id", F.col("t.qc").alias("temp_qc"), F.col("t.value").alias("temp"), F.col("p.hours").cast("tinyint").alias("hours"), F.col("p.mm").alias("mm")), "temp", "mm")


@_query("""SELECT hist_id, trim(st) AS "STATE", nullif(left(trim(station_name), 30), '') AS "NAME", CASE WHEN NOT isnan(lat) THEN round(lat, 3) END AS "LAT", CASE WHEN NOT isnan(lon) THEN round(lon, 3) END AS "LON" FROM isd_history
WHERE st IS NOT NULL AND length(trim(st)) = 2 AND regexp_full_match(coalesce(station_name, ''), '[ -~]*')""")
def fixed_width_parse(spark: SparkSession, d: str) -> DataFrame:
    """History entries written as lines of a station list and read back."""
    h = read(spark, d, "isd_history", "hist_id", "st", "station_name", "lat", "lon").where("length(trim(st)) = 2").where(F.coalesce("station_name", F.lit("")).rlike("^[ -~]*$"))
    num = lambda c, n: F.rpad(F.coalesce(F.when(~F.isnan(c), F.round(c, 3).cast("decimal(12,3)").cast("string")), F.lit("")), n, " ")
    sid = F.concat(F.lit("US"), F.lpad(F.col("hist_id").cast("string"), 9, "0"))
    line = F.concat(sid, F.lit(" "), num("lat", 8), F.lit(" "), num("lon", 9), F.lit(" "), F.rpad(F.lit(""), 6, " "), F.lit(" "), F.trim("st"), F.lit(" "), F.rpad(F.coalesce(F.trim("station_name"), F.lit("")), 30, " "))
    out = fixed.station_list(h.select(line.alias("value")))
    return _r(out.select(F.substring("STATION", 3, 9).cast("bigint").alias("hist_id"), "STATE", "NAME", "LAT", "LON"), "LAT", "LON", n=3)


@_query("""WITH u AS (SELECT DISTINCT station, date, CASE WHEN prcp IS NULL OR isnan(prcp) THEN NULL ELSE CAST(round(prcp * 10) AS INT) END AS v FROM obs_daily WHERE length(station) = 11 AND date IS NOT NULL),
o AS (SELECT station, date, min(v) AS v FROM u GROUP BY ALL) SELECT station, date, 'PRCP' AS element, v AS value, CASE WHEN v IS NULL THEN 'P' ELSE '' END AS mflag FROM o""")
def daily_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    """Daily precipitation written as element-month lines and read back: missing days are left out, missing values with a flag stay."""
    o = read(spark, d, "obs_daily", "station", "date", "prcp").where("length(station) = 11 AND date IS NOT NULL")
    v = F.when(F.col("prcp").isNotNull() & ~F.isnan("prcp"), F.round(F.col("prcp") * 10).cast("int"))
    o = o.select("station", "date", v.alias("v")).groupBy("station", "date").agg(F.min("v").alias("v"))
    slot = F.when(F.col("v").isNull(), "-9999P  ").otherwise(F.concat(F.lpad(F.col("v").cast("string"), 5, " "), F.lit("   ")))
    months = o.groupBy("station", F.date_format("date", "yyyyMM").alias("ym")).agg(F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("date").alias("k"), slot.alias("s")))).alias("m"))
    day = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda k: F.coalesce(F.element_at("m", k), F.lit("-9999   ")))
    line = F.concat("station", "ym", F.lit("PRCP"), F.array_join(day, ""))
    return fixed.daily_elements(months.select(line.alias("value"))).select("station", "date", "element", "value", "mflag")


@_query("""SELECT min_id, wban, icao, timestamp_utc, precip_id, CASE WHEN NOT isnan(precip_in) THEN round(precip_in, 2) END AS precip_in, CASE WHEN NOT isnan(temp_f) THEN round(temp_f, 1) END AS temp_f, CASE WHEN NOT isnan(dew_f) THEN round(dew_f, 1) END AS dew_f
FROM obs_1min WHERE length(wban) = 5 AND length(icao) = 4 AND timestamp_utc IS NOT NULL AND second(timestamp_utc) = 0 AND precip_id IS NOT NULL""")
def minute_lines(spark: SparkSession, d: str) -> DataFrame:
    """One-minute rows written as lines with a local time five hours behind, and read back to UTC."""
    o = read(spark, d, "obs_1min").where("length(wban) = 5 AND length(icao) = 4 AND timestamp_utc IS NOT NULL AND second(timestamp_utc) = 0 AND precip_id IS NOT NULL")
    text = lambda c, n: F.coalesce(F.when(~F.isnan(c), F.round(c, n).cast(f"decimal(12,{n})").cast("string")), F.lit("M"))
    local = F.date_format(F.expr("timestamp_utc - INTERVAL 5 HOURS"), "yyyyMMddHHmm")
    word = F.concat(F.substring("icao", 2, 3), local, F.date_format("timestamp_utc", "HHmm"))
    # the third word also carries the row's number; the fifth is no number, so precipitation is the fourth
    kind = F.concat("precip_id", F.lit("#"), F.col("min_id").cast("string"))
    line = F.concat_ws(" ", F.concat("wban", "icao"), word, kind, text("precip_in", 2), F.lit("x 39.9 29.90 29.90 x"), text("temp_f", 1), text("dew_f", 1))
    p = F.split("precip_id", "#")
    rows = fixed.minute_lines(o.select(line.alias("value"))).withColumns({"min_id": F.get(p, F.lit(1)).cast("bigint"), "precip_id": F.get(p, F.lit(0))})
    return _r(rows.select("min_id", "wban", "icao", "timestamp_utc", "precip_id", "precip_in", "temp_f", "dew_f"), "precip_in", "temp_f", "dew_f", n=2)


@_query("""WITH w AS (SELECT DISTINCT station, date, CASE WHEN NOT isnan(prcp) THEN CAST(round(prcp * 10) AS INT) END AS a, CASE WHEN NOT isnan(tmax) THEN CAST(round(tmax) AS INT) END AS b FROM obs_daily WHERE station IS NOT NULL AND date IS NOT NULL)
SELECT station AS station_id, year(date) AS year, month(date) AS month, day(date) AS day, '0000' AS time, round(a / 100.0, 6) AS precip_in, 'A' AS flag_measurement, left(station, 2) AS state FROM w WHERE a >= 0
UNION ALL SELECT station, year(date), month(date), day(date), '0030', round(b / 100.0, 6), '', left(station, 2) FROM w WHERE b >= 0""")
def slot_melt(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the wide 15-minute feed composed of daily values, melted: sentinels, words and negative values leave no row."""
    o = read(spark, d, "obs_daily").where("station IS NOT NULL AND date IS NOT NULL").select("station", "date", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("prcp", "tmax")])
    whole = lambda c: F.round(c).cast("int").cast("string")
    w = o.select(F.col("station").alias("STATION"), F.col("date").cast("string").alias("DATE"), F.lit("QPCP").alias("ELEMENT"), whole(F.col("prcp") * 10).alias("0000Val"), F.lit("A").alias("0000MF"),
        F.lit("-9999").alias("0015Val"), whole(F.col("tmax")).alias("0030Val"), F.lit("nan").alias("0030MF"), F.lit("abc").alias("2345Val")).distinct()
    out = delimited.quarter_feed(w).select("station_id", "year", F.col("month").cast("int").alias("month"), F.col("day").cast("int").alias("day"), "time", "precip_in", "flag_measurement", "state")
    return _r(out, "precip_in")


def _quarter(spark: SparkSession, d: str) -> DataFrame:
    return slot_melt(spark, d).withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")}).withColumns({"element": F.lit("QPCP"), "station_name": F.lit(None).cast("string"), "flag_quality": F.lit("nan")})


@_query(f"""SELECT station_id, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, state, min(make_date(year, month, day)) AS earliest_dt, max(make_date(year, month, day)) AS latest_dt, count(*) AS row_count,
    count(DISTINCT year) AS file_count FROM ({ORACLE["slot_melt"]}) GROUP BY ALL""")
def quarter_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The inventory of the melted 15-minute rows."""
    return inventory.quarter_inventory(_quarter(spark, d))


_QUARTER_ROWS = f"""SELECT station_id, printf('%04d-%02d-%02d ', year, month, day) || left(time, 2) || ':' || right(time, 2) AS datetime, 'QPCP' AS variable, precip_in * 25.4 AS value, 'mm' AS unit, '' AS quality_flag, state AS own
    FROM ({ORACLE["slot_melt"]})"""


@_query(_tidy_sql(_QUARTER_ROWS, "ghcnd_ids", "15min", "NCEI").replace("station_name, state, CASE", "station_name, own AS state, CASE"))
def tidy_quarter(spark: SparkSession, d: str) -> DataFrame:
    """The melted 15-minute rows, tidy: their own state comes before the station table's."""
    return _r(tidy.quarter(_quarter(spark, d), _meta(spark, d, "15min")), "lat", "lon", "value")


@_query(_tidy_sql("SELECT station AS station_id, CAST(date AS VARCHAR) AS datetime, 'HlyPrcp' AS variable, round(prcp, 2) * 25.4 AS value, 'mm' AS unit, '' AS quality_flag FROM obs_daily", "ghcnd_ids", "hourly_precip", "HPD"))
def tidy_hourly_precip(spark: SparkSession, d: str) -> DataFrame:
    """Daily amounts taken as hourly precipitation in inches, as text, tidy."""
    o = read(spark, d, "obs_daily").select(F.col("station").alias("STATION"), F.col("date").alias("DATE"), F.round("prcp", 2).cast("string").alias("HlyPrcp"))
    return _r(tidy.hourly_precip(o, _meta(spark, d, "hourly_precip")), "lat", "lon", "value")


@_query()
def station_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 8000 stations for a map, the same at every run."""
    return selection.Stations(_stations(spark, d).df).thinned().select("ncei_id", "lat", "lon")


@_query("""SELECT file_id, filename, CASE WHEN filename LIKE '%.csv.gz' THEN '.csv.gz' WHEN filename LIKE '%.15m.parquet' THEN '.15m.parquet' WHEN filename LIKE '%.dat.parquet' THEN '.dat.parquet' WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) ELSE '' END AS extension,
    CASE WHEN regexp_full_match(filename, '6406[A-Z0-9]{5}\\d{6}\\.parquet') THEN substring(filename, 5, 5) WHEN regexp_full_match(filename, 'asos-1min-pg2-[A-Z0-9]{4}-\\d{6}\\.parquet') THEN '0' || substring(filename, 15, 4)
        WHEN regexp_full_match(filename, '\\d{11}\\.parquet') THEN left(filename, 6) WHEN regexp_full_match(filename, '(AQC|CQC|FQC|GQC|MQC|RQC|RQW|SQC|USC|USW|VQC)\\d{8}(\\.csv|\\.parquet|\\.15m\\.parquet)') THEN left(filename, 11)
        WHEN regexp_full_match(filename, 'A\\d{10}\\.parquet') THEN left(filename, 11) WHEN regexp_full_match(filename, '[A-Z]{2}[A-Z0-9]{9}\\.dly') THEN left(filename, 11)
        WHEN regexp_full_match(filename, '(US|RQ|VQ|CQ|GQ|AQ|MQ|FQ|SQ|RW)[A-Za-z0-9_]{9}\\.parquet') THEN left(filename, 11) WHEN regexp_full_match(filename, '[A-Z]{2}_(raw_daily_\\w+\\.csv\\.gz|station_locations\\.csv|station_summary\\.csv|station_year_summary\\.csv|yearly_summary\\.csv)') THEN left(filename, 2) END AS station_id_raw,
    CASE WHEN regexp_full_match(filename, '6406[A-Z0-9]{5}\\d{6}\\.parquet') THEN substring(filename, 10, 4) || '-' || substring(filename, 14, 2) WHEN regexp_full_match(filename, 'asos-1min-pg2-[A-Z0-9]{4}-\\d{6}\\.parquet') THEN substring(filename, 20, 4) || '-' || substring(filename, 24, 2)
        WHEN regexp_full_match(filename, '\\d{4}\\.parquet') THEN left(filename, 4) END AS date_part FROM file_inventory WHERE filename IS NOT NULL""")
def filename_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Extension, station and date that the file names say."""
    f = read(spark, d, "file_inventory", "file_id", "filename").where("filename IS NOT NULL")
    s = names.station_of_file(F.col("filename"))
    return f.select("file_id", "filename", names.extension(F.col("filename")).alias("extension"), s["station_id_raw"].alias("station_id_raw"), names.date_part(F.col("filename")).alias("date_part"))


@_query("""WITH e AS (SELECT DISTINCT source, filename, file_size_bytes % 28 + 1 AS dd FROM file_inventory WHERE filename IS NOT NULL AND file_size_bytes IS NOT NULL AND regexp_full_match(filename, '[A-Za-z0-9._-]+') AND source IS NOT NULL)
SELECT source, filename AS name, min(make_timestamp(2024, 1, dd, 10, 30, 0.0)) AS modified FROM e GROUP BY ALL""")
def dir_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files and times out of directory listings composed of the catalogue, a page per source and layout."""
    f = read(spark, d, "file_inventory", "source", "filename", "file_size_bytes").where("filename IS NOT NULL AND file_size_bytes IS NOT NULL AND source IS NOT NULL").where(F.col("filename").rlike("^[A-Za-z0-9._-]+$"))
    f = f.select("source", "filename", F.lpad((F.col("file_size_bytes") % 28 + 1).cast("string"), 2, "0").alias("dd")).distinct()
    table = F.concat(F.lit('<a href="'), "filename", F.lit('">x</a></td>\n <td align="right">2024-01-'), "dd", F.lit(" 10:30</td>"))
    inline = F.concat(F.lit('<a href="'), "filename", F.lit('">x</a>   '), "dd", F.lit("-Jan-2024 10:30  12K"))
    line = F.when(F.length("filename") % 2 == 0, table).otherwise(inline)
    pages = f.groupBy("source", F.substring("filename", 1, 4).alias("page")).agg(F.concat(F.lit('<a href="up/">up</a> 01-Jan-2024 10:30\n'), F.array_join(F.collect_list(line), "\n")).alias("html"))
    return files.listing(pages.select("source", "page", "html")).drop("page")


@_query("SELECT cov_id, station_id_raw, CASE WHEN starts_with(station_id_raw, 'USC00') AND length(station_id_raw) >= 7 THEN coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in decode.STATES.items()) + "}, substring(station_id_raw, 6, 2)), substring(station_id_raw, 6, 2)) "
    "ELSE coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in decode.TERRITORIES.items()) + "}, left(station_id_raw, 2)), left(station_id_raw, 2)) END AS state FROM station_coverage_geo WHERE station_id_raw IS NOT NULL")  # fmt: skip
def state_codes(spark: SparkSession, d: str) -> DataFrame:
    """The state or territory that an id's code names."""
    c = read(spark, d, "station_coverage_geo", "cov_id", "station_id_raw").where("station_id_raw IS NOT NULL")
    return c.withColumn("state", decode.state_of(F.col("station_id_raw")))


@_query(f"SELECT cov_id, round(lat, 3) AS lat, round(lon, 3) AS lon FROM station_coverage_geo WHERE {_AT} AND NOT isnan(lat) AND NOT isnan(lon)")
def latlon_text(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates written with degree signs and letters, read back."""
    c = read(spark, d, "station_coverage_geo", "cov_id", "lat", "lon").where(selection.in_box(F.col("lat"), F.col("lon"), "world") & ~F.isnan("lat") & ~F.isnan("lon"))
    part = lambda v, pos, neg: F.concat(F.round(F.abs(v), 3).cast("decimal(12,3)").cast("string"), F.lit("° "), F.when(F.col(v) < 0, neg).otherwise(pos))
    p = decode.latitude_longitude(F.concat(part("lat", "N", "S"), F.lit(", "), part("lon", "E", "W")))
    return _r(c.select("cov_id", p["lat"].alias("lat"), p["lon"].alias("lon")), "lat", "lon", n=3)


# ---------------------------------------------------------------- changes by key

_EV = "event_id, event_type, user_id, round(value, 4) AS value, day(ts) AS dd"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _r(read(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.dayofmonth("ts").alias("dd")), "value", n=4)


@_query(f"""WITH e AS (SELECT {_EV} FROM events), new AS (SELECT event_id + 10000000 AS event_id, event_type, user_id, value * 2 AS value, dd FROM e WHERE user_id % 10 = 3 AND dd <= 5)
SELECT event_id, event_type, user_id, round(value, 4) AS value, dd FROM e WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.dd = e.dd AND n.user_id = e.user_id) UNION ALL SELECT event_id, event_type, user_id, round(value, 4), dd FROM new""")
def keyed_replace(spark: SparkSession, d: str) -> DataFrame:
    """Users' rows replaced within the day partitions of the new rows, through stored partitions."""
    e = _events(spark, d)
    new = e.where("user_id % 10 = 3 AND dd <= 5").withColumns({"event_id": F.col("event_id") + 10_000_000, "value": F.col("value") * 2})
    order = ["event_id", "event_type", "user_id", "value", "dd"]
    return _r(tables.staged_replace(new.select(*order), ["dd"], "user_id", e.select(*order)), "value", n=4)


@_query(f"""WITH e AS (SELECT {_EV} FROM events), held AS (SELECT * FROM e WHERE dd <= 15), new AS (SELECT user_id, event_type, dd, min(event_id) AS event_id FROM e GROUP BY ALL)
SELECT event_id, event_type, user_id, dd FROM held UNION ALL SELECT event_id, event_type, user_id, dd FROM new WHERE (event_type, user_id, dd) NOT IN (SELECT (event_type, user_id, dd) FROM held)""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Rows added whose key isn't there yet, the first of each key."""
    e = _events(spark, d).select("event_id", "event_type", "user_id", "dd")
    return tables.insert_or_ignore(e.where("dd <= 15"), e, ["event_type", "user_id", "dd"], [F.col("event_id")])


@_query(f"""WITH e AS (SELECT {_EV} FROM events), held AS (SELECT * FROM e WHERE dd <= 15), new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM e WHERE dd > 10) WHERE rn = 1)
SELECT event_id, event_type, user_id, dd FROM held h WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.user_id = h.user_id AND n.event_type = h.event_type) UNION ALL SELECT event_id, event_type, user_id, dd FROM new""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of known keys replaced by the latest new row, others added."""
    e = _events(spark, d).select("event_id", "event_type", "user_id", "dd")
    return tables.upsert(e.where("dd <= 15"), e.where("dd > 10"), ["user_id", "event_type"], [F.col("event_id").desc()])


@_query("SELECT file_id, schema_group FROM file_inventory WHERE NOT coalesce(starts_with(schema_group, 'ASOS|'), FALSE)")
def delete_group(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue without the groups of one source."""
    return tables.without(read(spark, d, "file_inventory", "file_id", "schema_group"), "schema_group", "ASOS")


@_query()
def sampled_files(spark: SparkSession, d: str) -> DataFrame:
    """Three files of each schema group, the same at every run."""
    return files.sampled_files(read(spark, d, "file_inventory", "filepath", "schema_group").distinct())


@_query("SELECT filepath, filename, count(*) AS deliveries FROM file_inventory GROUP BY ALL")
def catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Files of the catalogue classified anew, with how often each is listed."""
    f = files.catalogued(read(spark, d, "file_inventory", "filepath", "filename", "file_size_bytes"), "archive", "/archive")
    return f.groupBy("filepath", "filename").agg(F.count(F.lit(1)).alias("deliveries"))


@_query("WITH e AS (SELECT DISTINCT filename AS name, file_size_bytes AS n FROM file_inventory WHERE filename IS NOT NULL AND file_size_bytes IS NOT NULL) SELECT count(*) AS files FROM e WHERE n % 28 + 1 >= 11 AND n % 3 <> 0")
def due_files(spark: SparkSession, d: str) -> DataFrame:
    """How many files a refresh would fetch: changed since the mark's day before, and not done."""
    from datetime import date

    f = read(spark, d, "file_inventory", F.col("filename").alias("name"), "file_size_bytes").where("name IS NOT NULL AND file_size_bytes IS NOT NULL").distinct()
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("file_size_bytes") % 28 + 1).cast("int"), F.lit(10), F.lit(30), F.lit(0))
    f = f.withColumn("modified", at).withColumn("name", F.concat("name", F.lit("#"), F.col("file_size_bytes").cast("string")))
    done = f.where("file_size_bytes % 3 = 0").select("name", "modified")
    return refresh.dry_run(refresh.due(f.select("name", "modified"), done, refresh.cutoff(date(2024, 1, 11), "daily")))


# ---------------------------------------------------------------- event time

_WINDOW = "count(*) AS n, round(sum(value), 4) AS total"


def _aggs():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


@_query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_WINDOW} FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    return refresh.windowed(read(spark, d, "events", "ts", "event_type", "value"), "ts", ["event_type"], _aggs(), "1 hour")


@_query(f"""WITH e AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, {_WINDOW} FROM e GROUP BY ALL""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour, every half hour, and type."""
    return refresh.windowed(read(spark, d, "events", "ts", "event_type", "value"), "ts", ["event_type"], _aggs(), "1 hour", "30 minutes")


@_query(f"""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, {_WINDOW} FROM s GROUP BY user_id, k""")
def session(spark: SparkSession, d: str) -> DataFrame:
    """Events of users by sessions of half an hour's gap."""
    return refresh.sessions(read(spark, d, "events", "ts", "user_id", "value"), "ts", ["user_id"], _aggs(), "30 minutes")


@_query(f"""SELECT station_id, state, min({_DAY}) AS earliest_dt, max({_DAY}) AS latest_dt, count(*) AS row_count, count(DISTINCT year) AS file_count FROM obs_hourly o WHERE station_id IS NOT NULL AND year IS NOT NULL GROUP BY ALL""")
def pipeline_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rows delivered in two parts into a partitioned table, the second part twice, then the inventory of the table."""
    from ..session import shared_dir

    o = read(spark, d, "obs_hourly", "obs_id", "station_id", "date", "temperature_c", "year", "state").where("station_id IS NOT NULL AND year IS NOT NULL")
    path = shared_dir(spark)
    early = o.where("year <= 2023")
    tables.replace_partitions(early, path, ["year"])
    late = materialise(o)
    for _ in range(2):
        tables.keyed_replace(late, path, ["year"], "station_id")
    held = F.when(F.substring(F.trim("date"), 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date"))
    table = spark.read.schema(o.schema).parquet(path).withColumn("date", held)
    return inventory.hourly_inventory(table).drop("lat", "lon")
