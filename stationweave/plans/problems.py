"""The queries of the data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate, harmonise, multivalue, proximity, regular_grid, spikes
from ..functions.units import convert
from ..session import materialise
from ..tables import read


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return materialise(
        harmonise.reading_rows(
            read(spark, d, "obs_hourly", "obs_id", "station_id", "date", "report_type", *regular_grid.MEASURES),
            read(spark, d, "report_types"),
        )
    )


def _remarks(spark: SparkSession, d: str) -> DataFrame:
    return materialise(harmonise.remarks(read(spark, d, "station_notes", "station_id", "note_text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that can't be their station's weather."""
    rows = _readings(spark, d)
    stretches = materialise(harmonise.hourly_segments(rows, read(spark, d, "obs_daily"), _remarks(spark, d)))
    bad = spikes.bad_readings(harmonise.in_common_units(rows, stretches))
    return bad.select(F.col("id").alias("obs_id"), "field_name")


def _foreign(spark: SparkSession, d: str) -> DataFrame:
    said = _remarks(spark, d)
    rows = materialise(
        harmonise.hourly_rows(
            read(spark, d, "obs_hourly", "obs_id", "station_id", "date", "report_type", "ingested_at", *regular_grid.MEASURES),
            read(spark, d, "report_types"),
        )
    )
    hourly = materialise(harmonise.hourly_segments(rows.where("reading"), read(spark, d, "obs_daily"), said))
    minute = materialise(harmonise.minute_segments(read(spark, d, "obs_1min"), said))
    return harmonise.foreign_values(
        rows,
        hourly,
        read(spark, d, "obs_1min", "min_id", "wban", "timestamp_utc", "temp_f", "precip_in"),
        minute,
        read(spark, d, "raw_reports", "report_id", "station_id", "temp_text", "precip_text"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values recorded in a unit other than their field's, with that unit."""
    return _foreign(spark, d).select("src_table", "row_id", "field_name", "unit_code")


def p2_converted(spark: SparkSession, d: str) -> DataFrame:
    """The same values in °C or mm."""
    return _foreign(spark, d).withColumn("common", F.round("common", 4))


def p2_report_values(spark: SparkSession, d: str) -> DataFrame:
    """Every observer's number with its unit, and in °C or mm."""
    r = harmonise.read_texts(read(spark, d, "raw_reports", "report_id", "station_id", "temp_text", "precip_text"))
    return r.withColumn("common", F.round(convert(F.col("value"), F.col("unit_code")), 4))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of file_fragments that repeat another one, as set aside while the archive is consolidated."""
    return consolidate.consolidate(read(spark, d, "file_fragments", *consolidate.RECORD), target_bytes=consolidate.TARGET_BYTES).repeats


def p3_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The records as the consolidated files hold them."""
    return consolidate.consolidate(read(spark, d, "file_fragments", *consolidate.RECORD), target_bytes=consolidate.TARGET_BYTES).kept


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated files: how many records and bytes each holds."""
    kept = p3_consolidated(spark, d).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_bytes"))
    return kept.groupBy("file_name", "file_bytes").agg(F.count(F.lit(1)).alias("records"))


def p3_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """How many small files each part of the archive has, and how many files of 128 MB would do."""
    return consolidate.merge_plan(read(spark, d, "file_inventory"))


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Ids known as whole values: those of the coverage and history tables, and fields of a single id.

    The former hold one id a field, so one with a delimiter inside is whole too;
    of the latter only fields without any delimiter are known to hold one.
    """
    one = lambda df, c: df.select(F.trim(F.col(c)).alias("value"))
    m = read(spark, d, "master_station_list", "wban_ids", "icao_ids", "ghcnd_ids")
    h = read(spark, d, "isd_history", "wban", "icao")
    c = read(spark, d, "station_coverage_geo", "station_id_raw")
    out = one(c, "station_id_raw").unionByName(one(h, "wban")).unionByName(one(h, "icao"))
    out = out.where((F.length("value") > 2) & F.col("value").rlike(r"^\w.*\w$"))
    for f in m.columns:
        out = out.unionByName(one(m, f).where(F.col("value").rlike(r"^[A-Za-z0-9_]{3,}$")))
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of the id fields that hold two or more, with their place."""
    return multivalue.split_fields(
        read(spark, d, "master_station_list", "ncei_id", "wban_ids", "icao_ids", "ghcnd_ids"),
        "ncei_id",
        ["wban_ids", "icao_ids", "ghcnd_ids"],
        _dictionary(spark, d),
    )


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(
        read(spark, d, "obs_hourly", "station_id", "date", "report_type", *regular_grid.MEASURES),
        read(spark, d, "report_types"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Station hours without a reading."""
    return _grid(spark, d).where("n_readings = 0").select("station_id", F.col("cell_start").alias("hour_utc"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The hourly series itself."""
    return _grid(spark, d).withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("coverage", *regular_grid.MEASURES)})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Coverage rows within 2 km of each master station."""
    return _near(spark, d).select("ncei_id", "cov_id")


def p6_distances(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their distance."""
    return _near(spark, d).withColumn("distance_km", F.round("distance_km", 6))


def p6_regions(spark: SparkSession, d: str) -> DataFrame:
    """Coverage rows in the region of each state: the quadrilateral that its stations span, its border included."""
    m = read(spark, d, "master_station_list", "state", "lat_dec", "lon_dec").where("state IS NOT NULL AND NOT isnan(lat_dec) AND NOT isnan(lon_dec)")
    m = m.where("lat_dec BETWEEN 17 AND 72 AND lon_dec BETWEEN -180 AND -65")
    span = m.groupBy("state").agg(*[f(c).alias(n) for f, c, n in ((F.min, "lon_dec", "w"), (F.max, "lon_dec", "e"), (F.min, "lat_dec", "s"), (F.max, "lat_dec", "n"))])
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    regions = span.select("state", F.array(corner("w", "s"), corner("w", "n"), corner("e", "n"), corner("e", "s")).alias("ring"))
    points = read(spark, d, "station_coverage_geo", "cov_id", F.col("lon").alias("x"), F.col("lat").alias("y")).where("x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90")
    return proximity.points_in_regions(points, regions).select("state", "cov_id")


def _near(spark: SparkSession, d: str) -> DataFrame:
    return proximity.within_distance(
        read(spark, d, "master_station_list", "ncei_id", "lat_dec", "lon_dec"),
        "ncei_id",
        "lat_dec",
        "lon_dec",
        read(spark, d, "station_coverage_geo", "cov_id", "lat", "lon"),
        "cov_id",
        "lat",
        "lon",
        2.0,
    )


QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_converted, p2_report_values, p3_found, p3_consolidated, p3_files, p3_merge_plan, p4_found, p5_found, p5_grid, p6_found, p6_distances, p6_regions)
}

_PLACE = "{0} BETWEEN -90 AND 90 AND {1} BETWEEN -180 AND 180 AND NOT isnan({0}) AND NOT isnan({1}) AND NOT ({0} = 0 AND {1} = 0)"
_DIST = """2 * 6371.0 * asin(sqrt(least(greatest(
    power(sin(radians(c.lat - m.lat_dec) / 2), 2)
    + cos(radians(m.lat_dec)) * cos(radians(c.lat)) * power(sin(radians(c.lon - m.lon_dec) / 2), 2), 0.0), 1.0)))"""

_NEAR = f"""SELECT m.ncei_id, c.cov_id, {_DIST} AS distance_km FROM master_station_list m
JOIN station_coverage_geo c ON abs(c.lat - m.lat_dec) < 0.05
WHERE {_PLACE.format("m.lat_dec", "m.lon_dec")} AND {_PLACE.format("c.lat", "c.lon")} AND {_DIST} <= 2.0"""

_STAMP = r"""SELECT file_id, rec_no, upper(regexp_replace(station_id, '\s', '', 'g')) AS s, trim(element) AS e,
    try_cast(trim(value_text) AS DOUBLE) AS v,
    epoch(try_cast(CASE WHEN regexp_full_match(trim(obs_time), '\d{8}T\d{6}.*')
        THEN regexp_replace(trim(obs_time), '^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)', '\1-\2-\3T\4:\5:\6')
        ELSE trim(obs_time) END AS TIMESTAMPTZ)) AS t
    FROM file_fragments"""

_HOURS = r"""stamps AS (SELECT station_id, upper(trim(date)) AS x FROM obs_hourly o
    WHERE upper(trim(report_type)) IN (SELECT upper(trim(report_type)) FROM report_types WHERE is_reading)
    AND ((temperature_c IS NOT NULL AND NOT isnan(temperature_c)) OR (dewpoint_c IS NOT NULL AND NOT isnan(dewpoint_c))
        OR (precip_mm IS NOT NULL AND NOT isnan(precip_mm)))
    AND regexp_full_match(upper(trim(date)), '(\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*|\d{8}T\d{6}.*)')),
hours AS (SELECT DISTINCT station_id, CAST(floor(epoch(try_cast(regexp_replace(x, '^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)',
    '\1-\2-\3T\4:\5:\6') AS TIMESTAMPTZ)) / 3600) AS BIGINT) AS h FROM stamps),
dated AS (SELECT station_id, h, year(make_timestamp(h * 3600000000)) AS y FROM hours WHERE h IS NOT NULL),
span AS (SELECT station_id, y, min(h) AS a, max(h) AS b FROM dated GROUP BY ALL),
grid AS (SELECT station_id, unnest(range(a, b + 1)) AS h FROM span)"""

ORACLE = {
    "p3_found": f"""WITH r AS ({_STAMP}), w AS (SELECT file_id, rec_no,
    row_number() OVER (PARTITION BY s, t, e, v ORDER BY file_id, rec_no) AS n FROM r)
SELECT file_id, rec_no FROM w WHERE n > 1""",
    "p3_consolidated": f"""WITH r AS ({_STAMP}), w AS (SELECT file_id, rec_no,
    row_number() OVER (PARTITION BY s, t, e, v ORDER BY file_id, rec_no) AS n FROM r)
SELECT f.file_id, f.rec_no, station_id, obs_time, element, value_text FROM file_fragments f JOIN w USING (file_id, rec_no) WHERE n = 1""",
    "p3_merge_plan": """WITH f AS (SELECT file_id, min(file_size_bytes) AS n, min(source) AS source, min(subfolder) AS subfolder
    FROM file_inventory WHERE file_size_bytes <= 1000000 GROUP BY file_id)
SELECT source, subfolder, count(*) AS files_before, CAST(sum(n) AS BIGINT) AS bytes_total,
    CAST(greatest(ceil(sum(n) / 128000000.0), 1) AS BIGINT) AS files_after FROM f GROUP BY source, subfolder""",
    "p5_found": f"""WITH {_HOURS}
SELECT station_id, strftime(make_timestamp(h * 3600000000), '%Y-%m-%d %H:00') AS hour_utc
FROM grid ANTI JOIN dated USING (station_id, h)""",
    "p5_grid": f"""WITH {_HOURS}, rd AS (SELECT station_id, CAST(floor(epoch(try_cast(regexp_replace(upper(trim(date)), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})T(\\d{{2}})(\\d{{2}})(\\d{{2}})', '\\1-\\2-\\3T\\4:\\5:\\6') AS TIMESTAMPTZ))) AS BIGINT) AS t,
    {", ".join(f"CASE WHEN NOT isnan({m}) THEN CAST({m} AS DOUBLE) END AS {m}" for m in regular_grid.MEASURES)} FROM obs_hourly
    WHERE station_id IS NOT NULL AND upper(trim(report_type)) IN (SELECT upper(trim(report_type)) FROM report_types WHERE is_reading) AND regexp_full_match(upper(trim(date)), '(\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d.*|\\d{{8}}T\\d{{6}}.*)')),
st AS (SELECT station_id, t, {", ".join(f"avg({m}) AS {m}" for m in regular_grid.MEASURES)} FROM rd WHERE t IS NOT NULL AND ({" OR ".join(f"{m} IS NOT NULL" for m in regular_grid.MEASURES)}) GROUP BY ALL),
iv AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY station_id ORDER BY t), t + 7200), t + 7200) AS t_end FROM st),
pc AS (SELECT *, unnest(range(t // 3600, (t_end - 1) // 3600 + 1)) AS cell FROM iv),
ls AS (SELECT *, least(t_end, cell * 3600 + 3600) - greatest(t, cell * 3600) AS len, t // 3600 = cell AS own FROM pc),
cl AS (SELECT station_id, cell, count(*) FILTER (WHERE own) AS n, sum(len) / 3600.0 AS coverage, {", ".join(f"sum({m} * len) / sum(CASE WHEN {m} IS NOT NULL THEN len END) AS {m}" for m in regular_grid.MEASURES)} FROM ls GROUP BY ALL)
SELECT g.station_id, g.h AS cell, strftime(make_timestamp(g.h * 3600000000), '%Y-%m-%d %H:%M') AS cell_start, coalesce(n, 0) AS n_readings, round(coalesce(coverage, 0), 4) + 0.0 AS coverage,
    {", ".join(f"round({m}, 4) + 0.0 AS {m}" for m in regular_grid.MEASURES)}, CASE WHEN n > 0 THEN 'observed' WHEN coverage > 0 THEN 'held' ELSE 'missing' END AS status
FROM grid g LEFT JOIN cl ON cl.station_id = g.station_id AND cl.cell = g.h""",
    "p6_regions": """WITH s AS (SELECT state, min(lon_dec) AS w, max(lon_dec) AS e, min(lat_dec) AS s, max(lat_dec) AS n FROM master_station_list WHERE state IS NOT NULL AND NOT isnan(lat_dec) AND NOT isnan(lon_dec)
    AND lat_dec BETWEEN 17 AND 72 AND lon_dec BETWEEN -180 AND -65 GROUP BY state HAVING count(*) > 0)
SELECT DISTINCT state, cov_id FROM s JOIN (SELECT cov_id, lat AS y, lon AS x FROM station_coverage_geo WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) ON x BETWEEN w AND e AND y BETWEEN s AND n""".replace("BETWEEN s AND n", "BETWEEN s.s AND s.n"),
    "p6_found": f"SELECT ncei_id, cov_id FROM ({_NEAR})",
    "p6_distances": f"SELECT ncei_id, cov_id, round(distance_km, 6) AS distance_km FROM ({_NEAR})",
}
