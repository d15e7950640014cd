"""Declared schemas of the stored tables. Keys are kept unique by the writers, not by constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(),
    "tinyint": T.ByteType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _ddl(text: str) -> StructType:
    """A schema of 'name type, ...', made without a session."""
    fields = [f.split() for f in text.split(",")]
    return StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


OBS_DAILY = _ddl("STATION string, DATE date, PRCP double, TMAX double, TMIN double, TAVG double")
OBS_DAILY_LONG = _ddl("station string, date date, element string, value int, mflag string, qflag string, sflag string")
OBS_HOURLY = _ddl(
    """station_id string, date string, report_type string, month tinyint, day tinyint, hour tinyint, minute tinyint,
    temperature_c float, dewpoint_c float, precip_mm float, precip_hours tinyint, temp_qc string, dew_qc string, precip_qc string,
    year int, state string"""
)
OBS_15MIN = _ddl(
    """station_id string, station_name string, lat double, lon double, elevation double, element string, month tinyint, day tinyint,
    time string, precip_in double, flag_measurement string, flag_quality string, year int, state string"""
)
OBS_1MIN = _ddl("wban string, icao string, timestamp_utc timestamp_ntz, precip_id string, precip_in double, temp_f double, dew_f double")
FILE_INVENTORY = _ddl(
    """filepath string, filename string, extension string, file_size_bytes bigint, source string, subfolder string, schema_group string,
    station_id_raw string, id_format string, date_part string, is_data_file boolean, anomaly_flag string"""
)
DATA_PROFILE = _ddl(
    """filepath string, source string, station_id_raw string, id_format string, total_rows bigint, min_datetime string,
    max_datetime string, has_data boolean, error string"""
)
STATION_INVENTORY = _ddl(
    "station_id string, lat double, lon double, state string, earliest_dt date, latest_dt date, row_count bigint, file_count bigint"
)
TIDY = _ddl(
    """station_id string, station_name string, state string, lat double, lon double, datetime string, resolution string,
    variable string, value double, unit string, source string, quality_flag string"""
)
MASTER = _ddl(
    """ncei_id string, station_name string, state string, county string, lat_dec double, lon_dec double, elev_m double,
    station_type string, is_active boolean, has_coordinates boolean, wban_ids string, icao_ids string, ghcnd_ids string,
    coop_ids string, hpd_ids string, wmo_ids string, faa_ids string, nwsli_ids string, has_asos_1min boolean,
    asos_1min_files bigint, asos_1min_gb double, asos_1min_start string, asos_1min_end string, has_asos_isd boolean,
    asos_isd_files bigint, asos_isd_gb double, has_hpd_1hr boolean, hpd_files bigint, hpd_data_gb double, has_ncei_15min boolean,
    ncei_files bigint, ncei_data_gb double, has_ghcn_daily boolean, ghcn_daily_files bigint, ghcn_daily_data_gb double,
    homr_matched boolean, usaf_id string, source_if_orphan string"""
)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table of a schema without rows, as a placeholder for a source that isn't there."""
    return spark.createDataFrame([], schema)


def from_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A table of a few rows made on the driver."""
    return spark.createDataFrame(rows, schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns in its order; missing ones NULL, others dropped, text that can't be cast NULL."""
    held = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{held[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in held else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )
