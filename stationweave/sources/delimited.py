"""Delimited files: as text, with inferred types, as a subset of columns, and the hourly and 15-minute feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import MISSING_SLOT, blank_or, isd_precipitation, isd_temperature, null_if, state_of
from ..functions.once import once
from ..functions.temporal import with_epoch
from .fixed import TERRITORIES

SLOTS = [f"{h:02d}{m:02d}" for h in range(24) for m in (0, 15, 30, 45)]
#: Elements of the 15-minute feed that are precipitation.
QUARTER_ELEMENTS = ("QPCP", "QGAG")


def as_text(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """A delimited file with a header, every column text; it splits, so no part of it is ever held whole."""
    return spark.read.csv(path, header=True, sep=delimiter, mode="PERMISSIVE")


def inferred(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """The same with types inferred over all rows; rows that don't fit are left out."""
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=True, mode="DROPMALFORMED")


def subset(spark: SparkSession, path: str | list[str], wanted: list[str], delimiter: str = ",") -> DataFrame:
    """The wanted columns that the header has, in the order wanted, as text."""
    df = as_text(spark, path, delimiter)
    return df.select(*[c for c in wanted if c in df.columns])


def first_of(df: DataFrame, *names: str):
    """The first of the named columns that df has, or NULL text."""
    held = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{held[n.lower()]}`") for n in names if n.lower() in held), F.lit(None).cast("string"))


def history_stations(df: DataFrame) -> DataFrame:
    """(station_id, usaf, wban, name, state, icao, lat, lon, begin, end) of the identified US stations of a history file.

    Stations without a two-letter state or a USAF number, or outside latitudes
    17 to 72 and longitudes -180 to -65, are left out; of several rows of an id
    the one that ends last stays.
    """
    text = lambda *n: F.trim(first_of(df, *n))
    from ..operators.crosswalk import latest_per_key

    rows = df.select(
        F.lpad(text("USAF"), 6, "0").alias("usaf"), F.lpad(text("WBAN"), 5, "0").alias("wban"), text("STATION NAME", "station_name").alias("name"),
        text("CTRY").alias("ctry"), text("STATE", "ST").alias("state"), text("ICAO", "CALL").alias("icao"),
        text("LAT").try_cast("double").alias("lat"), text("LON").try_cast("double").alias("lon"),
        text("BEGIN", "begin_dt").alias("begin"), text("END", "end_dt").alias("end"),
    )
    rows = rows.where(
        ((F.col("ctry") == "US") | F.col("state").isin(*TERRITORIES)) & (F.length("state") == 2) & (F.col("usaf") != "999999")
        & F.col("lat").between(17, 72) & F.col("lon").between(-180, -65)
    ).withColumn("station_id", F.concat("usaf", "wban"))
    return latest_per_key(rows, ["station_id"], [F.col("end").desc_nulls_last(), F.col("begin"), F.col("name")])


def hourly_feed(df: DataFrame, station_id: str = "STATION", state: str | None = None) -> DataFrame:
    """obs_hourly rows of the hourly feed's columns DATE, REPORT_TYPE, TMP, DEW, AA1 (all text).

    Rows whose DATE is no ISO 8601 instant, or without any of the three measures,
    are left out; year to minute are those that DATE itself writes.
    """
    rows = with_epoch(df.withColumn("_date", F.trim("DATE")), "_date", "_t", only_valid=True)
    t, d, p = isd_temperature(first_of(df, "TMP")), isd_temperature(first_of(df, "DEW")), isd_precipitation(first_of(df, "AA1"))
    rows = once(rows, {"_tmp": t, "_dew": d, "_aa": p}).where(F.coalesce("_tmp.value", "_dew.value", "_aa.mm").isNotNull())
    digits = F.regexp_replace("_date", "[-:]", "")
    part = lambda at, n, kind: F.substring(digits, at, n).cast(kind)
    return rows.select(
        F.trim(station_id).alias("station_id"), F.col("_date").alias("date"), F.coalesce(first_of(df, "REPORT_TYPE"), F.lit("")).alias("report_type"),
        part(5, 2, "tinyint").alias("month"), part(7, 2, "tinyint").alias("day"), part(10, 2, "tinyint").alias("hour"), part(12, 2, "tinyint").alias("minute"),
        F.col("_tmp.value").cast("float").alias("temperature_c"), F.col("_dew.value").cast("float").alias("dewpoint_c"),
        F.col("_aa.mm").cast("float").alias("precip_mm"), F.col("_aa.hours").try_cast("tinyint").alias("precip_hours"),
        F.col("_tmp.qc").alias("temp_qc"), F.col("_dew.qc").alias("dew_qc"), F.col("_aa.qc").alias("precip_qc"), part(1, 4, "int").alias("year"),
        (F.trim(state) if state else F.lit(None).cast("string")).alias("state"),
    )


def hourly_wide(df: DataFrame, station_id: str = "STATION") -> DataFrame:
    """(station_id, date, latitude, longitude, temperature_c, precip_N_period_hrs, precip_N_depth_mm for N 1 to 4) of the hourly feed.

    The shape of older archives: one row per report with up to four precipitation groups; 9999 is missing everywhere.
    """
    groups = []
    for n in range(1, 5):
        p = isd_precipitation(first_of(df, f"AA{n}"))
        groups += [p["hours"].alias(f"precip_{n}_period_hrs"), p["mm"].alias(f"precip_{n}_depth_mm")]
    return df.select(
        F.trim(station_id).alias("station_id"), F.trim("DATE").alias("date"), first_of(df, "LATITUDE").try_cast("double").alias("latitude"),
        first_of(df, "LONGITUDE").try_cast("double").alias("longitude"), isd_temperature(first_of(df, "TMP"))["value"].alias("temperature_c"), *groups,
    )


def quarter_feed(df: DataFrame) -> DataFrame:
    """obs_15min rows of the wide 15-minute feed: one row per slot that holds a number of at least 0.

    Columns of the feed: STATION, NAME, LATITUDE, LONGITUDE, ELEVATION, ELEMENT,
    DATE, and for each of the 96 slots HHMM the value HHMMVal (hundredths of an
    inch) and the flags HHMMMF and HHMMQF. Slots that a file lacks are skipped.
    """
    number = lambda *n: first_of(df, *n).try_cast("double")
    held = {c.lower() for c in df.columns}
    slots = F.array(
        *[
            F.struct(F.lit(s).alias("time"), F.trim(first_of(df, f"{s}Val")).alias("v"), first_of(df, f"{s}MF").alias("mf"), first_of(df, f"{s}QF").alias("qf"))
            for s in SLOTS
            if f"{s}val" in held
        ]
    )
    day = F.split(F.trim("DATE"), "-")
    part = lambda n: F.get(day, F.lit(n)).try_cast("int")
    filled = lambda x: x["v"].isNotNull() & ~x["v"].isin(*MISSING_SLOT)
    rows = df.select(
        F.trim("STATION").alias("station_id"), first_of(df, "NAME", "STATION_NAME").alias("station_name"), number("LATITUDE").alias("lat"),
        number("LONGITUDE").alias("lon"), number("ELEVATION").alias("elevation"), F.trim("ELEMENT").alias("element"),
        part(0).alias("year"), part(1).alias("month"), part(2).alias("day"), F.filter(slots, filled).alias("s"),
    )
    rows = rows.where(F.col("element").isin(*QUARTER_ELEMENTS) & F.col("year").isNotNull() & F.col("month").isNotNull() & F.col("day").isNotNull())
    rows = rows.withColumn("s", F.explode("s")).withColumn("value", null_if(F.col("s.v"), "NaN").try_cast("double")).where("value >= 0 AND NOT isnan(value)")
    return rows.select(
        "station_id", "station_name", "lat", "lon", "elevation", "element", F.col("month").try_cast("tinyint").alias("month"),
        F.col("day").try_cast("tinyint").alias("day"), F.col("s.time").alias("time"), (F.col("value") / F.lit(100.0)).alias("precip_in"),
        blank_or(F.col("s.mf")).alias("flag_measurement"), blank_or(F.col("s.qf")).alias("flag_quality"), "year", state_of(F.col("station_id")).alias("state"),
    )
