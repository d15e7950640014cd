"""Lines of fixed width and lines of words, from a column `value` of text into typed columns.

Every parser takes a DataFrame with the column value, so the same plan reads
files (`lines`), archive members and composed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import MISSING_MINUTE, null_if, utc_of_local
from ..functions.once import once

# Fields as (name, first place from 0, place behind the last).
STATION_LIST = (("STATION", 0, 11), ("LAT", 12, 20), ("LON", 21, 30), ("ELEV", 31, 37), ("STATE", 38, 40), ("NAME", 41, 71))
HISTORY = (
    ("ncei_id", 0, 8), ("begin_date", 9, 17), ("end_date", 18, 26), ("coop_id", 27, 33), ("wban_id", 34, 39), ("icao_id", 40, 44),
    ("faa_id", 45, 50), ("nwsli_id", 51, 56), ("wmo_id", 57, 62), ("ghcnd_id", 74, 85), ("station_name", 86, 186), ("country_code", 187, 189),
    ("state", 226, 228), ("county", 229, 264), ("lat_dec", 272, 281), ("lon_dec", 282, 292), ("elev_m", 342, 350), ("station_type", 369, 469),
    ("hpd_id", 525, 536),
)
ELEMENTS = ("PRCP", "TMAX", "TMIN", "TAVG")
PREFIXES = ("US", "RQ", "VQ", "CQ", "GQ", "AQ", "MQ", "FQ", "SQ", "RW")
TERRITORIES = ("PR", "VI", "GU", "AS", "MP")
#: Places of a day's slot in an element's month: value, measurement, quality and source flag.
SLOT, FIRST_SLOT, NONE = 8, 21, -9999


def lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """(value) of text files; skip: lines left out at the head of each file.

    A file with other bytes than UTF-8, or with lines to skip, is read whole by
    one task, since only its start knows which lines those are.
    """
    if encoding.upper() == "UTF-8" and not skip:
        return spark.read.text(path)
    text = F.decode("content", encoding)
    whole = spark.read.format("binaryFile").load(path).select(F.split(text, r"\r?\n").alias("all"))
    kept = F.slice("all", F.lit(skip + 1), F.greatest(F.size("all") - skip, F.lit(0)))
    return whole.select(F.explode(kept).alias("value")).where("value != ''")


def cut(fields: tuple[tuple[str, int, int], ...], value: str = "value") -> list[Column]:
    """Columns of fixed fields, without blanks at their ends; NULL where nothing is left."""
    return [F.nullif(F.trim(F.substring(value, a + 1, b - a)), F.lit("")).alias(n) for n, a, b in fields]


def station_list(text: DataFrame, prefixes: tuple[str, ...] = ("US",)) -> DataFrame:
    """(STATION, LAT, LON, ELEV, STATE, NAME) of the stations whose id begins with one of the prefixes."""
    df = text.select(*cut(STATION_LIST))
    number = {c: F.col(c).try_cast("double") for c in ("LAT", "LON", "ELEV")}
    return df.where(F.substring("STATION", 1, 2).isin(*prefixes)).withColumns(number)


def station_history(text: DataFrame) -> DataFrame:
    """The history's fields of stations in the US or a territory, dates typed, with is_active and has_coordinates.

    The date 00010101 means unknown; an end in the year 9999 that the station is active.
    """
    df = text.select(*cut(HISTORY))
    df = df.where((F.col("country_code") == "US") | F.col("state").isin(*TERRITORIES))
    day = lambda c: F.try_to_timestamp(null_if(F.col(c), "00010101"), F.lit("yyyyMMdd")).cast("date")
    number = {c: F.col(c).try_cast("double") for c in ("lat_dec", "lon_dec", "elev_m")}
    df = df.withColumns({"begin_date": day("begin_date"), "end_date": day("end_date"), **number})
    return df.withColumns(
        {
            "is_active": F.coalesce(F.year("end_date") == 9999, F.lit(False)),
            "has_coordinates": F.col("lat_dec").isNotNull() & F.col("lon_dec").isNotNull(),
        }
    )


def daily_elements(text: DataFrame, elements: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """(station, date, element, value, mflag, qflag, sflag): a row per day of each element's month, values as recorded.

    A missing value without any flag is left out, one with a flag stays as NULL;
    so are days that the month doesn't have, slots that the line doesn't hold, and
    lines of fewer than 29 characters.
    """
    v = F.col("value")
    month = F.concat(F.substring(v, 12, 4), F.lit("-"), F.substring(v, 16, 2), F.lit("-"))
    df = text.where((F.length("value") >= 29) & F.substring("value", 18, 4).isin(*elements))
    df = df.select(
        F.substring(v, 1, 11).alias("station"), F.substring(v, 18, 4).alias("element"), month.alias("month"),
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.struct(
            d.alias("day"), F.substring(v, (d - 1) * SLOT + FIRST_SLOT + 1, F.lit(SLOT)).alias("slot")
        ))).alias("s"),
    ).select("station", "element", "month", "s.*")
    flag = lambda n: F.trim(F.substring("slot", n, 1))
    df = df.where(F.length("slot") == SLOT).select(
        "station", F.concat("month", F.lpad(F.col("day").cast("string"), 2, "0")).try_cast("date").alias("date"), "element",
        F.trim(F.substring("slot", 1, 5)).try_cast("int").alias("value"), flag(6).alias("mflag"), flag(7).alias("qflag"), flag(8).alias("sflag"),
    )
    flagged = F.concat("mflag", "qflag", "sflag") != ""
    return df.where(F.col("value").isNotNull() & F.col("date").isNotNull() & ((F.col("value") != NONE) | flagged)).withColumn(
        "value", F.when(F.col("value") != NONE, F.col("value"))
    )


def daily_wide(text: DataFrame) -> DataFrame:
    """(STATION, DATE, PRCP, TMAX, TMIN, TAVG) in mm and °C; of an element given twice for a day the larger value."""
    long = daily_elements(text).withColumn("value", F.col("value") / F.lit(10.0))
    return long.groupBy(F.col("station").alias("STATION"), F.col("date").alias("DATE")).pivot("element", list(ELEMENTS)).agg(F.max("value"))


def minute_lines(text: DataFrame) -> DataFrame:
    """(wban, icao, timestamp_utc, precip_id, precip_in, temp_f, dew_f) of one-minute lines of at least ten words.

    The second word holds local time and UTC clock; precipitation is the fifth
    word where there are eleven and it is a number, else the fourth; temperature
    and dew point are the last two.
    """
    df = once(text.select("value"), {"w": F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")})
    word = lambda n: F.get("w", F.lit(n))
    df = df.where((F.size("w") >= 10) & (F.length(word(0)) >= 9) & (F.length(word(1)) >= 19))
    df = once(df, {"timestamp_utc": utc_of_local(F.substring(word(1), 4, 12), F.substring(word(1), 16, 4))}).where("timestamp_utc IS NOT NULL")

    def number(c: Column) -> Column:
        return null_if(F.upper(F.trim(c)), *MISSING_MINUTE).try_cast("double")

    rain = F.when((F.size("w") >= 11) & number(word(4)).isNotNull(), number(word(4))).otherwise(number(word(3)))
    return df.select(
        F.substring(word(0), 1, 5).alias("wban"), F.substring(word(0), 6, 4).alias("icao"),
        "timestamp_utc", word(2).alias("precip_id"),
        rain.alias("precip_in"), number(F.element_at("w", -2)).alias("temp_f"), number(F.element_at("w", -1)).alias("dew_f"),
    )
