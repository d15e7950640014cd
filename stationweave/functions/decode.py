"""Decoders of the raw formats' fields, as column expressions. NULL in gives NULL (or the stated blank) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# State numbers of cooperative station ids, and territories by the id's first letters.
STATES = {
    "01": "AL", "02": "AZ", "03": "AR", "04": "CA", "05": "CO", "06": "CT", "07": "DE", "08": "FL", "09": "GA", "10": "ID",
    "11": "IL", "12": "IN", "13": "IA", "14": "KS", "15": "KY", "16": "LA", "17": "ME", "18": "MD", "19": "MA", "20": "MI",
    "21": "MN", "22": "MS", "23": "MO", "24": "MT", "25": "NE", "26": "NV", "27": "NH", "28": "NJ", "29": "NM", "30": "NY",
    "31": "NC", "32": "ND", "33": "OH", "34": "OK", "35": "OR", "36": "PA", "37": "RI", "38": "SC", "39": "SD", "40": "TN",
    "41": "TX", "42": "UT", "43": "VT", "44": "VA", "45": "WA", "46": "WV", "47": "WI", "48": "WY", "50": "AK", "51": "HI",
    "66": "PR", "67": "VI", "91": "PI",
}
TERRITORIES = {"AQ": "AS", "CQ": "MP", "GQ": "GU", "RQ": "PR", "VQ": "VI", "RW": "PR"}
# Texts that stand for a missing value, by format.
MISSING_MINUTE = ("", "M", "MM", "9999")
MISSING_SLOT = ("", "nan", "-9999", "99999")


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The table's value of a key; the default, or NULL, where it has none."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def null_if(text: Column, *sentinels: str) -> Column:
    """text, NULL where it is one of the sentinels."""
    return F.when(~text.isin(*sentinels), text)


def blank_or(text: Column) -> Column:
    """A flag without blanks at its ends; '' for NULL and 'nan'."""
    t = F.coalesce(F.trim(text), F.lit(""))
    return F.when(t == "nan", "").otherwise(t)


def zfill(text: Column, width: int) -> Column:
    """Zeros in front up to a width; longer texts stay whole, which lpad would cut."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def isd_temperature(raw: Column) -> Column:
    """struct(value in °C, qc) of '+0022,1': tenths and a quality sign. Missing is ±9999; anything else (NULL, '')."""
    form = r"^([+-]?\d{4}),(\w)"
    n = F.regexp_extract(raw, form, 1).try_cast("int")
    return F.struct(
        F.when(~n.isin(9999, -9999), n / F.lit(10.0)).alias("value"), F.coalesce(F.regexp_extract(raw, form, 2), F.lit("")).alias("qc")
    )


def isd_precipitation(raw: Column) -> Column:
    """struct(hours, mm, qc) of '01,0038,9,5': period, tenths of a mm, condition, quality.

    Depth 9999 is missing, its period stays. Fewer than four parts or a part that is no number: (NULL, NULL, '').
    """
    p = F.split(raw, ",")
    hours, depth = F.trim(F.get(p, F.lit(0))).try_cast("int"), F.trim(F.get(p, F.lit(1))).try_cast("int")
    ok = (F.size(p) >= 4) & hours.isNotNull() & depth.isNotNull()
    return F.struct(
        F.when(ok, hours).alias("hours"),
        F.when(ok & (depth != 9999), depth / F.lit(10.0)).alias("mm"),
        F.coalesce(F.when(ok, F.get(p, F.lit(3))), F.lit("")).alias("qc"),
    )


def state_of(station_id: Column) -> Column:
    """State or territory of a station id; the code itself where the tables don't know it."""
    number, letters = F.substring(station_id, 6, 2), F.substring(station_id, 1, 2)
    cooperative = station_id.startswith("USC00") & (F.length(station_id) >= 7)
    return F.when(cooperative, lookup(number, STATES, number)).otherwise(lookup(letters, TERRITORIES, letters))


def leading_year(text: Column, default: int | None = None) -> Column:
    """The first four characters as a year; the default, or NULL, where they are no number."""
    year = F.substring(text, 1, 4).try_cast("int")
    return year if default is None else F.coalesce(year, F.lit(default))


def latitude_longitude(text: Column) -> Column:
    """struct(lat, lon) of '41.5, -72.3', '41.5N 72.3W' or '41.5° N, 72.3° W'; NULL where it isn't a place within ±90/±180."""
    form = r"^\s*([+-]?\d+(?:\.\d+)?)\s*°?\s*([NSns]?)\s*[,;\s]\s*([+-]?\d+(?:\.\d+)?)\s*°?\s*([EWew]?)\s*$"
    part = lambda n: F.regexp_extract(text, form, n)

    def signed(number: int, sign: int, negative: str) -> Column:
        v = part(number).try_cast("double")
        return F.when(F.upper(part(sign)) == negative, -F.abs(v)).otherwise(v)

    lat, lon = signed(1, 2, "S"), signed(3, 4, "W")
    return F.when(F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def utc_of_local(local: Column, utc_hhmm: Column) -> Column:
    """UTC of a local time ('yyyyMMddHHmm') beside the UTC time of day ('HHmm'): the day that lies less than 12 hours off.

    NULL where either can't be read.
    """
    day = F.try_to_timestamp(F.substring(local, 1, 8), F.lit("yyyyMMdd")).cast("date")
    minutes = lambda t: F.substring(t, 1, 2).try_cast("int") * 60 + F.substring(t, 3, 2).try_cast("int")
    ok = lambda t: (F.substring(t, 1, 2).try_cast("int") < 24) & (F.substring(t, 3, 2).try_cast("int") < 60)
    clock = F.substring(local, 9, 4)
    off = minutes(utc_hhmm) - minutes(clock)
    shift = F.when(off < -720, 1).when(off > 720, -1).otherwise(0)
    whole = F.date_add(day, shift).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes(utc_hhmm))
    return F.when(ok(clock) & ok(utc_hhmm), whole)


def composed_minute(year: Column, month: Column, day: Column, hhmm: Column) -> Column:
    """'YYYY-MM-DD HH:MM' of its parts, each filled up with zeros."""
    text = lambda c, n: zfill(c.cast("string"), n)
    clock = text(hhmm, 4)
    return F.concat(
        text(year, 4), F.lit("-"), text(month, 2), F.lit("-"), text(day, 2), F.lit(" "), F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2)
    )


def dominant_resolution(minute: Column, quarter: Column, hourly: Column, daily: Column) -> Column:
    """The finest resolution that a station has; NULL flags count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(minute), "1min").when(yes(quarter), "15min").when(yes(hourly), "hourly").when(yes(daily), "daily").otherwise("none")


def any_of(*conditions: Column) -> Column:
    """Whether any condition holds; NULL counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])
