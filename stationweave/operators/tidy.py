"""Observations of any resolution: those of some stations and years, in one tidy long table.

Filters are written so that they reach the scan: year ranges as half-open ranges
of the column itself, partition columns as they are, station ids as a semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import blank_or, composed_minute, lookup
from ..functions.units import TO_DEG_C, TO_MM, to_common
from ..schemas import TIDY
from .crosswalk import exploded_ids, first_rows

#: Names and units of the variables.
DAILY_UNITS = {"PRCP": "mm", "TMAX": "degC", "TMIN": "degC", "TAVG": "degC"}
DAILY_ELEMENTS = ("PRCP", "TMAX", "TMIN", "SNWD", "SNOW", "AWND", "TAVG")
HOURLY_VARIABLES = {"temperature_c": ("air_temp", "degC", "temp_qc"), "dewpoint_c": ("dew_point", "degC", "dew_qc"), "precip_mm": ("precip_accum", "mm", "precip_qc")}
#: Which list of ids names a resolution's stations.
IDS = {"daily": "ghcnd_ids", "15min": "ghcnd_ids", "hourly_precip": "ghcnd_ids", "hourly": "wban_ids", "1min": "icao_ids"}
DATES = {"daily": ("DATE", "date"), "hourly": ("date", "DATE", "datetime"), "1min": ("timestamp_utc", "datetime_utc"), "15min": ("year",), "hourly_precip": ("DATE", "date")}


def pick(df: DataFrame, *names: str) -> str | None:
    """The first of the names that df has, letter case aside: feeds have named their columns in several ways."""
    held = {c.lower(): c for c in df.columns}
    return next((held[n.lower()] for n in names if n.lower() in held), None)


def year_range(df: DataFrame, column: str, first: int, last: int) -> Column:
    """Whether a row lies in the years, as a condition that the scan can use.

    Whole numbers are years; dates and timestamps become a half-open range; of
    texts the first four characters are the year, and one that isn't a date is in
    no year.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).between(first, last)
    if kind == "string":
        day = F.substring(F.trim(column), 1, 10).try_cast("date")
        # what the scan can use; a text with blanks in front isn't in order
        order = ((F.col(column) >= str(first)) & (F.col(column) < str(last + 1))) | F.col(column).startswith(" ")
        return order & day.isNotNull() & F.year(day).between(first, last)
    low, high = (F.lit(f"{y:04d}-01-01").cast(kind) for y in (first, last + 1))
    return (F.col(column) >= low) & (F.col(column) < high)


def extract(df: DataFrame, resolution: str, first: int, last: int, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Raw observations of the years, and of the stations in ids (a column id) where given; no ids give no rows.

    Daily and 15-minute ids are whole, hourly ones the WBAN in the id, one-minute
    ones airport codes. A hourly table with a year column is pruned by it too.
    """
    date = pick(df, *DATES[resolution])
    if date is None:
        raise ValueError(f"none of the date columns {DATES[resolution]} is there")
    out = df.where(year_range(df, date, first, last))
    if resolution == "hourly" and (year := pick(df, "year")) and year != date:
        out = out.where(F.col(year).between(first - 1, last + 1))  # an offset may carry a reading over the year's end
    if ids is not None:
        key = {"hourly": F.substring("station_id", 7, 5), "1min": F.col("icao") if pick(df, "icao") else None}.get(resolution, F.col(pick(df, "station_id", "STATION", "station") or "station_id"))
        out = out.join(ids.select(F.col("id").alias("_id")).distinct(), key == F.col("_id"), "left_semi")
    return out if limit is None else out.limit(limit)


def station_meta(stations: DataFrame, resolution: str) -> DataFrame:
    """(station_id, station_name, state, lat, lon) by each id that a resolution knows a station by; of several stations of an id the lowest."""
    ids = exploded_ids(stations, "ncei_id", IDS[resolution])
    rows = ids.join(stations.select("ncei_id", "station_name", "state", "lat", "lon"), "ncei_id")
    return first_rows(rows, ["id"], [F.col("ncei_id")]).select(F.col("id").alias("station_id"), "station_name", "state", "lat", "lon")


def _finish(rows: DataFrame, meta: DataFrame, resolution: str, source: str, embedded: bool = False) -> DataFrame:
    """rows with station_id, datetime, variable, value, unit, quality_flag, and embedded place and name where they have them."""
    m = meta.select(F.col("station_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("station_name", "state", "lat", "lon")])
    out = rows.join(m, F.col("station_id") == F.col("_id"), "left")
    held = set(rows.columns) if embedded else set()
    first = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in held else F.col(f"_{c}")
    out = out.withColumns({"_n": first("station_name"), "_s": first("state"), "_a": first("lat"), "_o": first("lon")})
    value = F.col("value").try_cast("double")
    out = out.select(
        "station_id", F.col("_n").alias("station_name"), F.col("_s").alias("state"), F.col("_a").cast("double").alias("lat"), F.col("_o").cast("double").alias("lon"),
        "datetime", F.lit(resolution).alias("resolution"), "variable", value.alias("value"), "unit", F.lit(source).alias("source"), "quality_flag",
    )
    return out.where("value IS NOT NULL AND NOT isnan(value)").select([f.name for f in TIDY])


def daily(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Daily rows, wide (a column per element) or long (element, value, qflag); values are in mm and °C already."""
    station, date = pick(df, "STATION", "station_id"), pick(df, "DATE", "date")
    head = [F.col(station).alias("station_id"), F.col(date).cast("string").alias("datetime")]
    if element := pick(df, "ELEMENT"):
        flag = pick(df, "QFLAG")
        rows = df.select(*head, F.col(element).alias("variable"), F.col(pick(df, "VALUE")).alias("value"), (F.coalesce(flag, F.lit("")) if flag else F.lit("")).alias("quality_flag"))
    else:
        wide = [c for e in DAILY_ELEMENTS if (c := pick(df, e))]
        rows = df.select(*head, *[F.col(c).cast("double").alias(c.upper()) for c in wide])
        rows = rows.unpivot(["station_id", "datetime"], [c.upper() for c in wide], "variable", "value").withColumn("quality_flag", F.lit(""))
    return _finish(rows.withColumn("unit", lookup(F.col("variable"), DAILY_UNITS, F.lit("unknown"))), meta, "daily", "GHCN")


def minute(df: DataFrame, meta: DataFrame, dew_point: bool = False) -> DataFrame:
    """One-minute rows, inches and °F to mm and °C, older and newer column names; the dew point only on request."""
    found = {
        "precip_1min_in": (pick(df, "precip_in", "precip_1min_in"), "in", "mm"), "air_temp": (pick(df, "temp_f"), "degF", "degC"),
        "dew_point": (pick(df, "dew_f") if dew_point else None, "degF", "degC"),
    }
    kept = [F.struct(F.lit(v).alias("variable"), to_common(F.col(c).cast("double"), u).alias("value"), F.lit(unit).alias("unit")) for v, (c, u, unit) in found.items() if c]
    places = [c for c in ("station_name", "state", "lat", "lon") if pick(df, c)]
    rows = df.select(F.col("icao").alias("station_id"), F.col(pick(df, *DATES["1min"])).cast("string").alias("datetime"), *places, F.inline(F.array(*kept)))
    return _finish(rows.withColumn("quality_flag", F.lit("")), meta, "1min", "ASOS", embedded=True)


def quarter(df: DataFrame, meta: DataFrame) -> DataFrame:
    """15-minute rows, inches to mm; their own place and name come before the station table's."""
    rows = df.withColumns({
        "datetime": composed_minute(F.col("year"), F.col("month"), F.col("day"), F.col("time")), "variable": F.col("element"),
        "value": to_common(F.col("precip_in"), "in"), "unit": F.lit("mm"), "quality_flag": blank_or(F.col("flag_quality")),
    })
    return _finish(rows, meta, "15min", "NCEI", embedded=True)


def hourly(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Hourly rows: temperature, dew point and precipitation with their quality signs, under the WBAN of the id."""
    qc = lambda c: F.coalesce(F.col(c), F.lit("")) if pick(df, c) else F.lit("")
    kept = [
        F.struct(F.lit(v).alias("variable"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit"), qc(q).alias("quality_flag"))
        for c, (v, u, q) in HOURLY_VARIABLES.items()
    ]
    rows = df.select(F.substring("station_id", 7, 5).alias("station_id"), F.col(pick(df, *DATES["hourly"])).cast("string").alias("datetime"), F.inline(F.array(*kept)))
    return _finish(rows, meta, "hourly", "ASOS_ISD")


def hourly_precip(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Hourly precipitation rows in inches; the value's column is HlyPrcp or the first that names precipitation."""
    value = pick(df, "HlyPrcp", "hlyprcp_in", "hly_prcp") or next((c for c in df.columns if "prcp" in c.lower() and "qc" not in c.lower()), None)
    station, date = pick(df, "STATION", "station_id"), pick(df, *DATES["hourly_precip"])
    number = to_common(F.col(value).try_cast("double"), "in") if value else F.lit(None).cast("double")
    rows = df.select(
        F.col(station).cast("string").alias("station_id"), F.col(date).cast("string").alias("datetime"), F.lit("HlyPrcp" if value else "unknown").alias("variable"),
        number.alias("value"), F.lit("mm" if value else "unknown").alias("unit"), F.lit("").alias("quality_flag"),
    )
    return _finish(rows, meta, "hourly_precip", "HPD")


NORMALISE = {"daily": daily, "1min": minute, "15min": quarter, "hourly": hourly, "hourly_precip": hourly_precip}


@dataclass(frozen=True)
class Observations:
    """A resolution's table with what is asked of it, built up step by step."""

    df: DataFrame
    resolution: str
    stations: DataFrame | None = None
    span: tuple[int, int] | None = None

    def for_stations(self, stations: DataFrame) -> Observations:
        return Observations(self.df, self.resolution, stations, self.span)

    def years(self, first: int, last: int) -> Observations:
        return Observations(self.df, self.resolution, self.stations, (first, last))

    def raw(self) -> DataFrame:
        ids = None if self.stations is None else exploded_ids(self.stations, "ncei_id", IDS[self.resolution])
        return extract(self.df, self.resolution, *(self.span or (0, 9998)), ids)

    def tidy(self, meta: DataFrame) -> DataFrame:
        return NORMALISE[self.resolution](self.raw(), meta)


def merged(*parts: DataFrame) -> DataFrame:
    """Tidy tables of several resolutions as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wide(tidy: DataFrame, variables: list[str], keys: tuple[str, ...] = ("station_id", "datetime")) -> DataFrame:
    """A column per variable; of several values of a key the largest. The variables are given, so no pass looks for them."""
    return tidy.groupBy(*keys).pivot("variable", variables).agg(F.max("value"))


def stations_in(tidy: DataFrame) -> DataFrame:
    """(stations, rows) of a tidy table."""
    return tidy.agg(F.countDistinct("station_id").alias("stations"), F.count(F.lit(1)).alias("rows"))


assert set(DAILY_UNITS.values()) <= {*TO_DEG_C, *TO_MM}
