"""What file names say: extension, station, format of the station id, date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of several parts, and the extensions that hold data.
COMPOUND = (".dat.parquet", ".15m.parquet", ".csv.gz", ".tar.gz", ".tar.gz.gz")
DATA = (".parquet", ".csv", ".txt", ".dat", ".dat.parquet", ".15m.parquet", ".dly", ".csv.gz")
# Patterns of the naming schemes in order, each with the format of its id; the first that matches decides.
SCHEMES = (
    (r"^((?:AQC|CQC|FQC|GQC|MQC|RQC|RQW|SQC|USC|USW|VQC)\d{8})(?:\.csv|\.parquet|\.15m\.parquet)$", "GHCND_HPD"),
    (r"^6406([A-Z0-9]{5})\d{6}\.parquet$", "ICAO_ASOS"),
    (r"(?i)^asos-1min-pg2-([A-Z0-9]{4})-\d{6}\.parquet$", "ICAO_ASOS"),
    (r"^(\d{6})\d{5}\.parquet$", "USAF_WBAN"),
    (r"^(A\d{10})\.parquet$", "ASOS_A"),
    (r"^([A-Z]{2}[A-Z0-9]{9})\.dly$", "GHCND_DLY"),
    (r"(?i)^((?:US|RQ|VQ|CQ|GQ|AQ|MQ|FQ|SQ|RW)[A-Z0-9_]{9})\.parquet$", "GHCND_DLY"),
    (r"^([A-Z]{2})_raw_daily_\w+\.csv\.gz$", "STATE_AGGREGATE"),
    (r"^([A-Z]{2})_(?:station_locations|station_summary|station_year_summary|yearly_summary)\.csv$", "STATE_METADATA"),
)
# Files of many stations, which have no id.
AGGREGATES = (
    r"(?i)^(?:stations_master|stations_crosswalk|raw_file_inventory|hpd15_station|master_station|all_states)",
    r"(?i)^3260\w+\.dat\.parquet$",
    r"^3260_\d+_(?:por-)?\d{4}(?:-\d{4})?\.parquet$",
    r"^\d{4}\.parquet$",
)


def extension(name: Column) -> Column:
    """The extension in small letters, with its dot; compound ones whole, '' where there is none."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for c in COMPOUND:
        out = F.coalesce(out, F.when(low.endswith(c), F.lit(c)))
    return F.coalesce(out, F.regexp_extract(low, r"^.*[^.].*?(\.[^.]*)$", 1), F.lit(""))


def station_of_file(name: Column) -> Column:
    """struct(station_id_raw, id_format, failed) of a file name.

    A file of many stations has neither id nor format and isn't failed; a name
    of no known scheme is. Four-letter airport codes get a 0 in front.
    """
    id_, form = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, f in SCHEMES:
        hit = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
        if f == "ICAO_ASOS":
            code = F.upper(hit)
            hit = F.when(F.length(code) == 5, code).when(code.isNotNull(), F.concat(F.lit("0"), code))
        form = F.coalesce(form, F.when(hit.isNotNull(), F.lit(f)))
        id_ = F.coalesce(id_, hit)
    several = F.lit(False)
    for pattern in AGGREGATES:
        several = several | F.coalesce(name.rlike(pattern), F.lit(False))
    return F.struct(id_.alias("station_id_raw"), form.alias("id_format"), (id_.isNull() & ~several).alias("failed"))


def date_part(name: Column) -> Column:
    """'YYYY-MM' or 'YYYY' of the names that are known to hold one; NULL for others."""
    stamp = F.coalesce(
        F.nullif(F.regexp_extract(name, r"^6406[A-Z0-9]{5}(\d{6})\.parquet$", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"(?i)^asos-1min-pg2-[A-Z0-9]{4}-(\d{6})\.parquet$", 1), F.lit("")),
    )
    year = F.nullif(F.regexp_extract(name, r"^(\d{4})\.parquet$", 1), F.lit(""))
    return F.coalesce(F.concat(F.substring(stamp, 1, 4), F.lit("-"), F.substring(stamp, 5, 2)), year)


def subfolder(path: Column, root: str) -> Column:
    """The folder directly under the root, or 'root' for a file that lies in it."""
    rest = F.split(F.regexp_replace(F.substring(path, len(root) + 1, 1 << 20), "^/+", ""), "/")
    return F.when(F.size(rest) >= 2, F.get(rest, F.lit(0))).otherwise("root")
