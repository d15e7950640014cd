"""Station identities: history collapsed to stations, lists of ids matched with keys, the master list and what it misses.

Lists of ids are arrays inside; a list meets a key by exploding it, which is an
equi-join, never by comparing texts piece by piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decode import any_of
from ..schemas import MASTER, conform

#: Kinds of ids that a history row may have.
ID_KINDS = ("wban", "icao", "ghcnd", "coop", "hpd", "wmo", "faa", "nwsli")
#: Degrees within which a station without a shared id counts as the same place.
TOLERANCE = 0.01


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that must decide all ties. NULL keys are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    return first_rows(df, keys, order, 1)


def id_list(ids: Column, separator: str = "|") -> Column:
    """An array of ids as text, sorted, without repeats and NULLs; NULL where it's empty."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(ids))), separator), F.lit(""))


def exploded_ids(df: DataFrame, key: str, ids: str, separator: str = "|") -> DataFrame:
    """(key, id): the distinct ids of delimited lists, without blanks; empty places give none."""
    parts = F.split(F.col(ids), f"[{separator}]")
    return df.select(key, F.explode(parts).alias("id")).select(key, F.trim("id").alias("id")).where("id != ''").distinct()


def with_membership(df: DataFrame, key: str, ids: str, table: DataFrame, table_key: str, aggregates: list[Column]) -> DataFrame:
    """df with aggregates over the rows of table whose key is one of its ids: one row per row of df.

    Ids are matched whole; % and _ in them are letters like any other.
    """
    hits = exploded_ids(df, key, ids).join(table, F.col("id") == F.col(table_key)).groupBy(key).agg(*aggregates)
    return df.join(hits, key, "left")


def without_member(table: DataFrame, table_key: str, df: DataFrame, key: str, ids: str) -> DataFrame:
    """The rows of table whose key is in no row's list of ids: orphans. A NULL key is in none."""
    known = exploded_ids(df, key, ids).select(F.col("id").alias("_known")).distinct()
    return table.join(known, F.col(table_key) == F.col("_known"), "left_anti")


def collapsed_history(history: DataFrame) -> DataFrame:
    """One row per ncei_id: its active or else latest period, with the ids of all its periods as sorted lists.

    Of periods alike the one that began last stays, then the first by name.
    """
    order = [
        F.col("is_active").desc_nulls_last(), F.col("end_date").desc_nulls_last(), F.col("begin_date").desc_nulls_last(),
        F.col("station_name").asc_nulls_last(), F.col("lat_dec").asc_nulls_last(), F.col("lon_dec").asc_nulls_last(),
    ]
    keep = ["ncei_id", "station_name", "state", "county", "country_code", "lat_dec", "lon_dec", "elev_m", "station_type", "is_active", "has_coordinates"]
    base = latest_per_key(history, ["ncei_id"], order).select(*keep)
    lists = history.groupBy("ncei_id").agg(*[id_list(F.collect_set(f"{k}_id")).alias(f"{k}_ids") for k in ID_KINDS])
    return base.join(lists, "ncei_id")


def crosswalk(stations: DataFrame, key: str, keep: list[str], ids: list[str]) -> DataFrame:
    """(key, kept columns, id_type, id_value): a row per id of the given columns that isn't NULL; the type is the column's name without _id."""
    long = stations.select(key, *keep, *ids).unpivot([key, *keep], ids, "id_type", "id_value")
    return long.where("id_value IS NOT NULL").withColumn("id_type", F.upper(F.regexp_replace("id_type", "_id$", "")))


def nearest_within(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, tolerance: float = TOLERANCE, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """(left_key, right_key, dist): for each left row the nearest right row within tolerance degrees in both directions.

    dist is the sum of both differences; of equally near ones the lowest key
    wins. Cells of the tolerance's size meet their neighbours by an equi-join.
    Rows without coordinates match nothing. Both tables may have columns of any
    names.
    """
    cell = lambda c: F.floor(c / F.lit(tolerance)).cast("bigint")
    a = left.select(F.col(left_key).alias("_lk"), F.col(lat).alias("_la"), F.col(lon).alias("_lo")).where("_la IS NOT NULL AND _lo IS NOT NULL")
    b = right.select(F.col(right_key).alias("_rk"), F.col(lat).alias("_ra"), F.col(lon).alias("_ro")).where("_ra IS NOT NULL AND _ro IS NOT NULL")
    around = F.array(*[F.lit(k).cast("bigint") for k in (-1, 0, 1)])
    a = a.withColumn("_y", F.explode(F.transform(around, lambda k: cell(F.col("_la")) + k)))
    a = a.withColumn("_x", F.explode(F.transform(around, lambda k: cell(F.col("_lo")) + k)))
    b = b.withColumns({"_y": cell(F.col("_ra")), "_x": cell(F.col("_ro"))})
    dy, dx = F.abs(F.col("_ra") - F.col("_la")), F.abs(F.col("_ro") - F.col("_lo"))
    near = a.join(b, ["_y", "_x"]).where((dy <= tolerance) & (dx <= tolerance)).select("_lk", "_rk", (dy + dx).alias("dist"))
    best = near.groupBy("_lk").agg(F.min(F.struct("dist", "_rk")).alias("m"))
    return best.select(F.col("_lk").alias(left_key), F.col("m._rk").alias(right_key), F.col("m.dist").alias("dist"))


def minute_sources(inventory: DataFrame) -> DataFrame:
    """(icao, file_count, data_gb, earliest_date, latest_date) of the one-minute files of a file inventory."""
    rows = inventory.where("source = 'ASOS' AND subfolder = '1min' AND id_format = 'ICAO_ASOS'")
    return rows.groupBy(F.substring("station_id_raw", 2, 4).alias("icao")).agg(
        F.count(F.lit(1)).alias("file_count"), F.round(F.sum("file_size_bytes") / 1e9, 3).alias("data_gb"),
        F.min("date_part").alias("earliest_date"), F.max("date_part").alias("latest_date"),
    )


def master_list(
    collapsed: DataFrame, minute: DataFrame, hourly: DataFrame, quarter: DataFrame, daily: DataFrame, unlisted: DataFrame | None = None
) -> DataFrame:
    """The 38 columns of the master list: each station once, what every resolution has of it, and the stations that no list has.

    minute: minute_sources. hourly, quarter, daily: station inventories. One-minute
    files match by airport code, hourly stations by the WBAN in their id, the
    others by their whole id. Several matches of a station are summed up, so none
    multiplies its row. 15-minute stations in no list are added with their own
    coordinates; unlisted (station_id, usaf_code, station_name, state, lat, lon,
    elev_m, file_count, data_gb) are matched by place within TOLERANCE, and added
    where that fails.
    """
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    gb = lambda per, name: F.round(F.sum("file_count") * F.lit(per), 3).alias(name)
    m = with_membership(collapsed, "ncei_id", "icao_ids", minute, "icao", [
        total("file_count", "asos_1min_files"), F.round(F.sum("data_gb"), 3).alias("asos_1min_gb"),
        F.min("earliest_date").alias("asos_1min_start"), F.max("latest_date").alias("asos_1min_end"),
    ])
    by_wban = hourly.where("station_id IS NOT NULL").select(F.substring("station_id", 7, 5).alias("wban"), "file_count")
    m = with_membership(m, "ncei_id", "wban_ids", by_wban, "wban", [total("file_count", "asos_isd_files"), gb(0.001, "asos_isd_gb")])
    m = with_membership(m, "ncei_id", "ghcnd_ids", quarter.select("station_id", "file_count"), "station_id", [total("file_count", "ncei_files"), gb(0.001, "ncei_data_gb")])
    m = with_membership(m, "ncei_id", "ghcnd_ids", daily.select("station_id", "file_count"), "station_id", [total("file_count", "ghcn_daily_files"), gb(0.0001, "ghcn_daily_data_gb")])
    m = m.withColumns({
        "has_asos_1min": F.col("asos_1min_files").isNotNull(), "has_asos_isd": F.col("asos_isd_files").isNotNull(),
        "has_ncei_15min": F.col("ncei_files").isNotNull(), "has_ghcn_daily": F.col("ghcn_daily_files").isNotNull(),
        "has_hpd_1hr": F.lit(False), "hpd_files": F.lit(0), "hpd_data_gb": F.lit(0.0), "homr_matched": F.lit(True),
    })
    orphans = without_member(quarter, "station_id", collapsed, "ncei_id", "ghcnd_ids").select(
        F.col("station_id").alias("ncei_id"), "state", F.col("lat").alias("lat_dec"), F.col("lon").alias("lon_dec"),
        F.col("station_id").alias("ghcnd_ids"), F.col("lat").isNotNull().alias("has_coordinates"), F.lit(True).alias("has_ncei_15min"),
        F.col("file_count").alias("ncei_files"), F.lit(False).alias("has_hpd_1hr"), F.lit(False).alias("has_ghcn_daily"),
        F.lit(False).alias("homr_matched"), F.lit("NCEI_15MIN_FALLBACK").alias("source_if_orphan"),
    )
    parts = [orphans]
    if unlisted is not None:
        places = collapsed.select("ncei_id", F.col("lat_dec").alias("lat"), F.col("lon_dec").alias("lon"))
        near = nearest_within(unlisted, "station_id", places, "ncei_id")
        codes = near.join(unlisted.select("station_id", "usaf_code"), "station_id").groupBy("ncei_id").agg(F.min("usaf_code").alias("usaf_id"))
        m = m.join(codes, "ncei_id", "left")
        parts.append(
            unlisted.join(near.select("station_id"), "station_id", "left_anti").select(
                F.col("station_id").alias("ncei_id"), "station_name", "state", F.col("lat").alias("lat_dec"), F.col("lon").alias("lon_dec"), "elev_m",
                (F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("has_coordinates"), F.lit(True).alias("has_asos_isd"),
                F.col("file_count").alias("asos_isd_files"), F.col("data_gb").alias("asos_isd_gb"), F.lit(False).alias("homr_matched"),
                F.col("usaf_code").alias("usaf_id"), F.lit("ASOS_USAF").alias("source_if_orphan"),
            )
        )
    return reduce(DataFrame.unionByName, [conform(p, MASTER) for p in (m, *parts)])


def fallback_master(daily: DataFrame, quarter: DataFrame) -> DataFrame:
    """The master list without a history: every station of the daily and 15-minute inventories once, the daily one's attributes first."""
    one = lambda df, n: df.where("station_id IS NOT NULL").groupBy("station_id").agg(
        *[F.min_by(c, F.struct("lat", "lon", "state")).alias(f"{c}_{n}") for c in ("state", "lat", "lon")], F.lit(True).alias(f"has_{n}")
    )
    both = one(daily, "d").join(one(quarter, "q"), "station_id", "full_outer")
    pick = lambda c: F.coalesce(f"{c}_d", f"{c}_q")
    out = both.select(
        F.col("station_id").alias("ncei_id"), pick("state").alias("state"), pick("lat").alias("lat_dec"), pick("lon").alias("lon_dec"),
        F.col("station_id").alias("ghcnd_ids"), F.coalesce("has_q", F.lit(False)).alias("has_ncei_15min"),
        F.coalesce("has_d", F.lit(False)).alias("has_ghcn_daily"), F.lit(False).alias("has_hpd_1hr"), F.lit(False).alias("homr_matched"),
        F.lit("FALLBACK").alias("source_if_orphan"),
    )
    return conform(out.withColumn("has_coordinates", F.col("lat_dec").isNotNull() & F.col("lon_dec").isNotNull()), MASTER)


def listed(master: DataFrame) -> DataFrame:
    """The master list in the order of its file: matched stations first, then by state (none last), name and id."""
    return master.orderBy(F.col("homr_matched").desc(), F.col("state").asc_nulls_last(), F.col("station_name").asc_nulls_last(), "ncei_id")


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_null, null_rate) of the columns, in one pass."""
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.try_divide(F.count_if(F.col(c).isNull()), n).alias("null_rate")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def known_before_new(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of new that known lacks, each once."""
    return new.select(key).distinct().join(known.select(key), key, "left_anti")


def usable(master: DataFrame, lat: str = "lat_dec", lon: str = "lon_dec") -> Column:
    """Whether a station can be shown: coordinates and data of any resolution."""
    has = any_of(*[F.col(c) for c in ("has_asos_1min", "has_asos_isd", "has_hpd_1hr", "has_ncei_15min", "has_ghcn_daily")])
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & has
