"""Which stations, and which of their years: loading with year ranges per resolution, and the filters of a selection.

A selection is built up step by step and stays one lazy plan:
    Stations(load(...)).in_states(["TX"]).with_data(["daily"], 1990, 2000).within_km(31, -97, 100).df
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import dominant_resolution, leading_year
from ..functions.geo import great_circle_km
from .crosswalk import exploded_ids, usable

#: Each resolution: flag, list of ids that its inventory is keyed by, default first and last year, files and GB a file (fixed values).
RESOLUTIONS = {
    "daily": ("has_ghcn_daily", "ghcnd_ids", 1950, 2026, "ghcn_daily_files", 0.0001),
    "hourly": ("has_asos_isd", "wban_ids", 1930, 2026, "asos_isd_files", 0.0001),
    "15min": ("has_ncei_15min", "ghcnd_ids", 1970, 2026, "ncei_files", 0.0006),
    "1min": ("has_asos_1min", "icao_ids", 2000, 2026, "asos_1min_files", 0.000463),
}
#: Years of a station without any resolution (fixed values).
NO_YEARS = (1900, 2026)
#: Named boxes as (south, north, west, east, inclusive).
BOXES = {
    "us_and_territories": (17.0, 72.0, -180.0, -65.0, True),
    "world": (-90.0, 90.0, -180.0, 180.0, True),
    "conus": (23.0, 51.0, -126.0, -65.0, False),
    "usa_rough": (24.0, 50.0, -125.0, -66.0, True),
}


def load(master: DataFrame, inventories: dict[str, DataFrame]) -> DataFrame:
    """Usable stations with first and last year of each resolution (daily_start_year, daily_end_year, ...), data_start, data_end, dominant_res.

    inventories: station inventories by resolution; a resolution without one, or
    a station that it lacks, takes the default years, for 1min the years that the
    master list names first. Hourly ids are matched by their last five characters.
    NULL flags are false, NULL file counts 0.
    """
    flags = {r[0]: F.coalesce(r[0], F.lit(False)) for r in RESOLUTIONS.values()}
    counts = {r[4]: F.coalesce(r[4], F.lit(0)).cast("bigint") for r in RESOLUTIONS.values()}
    df = master.where(usable(master)).withColumnsRenamed({"lat_dec": "lat", "lon_dec": "lon"}).withColumns(flags | counts)
    years = {}
    for name, (flag, ids, low, high, _, _) in RESOLUTIONS.items():
        inv = inventories.get(name)
        if inv is None:
            found = [F.lit(None).cast("int"), F.lit(None).cast("int")]
        else:
            key = F.substring("station_id", -5, 5) if name == "hourly" else F.col("station_id")
            inv = inv.select(key.alias("_id"), "earliest_dt", "latest_dt")
            span = (
                exploded_ids(df.where(F.col(flag)), "ncei_id", ids)
                .join(inv, F.col("id") == F.col("_id"))
                .groupBy("ncei_id")
                .agg(F.year(F.min("earliest_dt")).alias(f"_{name}_a"), F.year(F.max("latest_dt")).alias(f"_{name}_b"))
            )
            df = df.join(span, "ncei_id", "left")
            found = [F.col(f"_{name}_a"), F.col(f"_{name}_b")]
        if name == "1min":
            found = [F.coalesce(f, leading_year(F.col(c))) for f, c in zip(found, ("asos_1min_start", "asos_1min_end"))]
        for f, side, default in zip(found, ("start", "end"), (low, high)):
            years[f"{name}_{side}_year"] = F.coalesce(F.when(F.col(flag), f), F.lit(default))
    df = df.withColumns(years)
    only = lambda name, side: F.when(F.col(RESOLUTIONS[name][0]), F.col(f"{name}_{side}_year"))
    return df.withColumns(
        {
            "data_start": F.coalesce(F.least(*[only(n, "start") for n in RESOLUTIONS]), F.lit(NO_YEARS[0])),
            "data_end": F.coalesce(F.greatest(*[only(n, "end") for n in RESOLUTIONS]), F.lit(NO_YEARS[1])),
            "dominant_res": dominant_resolution(*[F.col(RESOLUTIONS[n][0]) for n in ("1min", "15min", "hourly", "daily")]),
        }
    ).drop(*[f"_{n}_{s}" for n in RESOLUTIONS for s in "ab"])


def in_box(lat: Column, lon: Column, box: str | tuple[float, float, float, float, bool]) -> Column:
    """Whether a place lies in a box, its border included or not as the box says."""
    south, north, west, east, inclusive = BOXES[box] if isinstance(box, str) else box
    if inclusive:
        return lat.between(south, north) & lon.between(west, east)
    return (lat > south) & (lat < north) & (lon > west) & (lon < east)


def inside(lon: Column, lat: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a place lies inside a ring of (longitude, latitude) corners; one on its edge doesn't.

    The crossings of a ray towards the east are counted, edge by edge, in one expression.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    odd, edge = F.lit(False), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        a, b = F.lit(float(y1)), F.lit(float(y2))
        if y1 != y2:
            at = F.lit(float(x1)) + (lat - a) * F.lit((x2 - x1) / (y2 - y1))
            odd = odd != (((a > lat) != (b > lat)) & (lon < at))
        cross = (lat - a) * F.lit(float(x2 - x1)) == (lon - F.lit(float(x1))) * F.lit(float(y2 - y1))
        edge = edge | (cross & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
    return lat.between(min(ys), max(ys)) & lon.between(min(xs), max(xs)) & odd & ~edge


@dataclass(frozen=True)
class Stations:
    """A selection of stations; every method gives a narrower one."""

    df: DataFrame

    def _where(self, condition: Column) -> Stations:
        return Stations(self.df.where(condition))

    def in_states(self, states: Sequence[str]) -> Stations:
        return self._where(F.col("state").isin(*states))

    def of_ids(self, ids: DataFrame, key: str = "ncei_id") -> Stations:
        """Those whose key a table holds, however many it holds."""
        return Stations(self.df.join(ids.select(key).distinct(), key, "left_semi"))

    def with_prefix(self, column: str, prefixes: Sequence[str]) -> Stations:
        return self._where(reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes]))

    def with_data(self, resolutions: Sequence[str], first: int, last: int) -> Stations:
        """Those that have data of any of the resolutions in any of the years; without a resolution none."""
        each = [
            F.col(RESOLUTIONS[r][0]) & (F.col(f"{r}_start_year") <= last) & (F.col(f"{r}_end_year") >= first) for r in resolutions
        ]
        return self._where(reduce(lambda a, b: a | b, each, F.lit(False)))

    def in_box(self, box: str | tuple[float, float, float, float, bool]) -> Stations:
        return self._where(in_box(F.col("lat"), F.col("lon"), box))

    def within_km(self, lat: float, lon: float, radius: float) -> Stations:
        """Those at most radius km from a place; the latitude's band comes first."""
        near = great_circle_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
        return self._where(F.col("lat").between(lat - radius / 110.5, lat + radius / 110.5) & (near <= radius))

    def within_polygon(self, ring: Sequence[tuple[float, float]]) -> Stations:
        return self._where(inside(F.col("lon"), F.col("lat"), ring))

    def nearest(self, lat: float, lon: float, within_degrees: float = 0.01) -> Stations:
        """The one station nearest in degrees, if it's nearer than within_degrees; of equals the lowest id."""
        d = F.sqrt(F.pow(F.col("lat") - F.lit(lat), 2) + F.pow(F.col("lon") - F.lit(lon), 2))
        near = self.df.withColumn("_d", d).where(F.col("_d") < within_degrees)
        return Stations(near.orderBy("_d", "ncei_id").limit(1).drop("_d"))

    def size_gb(self, resolutions: Sequence[str]) -> DataFrame:
        """(stations, files, gb): what an extraction of the resolutions would have to read, by usual sizes of files."""
        part = lambda r: F.when(F.col(RESOLUTIONS[r][0]), F.col(RESOLUTIONS[r][4])).otherwise(0)
        files = reduce(lambda a, b: a + b, [part(r) for r in resolutions], F.lit(0))
        gb = reduce(lambda a, b: a + b, [part(r) * F.lit(RESOLUTIONS[r][5]) for r in resolutions], F.lit(0.0))
        return self.df.agg(F.count(F.lit(1)).alias("stations"), F.sum(files).cast("bigint").alias("files"), F.sum(gb).alias("gb"))

    def centre(self) -> DataFrame:
        """(lat, lon): the mean place."""
        return self.df.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))

    def thinned(self, n: int = 8000) -> DataFrame:
        """At most n stations, by a hash of their id: the same ones at every run. A sample for a map."""
        return self.df.orderBy(F.xxhash64("ncei_id"), "ncei_id").limit(n)

    def preview(self, n: int = 500) -> DataFrame:
        """The first n by state and name."""
        return self.df.orderBy(F.col("state").asc_nulls_last(), F.col("station_name").asc_nulls_last(), "ncei_id").limit(n)
