"""Command line: python -m stationweave.cli inventory|profile|stations|extract|refresh ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import session
from .operators import selection, tables, tidy
from .sources import delimited, files
from .streaming import refresh


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stationweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("inventory", help="catalogue of the files under a folder")
    c.add_argument("root"), c.add_argument("out"), c.add_argument("--source", required=True)
    c = sub.add_parser("profile", help="rows and dates of the Parquet files under a folder")
    c.add_argument("root"), c.add_argument("out"), c.add_argument("--time-column")
    c = sub.add_parser("stations", help="stations by state, years, place")
    c.add_argument("master"), c.add_argument("out"), c.add_argument("--state", action="append"), c.add_argument("--resolution", action="append", choices=list(selection.RESOLUTIONS))
    c.add_argument("--years", nargs=2, type=int, default=(1940, 2026)), c.add_argument("--near", nargs=3, type=float, metavar=("LAT", "LON", "KM"))
    c = sub.add_parser("extract", help="tidy observations of stations and years")
    c.add_argument("observations"), c.add_argument("master"), c.add_argument("out"), c.add_argument("--resolution", required=True, choices=list(tidy.NORMALISE))
    c.add_argument("--years", nargs=2, type=int, default=(1940, 2026)), c.add_argument("--state", action="append")
    c = sub.add_parser("refresh", help="work off new files of the hourly feed")
    c.add_argument("source"), c.add_argument("target"), c.add_argument("checkpoint"), c.add_argument("--dry-run", action="store_true")
    return p


def _stations(spark: SparkSession, path: str, a: argparse.Namespace) -> selection.Stations:
    s = selection.Stations(selection.load(spark.read.parquet(path), {}))
    return s.in_states(a.state) if a.state else s


def run(spark: SparkSession, argv: Sequence[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "inventory":
        tables.write_parquet(files.catalogued(files.tree(spark, a.root), a.source, a.root), a.out)
    elif a.command == "profile":
        tables.write_parquet(files.profile(spark, a.root, a.time_column), a.out)
    elif a.command == "stations":
        s = _stations(spark, a.master, a)
        if a.resolution:
            s = s.with_data(a.resolution, *a.years)
        if a.near:
            s = s.within_km(*a.near)
        tables.write_csv(s.df, a.out)
    elif a.command == "extract":
        s = _stations(spark, a.master, a).df
        o = tidy.Observations(spark.read.parquet(a.observations), a.resolution).for_stations(s).years(*a.years)
        tables.write_csv(o.tidy(tidy.station_meta(s, a.resolution)), a.out)
    elif a.dry_run:
        print(files.tree(spark, a.source, "*.csv").count())
    else:
        schema = "STATION string, DATE string, REPORT_TYPE string, TMP string, DEW string, AA1 string"
        parse = lambda df: delimited.hourly_feed(df).withColumn("state", F.lit("US"))
        refresh.refresh(spark, a.source, a.target, a.checkpoint, parse, ["year"], "station_id", format="csv", schema=schema, options={"header": "true"}).awaitTermination()


if __name__ == "__main__":
    import sys

    run(session.build(), sys.argv[1:])
