import datetime as dt

from pyspark.sql import functions as F
from stationweave.functions import decode, files


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v")).alias("x")).collect()]


def test_hourly_fields(spark):
    t = one(spark, decode.isd_temperature, "+0022,1", "-0011,1", "+9999,9", "-9999,9", "garbage", None, "0100,C,x")
    assert [(r.value, r.qc) for r in t] == [(2.2, "1"), (-1.1, "1"), (None, "9"), (None, "9"), (None, ""), (None, ""), (10.0, "C")]
    p = one(spark, decode.isd_precipitation, "01,0038,9,5", "06,9999,9,9", "01,0010", " 1, 0010 ,9,5", "xx,0010,9,5", "", None)
    assert [(r.hours, r.mm, r.qc) for r in p] == [(1, 3.8, "5"), (6, None, "9"), (None, None, ""), (1, 1.0, "5"), (None, None, ""), (None, None, ""), (None, None, "")]


def test_states(spark):
    assert one(spark, decode.state_of, "USC00010008", "RQC00012345", "USC00990001", "USW00094728", "USC00", None) == ["AL", "PR", "99", "US", "US", None]


def test_years_and_places(spark):
    assert one(spark, lambda c: decode.leading_year(c, 2000), "2021-05", "x", None, "1999") == [2021, 2000, 2000, 1999]
    p = one(spark, decode.latitude_longitude, "41.5, -72.3", "41.5N 72.3W", "41.5° S, 72.3° E", "91, 0", "41.5", "", None, "+10;20")
    assert [x and (x.lat, x.lon) for x in p] == [(41.5, -72.3), (41.5, -72.3), (-41.5, 72.3), None, None, None, None, (10.0, 20.0)]


def test_local_time_to_utc(spark):
    df = spark.createDataFrame([("202401011930", "0030"), ("202401010030", "1930"), ("202401011200", "1700"), ("202413011200", "1700"), ("202401011200", "2500"), (None, "0000")], "l string, u string")
    got = [r[0] for r in df.select(decode.utc_of_local(F.col("l"), F.col("u"))).collect()]
    assert got == [dt.datetime(2024, 1, 2, 0, 30), dt.datetime(2023, 12, 31, 19, 30), dt.datetime(2024, 1, 1, 17, 0), None, None, None]


def test_texts(spark):
    assert one(spark, lambda c: decode.zfill(c, 3), "7", "1234", None) == ["007", "1234", None]
    assert one(spark, decode.blank_or, " A ", "nan", None) == ["A", "", ""]
    row = spark.range(1).select(decode.composed_minute(F.lit(2024), F.lit(3), F.lit(9), F.lit("45")).alias("x")).first()
    assert row.x == "2024-03-09 00:45"


NAMES = {
    "USC00010008.parquet": ("USC00010008", "GHCND_HPD", False, ".parquet", None),
    "64060KABE200002.parquet": ("0KABE", "ICAO_ASOS", False, ".parquet", "2000-02"),
    "asos-1min-pg2-KABE-202401.parquet": ("0KABE", "ICAO_ASOS", False, ".parquet", "2024-01"),
    "72509014733.parquet": ("725090", "USAF_WBAN", False, ".parquet", None),
    "A0001234567.parquet": ("A0001234567", "ASOS_A", False, ".parquet", None),
    "USW00094728.dly": ("USW00094728", "GHCND_DLY", False, ".dly", None),
    "US10box_005.parquet": ("US10box_005", "GHCND_DLY", False, ".parquet", None),
    "TX_raw_daily_PRCP.csv.gz": ("TX", "STATE_AGGREGATE", False, ".csv.gz", None),
    "TX_station_summary.csv": ("TX", "STATE_METADATA", False, ".csv", None),
    "1951.parquet": (None, None, False, ".parquet", "1951"),
    "stations_master.parquet": (None, None, False, ".parquet", None),
    "3260apr2011.dat.parquet": (None, None, False, ".dat.parquet", None),
    "readme_notes.txt": (None, None, True, ".txt", None),
    "noext": (None, None, True, "", None),
}


def test_file_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    s = files.station_of_file(F.col("n"))
    got = df.select("n", s["station_id_raw"], s["id_format"], s["failed"], files.extension(F.col("n")), files.date_part(F.col("n"))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == NAMES


def test_folder_under_the_root(spark):
    df = spark.createDataFrame([("/a/b/1min/x/f.dat",), ("/a/b/f.dat",)], "p string")
    assert [r[0] for r in df.select(files.subfolder(F.col("p"), "/a/b")).collect()] == ["1min", "root"]
