import pytest
from pyspark.sql import functions as F
from stationweave import session
from stationweave.operators import crosswalk, selection, tables, tidy


def state(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("station", "v", "year", "state").collect())


@pytest.fixture
def base(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2023, "01"), ("b", 2, 2023, "01"), ("a", 3, 2024, "01"), ("c", 4, 2024, None)], "station string, v int, year int, state string")
    path = f"{tmp_path}/t"
    tables.append_partitions(df, path)
    return df, path


def test_keyed_replace(spark, base):
    df, path = base
    new = spark.createDataFrame([("a", 10, 2023, "01"), ("a", 11, 2023, "01"), ("d", 12, 2025, "02"), ("c", 13, 2024, None)], df.schema)
    want = sorted([("a", 10, 2023, "01"), ("a", 11, 2023, "01"), ("b", 2, 2023, "01"), ("a", 3, 2024, "01"), ("d", 12, 2025, "02"), ("c", 13, 2024, None)], key=str)
    for _ in range(2):  # once more changes nothing
        tables.keyed_replace(new, path, ["year", "state"], "station")
        got = sorted((tuple(r) for r in spark.read.schema(df.schema).parquet(path).select(*df.columns).collect()), key=str)
        assert got == want
    tables.keyed_replace(new.limit(0), path, ["year", "state"], "station")
    assert spark.read.schema(df.schema).parquet(path).count() == len(want)


def test_keyed_replace_makes_the_table(spark, tmp_path):
    new = spark.createDataFrame([("a", 1, 2023)], "station string, v int, year int")
    tables.keyed_replace(new, f"{tmp_path}/new", ["year"], "station")
    assert spark.read.parquet(f"{tmp_path}/new").count() == 1


def test_insert_upsert_delete(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z"), (None, "n")], "k int, v string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(tables.insert_or_ignore(held, new, ["k"], [F.col("v")])) == sorted([(1, "a"), (2, "b"), (3, "y"), (None, "n")], key=str)
    assert rows(tables.upsert(held, new, ["k"], [F.col("v").desc()])) == sorted([(1, "a"), (2, "x"), (3, "z"), (None, "n")], key=str)
    groups = spark.createDataFrame([("s",), ("s|a",), ("st|a",), (None,)], "g string")
    assert rows(tables.without(groups, "g", "s")) == sorted([("st|a",), (None,)], key=str)


def test_publish_and_scratch(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    for n in (3, 5):
        held = tables.replace_table(spark.range(n), path)
        assert held.count() == n
    again = tables.replace_table(spark.read.parquet(path).where("id > 1"), path)
    assert again.count() == 3 and not (tmp_path / "t__old").exists() and not (tmp_path / "t__new").exists()
    folder = session.shared_dir(spark)
    assert spark.sparkContext.applicationId in folder


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    tables.write_csv(df, f"{tmp_path}/c", one_file=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert tables.csv_text(df.orderBy("k")).splitlines() == ["k,v", '1,"a,b"', "2,"]
    for _ in range(2):
        tables.append_csv(f"{tmp_path}/log.csv", ["k"], [[1]])
    assert (tmp_path / "log.csv").read_text().split() == ["k", "1", "1"]


def test_membership_takes_ids_whole(spark):
    m = spark.createDataFrame([("s1", "K_A|KAB"), ("s2", "KXA"), ("s3", None), ("s4", " K_A ||")], "ncei_id string, ids string")
    t = spark.createDataFrame([("K_A", 1), ("KAB", 2), ("K", 4)], "k string, n int")
    got = crosswalk.with_membership(m, "ncei_id", "ids", t, "k", [F.sum("n").alias("n")])
    assert {r.ncei_id: r.n for r in got.collect()} == {"s1": 3, "s2": None, "s3": None, "s4": 1}
    assert [r.k for r in crosswalk.without_member(t, "k", m, "ncei_id", "ids").collect()] == ["K"]


def test_nearest_within_tolerance(spark):
    a = spark.createDataFrame([("u1", 40.0, -90.0), ("u2", 41.0, -90.0), ("u3", None, -90.0), ("u4", 42.0, 179.999)], "id string, lat double, lon double")
    b = spark.createDataFrame([("m1", 40.004, -90.0), ("m2", 40.0, -89.996), ("m3", 41.02, -90.0), ("m4", 42.0, 179.995)], "ncei string, lat double, lon double")
    got = {r.id: r.ncei for r in crosswalk.nearest_within(a, "id", b, "ncei").collect()}
    assert got == {"u1": "m1", "u4": "m4"}  # equally near: the lowest id


def test_polygon_edge_is_outside(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 0.0), (0.0, 0.0), (3.0, 1.0), (2.0, 1.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in p.select(selection.inside(F.col("x"), F.col("y"), ring)).collect()] == [True, False, False, False, True, False, False]


def test_extract_without_ids_gives_nothing(spark):
    o = spark.createDataFrame([("KAAA", 2020)], "icao string, y int").selectExpr("icao", "make_timestamp_ntz(y, 1, 1, 0, 0, 0) AS timestamp_utc", "1.0D AS temp_f")
    ids = spark.createDataFrame([], "id string")
    assert tidy.extract(o, "1min", 2020, 2020, ids).count() == 0 and tidy.extract(o, "1min", 2020, 2020).count() == 1
    plan = tidy.extract(o, "1min", 2020, 2020)._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in plan
    with pytest.raises(ValueError):
        tidy.extract(o.drop("timestamp_utc"), "1min", 2020, 2020)


def test_tidy_quarter_and_hourly_precip(spark):
    meta = spark.createDataFrame([("S", "Table", "TX", 1.0, 2.0)], "station_id string, station_name string, state string, lat double, lon double")
    q = spark.createDataFrame([("S", None, None, 9.0, "QPCP", 2024, 1, 2, "15", 0.5, "nan", "ZZ"), ("T", "own", 5.0, 6.0, "QPCP", 2024, 1, 2, "2345", None, "", "ZZ")],
        "station_id string, station_name string, lat double, lon double, element string, year int, month int, day int, time string, precip_in double, flag_quality string, state string")
    rows = tidy.quarter(q, meta).collect()
    assert [(r.station_name, r.lat, r.lon, r.state, r.datetime, r.value, r.quality_flag) for r in rows] == [("Table", 1.0, 9.0, "ZZ", "2024-01-02 00:15", 12.7, "")]
    h = spark.createDataFrame([("S", "2024-01-01", "1.0"), ("S", "2024-01-02", "x")], "STATION string, DATE string, HlyPrcp string")
    assert [(r.variable, r.value) for r in tidy.hourly_precip(h, meta).collect()] == [("HlyPrcp", 25.4)]
    old = spark.createDataFrame([("S", "2024-01-01", "PRCP", 1.5, None)], "STATION string, DATE string, ELEMENT string, VALUE double, QFLAG string")
    assert [(r.variable, r.value, r.unit, r.quality_flag) for r in tidy.daily(old, meta).collect()] == [("PRCP", 1.5, "mm", "")]
