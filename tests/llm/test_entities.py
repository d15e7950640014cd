import __spark_entry__
import pytest
from stationweave import session
from stationweave.llm import entities

M = "ncei_id string, station_name string, state string, lat_dec double, lon_dec double, elev_m double, icao_ids string, wban_ids string, ghcnd_ids string"
H = "hist_id bigint, station_name string, st string, lat double, lon double, elev_m double, icao string, wban string"
NAN = float("nan")


@pytest.fixture(scope="module")
def lists(spark):
    master = [
        ("a", "MONAGATE COUNTY AIRPORT", "NY", 41.654, -72.565, 120.0, "{KAAA,KBBB}", "01001", None),
        ("b", "MONAGATE 2 N", "NY", 41.684, -72.566, 121.0, None, None, None),
        ("c", "SAINT ORWICK POWERHOUSE", "AK", 60.1, -158.2, 300.0, None, None, "USW00005561"),
        ("d", "PELERDALE DAM", "KS", NAN, NAN, 200.0, None, None, None),
        ("e", "HOLIMFORD 9 E", "KS", 37.6, -98.6, 400.0, None, None, None),
    ]
    history = [
        (1, "Cnty Arpt Monagate", "NY", 41.654, -72.565, 394.0, None, "99999"),  # words about, feet
        (2, "MONAGATE-2-N", None, 41.68, -72.57, 121.0, "", None),
        (3, "ST ORWIKC PWR HSE /AWOS", "AK", 60.1, 158.2, NAN, None, "5561"),  # slip, sign, lost zero
        (4, "PELERDALE DAM", "KS", 38.0, -98.0, 201.0, None, "99999"),  # the station has no place
        (5, "HOLIMFORD 9 E", "FL", 29.6, -77.5, 402.0, None, None),  # another station of that name
        (6, None, None, 41.654, -72.565, NAN, "KBBB", "01001"),
        (7, "MONAGATE CO AI", "NY", 41.65, -72.56, 120.0, None, None),  # a second entry of a
        (8, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(master, M), spark.createDataFrame(history, H)


def test_matches(lists):
    found = {(r.ncei_id, r.hist_id) for r in entities.match(*lists).collect()}
    assert found == {("a", 1), ("b", 2), ("c", 3), ("d", 4), ("a", 6), ("a", 7)}


def test_window_finds_what_all_pairs_find(spark):
    d = "/root/testdata/sf0.01"
    left = session.materialise(entities.stations(spark.read.parquet(f"{d}/master_station_list.parquet").dropDuplicates(["ncei_id"])))
    right = session.materialise(entities.entries(spark.read.parquet(f"{d}/isd_history.parquet")))
    pairs = left.selectExpr("ncei_id").crossJoin(right.selectExpr("cast(hist_id AS string) hist_id"))
    whole = {tuple(r)[:2] for r in entities.assign(entities.scored(left, right, pairs)).collect()}
    rows = __spark_entry__.queries()["p7_found"](spark, d).collect()
    assert whole == {tuple(r) for r in rows} and len(rows) == len({r.hist_id for r in rows}) > 100
