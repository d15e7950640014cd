import pytest
from pyspark.sql import functions as F
from stationweave.operators import multivalue
from stationweave.plans import problems

TEXTS = ["[N/A;KXYZ]", " {KABC, closed;KDEF} ", "N/A;KXYZ", "(K1A|old; site)", "K1A;;K2B", '"KABC, closed";K', "[N/A]", "A;B"]
KNOWN = ["KABC, closed", "old; site", "KXYZ"]


@pytest.mark.parametrize("most", [multivalue.MAX_BROADCAST_VALUES, 1])
def test_both_paths_see_the_same_boundaries(spark, monkeypatch, most):
    monkeypatch.setattr(multivalue, "MAX_BROADCAST_VALUES", most)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, f string")
    out = multivalue.split_fields(df, "k", ["f"], spark.createDataFrame([(v,) for v in KNOWN], "v string"))
    rows = sorted((r.k, r.pos, r.id_value) for r in out.collect())
    assert rows == [
        (0, 1, "N/A"), (0, 2, "KXYZ"), (1, 1, "KABC, closed"), (1, 2, "KDEF"), (2, 1, "N/A"), (2, 2, "KXYZ"),
        (3, 1, "K1A"), (3, 2, "old; site"), (4, 1, "K1A"), (4, 3, "K2B"), (5, 1, "KABC, closed"), (5, 2, "K"), (7, 1, "A"), (7, 2, "B"),
    ]


def test_known_values_with_delimiters_are_admitted(spark, tmp_path):
    one = lambda c, v: F.lit(v).cast("string").alias(c)
    row = spark.range(1)
    for name, columns in {
        "master_station_list": [one("ncei_id", "a"), one("wban_ids", "41994; old site;00001"), one("icao_ids", "KAAA;KBBB"), one("ghcnd_ids", None)],
        "isd_history": [one("wban", "41994; old site"), one("icao", None)],
        "station_coverage_geo": [one("station_id_raw", "KAAA")],
    }.items():
        row.select(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {(r.field_name, r.pos, r.id_value) for r in problems.p4_found(spark, str(tmp_path)).collect()}
    assert rows == {("wban_ids", 1, "41994; old site"), ("wban_ids", 2, "00001"), ("icao_ids", 1, "KAAA"), ("icao_ids", 2, "KBBB")}
