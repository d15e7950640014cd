from datetime import date, datetime

from pyspark.sql import functions as F
from stationweave.streaming import refresh


def test_marks_and_methods():
    state = refresh.recorded({}, "daily", date(2024, 5, 1), 3, 1)
    assert refresh.last_refresh(state, "daily") == date(2024, 5, 1) and refresh.last_refresh(state, "hpd") == date(2020, 1, 1)
    assert refresh.latest_refresh(refresh.recorded(state, "hpd", date(2024, 6, 1), 0, 0)) == date(2024, 6, 1) and refresh.latest_refresh({}) is None
    assert refresh.cutoff(date(2024, 5, 1), "daily") == datetime(2024, 4, 30, 23, 59, 59) and refresh.cutoff(date(2024, 5, 1), "hpd") == datetime(2024, 5, 1)
    assert refresh.method(date(2024, 1, 1), date(2024, 3, 1)) == "full" and refresh.method(date(2024, 1, 1), date(2024, 2, 1)) == "incremental"
    assert refresh.first_year(date(2024, 1, 1), "1min") == 2022


def test_due(spark):
    listing = spark.createDataFrame([("a", datetime(2024, 5, 1)), ("b", datetime(2024, 4, 1)), ("c", datetime(2024, 5, 2))], "name string, modified timestamp_ntz")
    done = listing.where("name = 'c'")
    names = lambda df: sorted(r.name for r in df.collect())
    cut = refresh.cutoff(date(2024, 5, 1), "daily")
    assert names(refresh.due(listing, done, cut)) == ["a"]
    assert names(refresh.due(listing, done, cut, force=True)) == ["a", "b", "c"]
    assert names(refresh.due(listing, done.limit(0), cut, must_exist=spark.createDataFrame([("c",)], "name string"))) == ["c"]
    assert refresh.dry_run(refresh.due(listing, done, cut)).first().files == 1


def test_files_once_and_redelivery(spark, tmp_path):
    drop, target, seen = tmp_path / "in", f"{tmp_path}/out", []
    drop.mkdir()

    def parse(batch):
        p = F.split("value", ",")
        return batch.select(F.get(p, F.lit(0)).alias("station"), F.get(p, F.lit(1)).cast("int").alias("year"), F.get(p, F.lit(2)).cast("double").alias("v"))

    def run():
        refresh.refresh(spark, str(drop), target, f"{tmp_path}/cp", parse, ["year"], "station", after=lambda rows, n: seen.append(rows.count())).awaitTermination()
        table = spark.read.schema("station string, v double, year int").parquet(target)
        return sorted(tuple(r) for r in table.select("station", "year", "v").collect())

    (drop / "1.txt").write_text("a,2023,1\nb,2023,2\na,2024,3\n")
    assert run() == [("a", 2023, 1.0), ("a", 2024, 3.0), ("b", 2023, 2.0)]
    (drop / "2.txt").write_text("a,2023,9\n")
    assert run() == [("a", 2023, 9.0), ("a", 2024, 3.0), ("b", 2023, 2.0)]
    (drop / "3.txt").write_text("a,2023,9\n")  # the same again, late
    assert run() == [("a", 2023, 9.0), ("a", 2024, 3.0), ("b", 2023, 2.0)]
    assert run() and seen == [3, 1, 1]
    changed = spark.createDataFrame([(2023,)], "year int")
    assert refresh.affected(spark.read.parquet(target), changed, ["year"]).count() == 2


def test_windows_of_a_stream(spark, tmp_path):
    data = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "u", 1.0) for m in (0, 10, 50, 59)], "ts timestamp_ntz, k string, value double")
    data.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/e")
    out = refresh.windowed(stream, "ts", ["k"], [F.count(F.lit(1)).alias("n")], "30 minutes", late="5 minutes")
    out.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("win").collect()) == [2, 2]
    batch = refresh.sessions(data, "ts", ["k"], [F.count(F.lit(1)).alias("n")], "15 minutes")
    assert sorted((r.window_start.minute, r.n) for r in batch.collect()) == [(0, 2), (50, 2)]
