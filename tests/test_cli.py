from stationweave import cli

SF = "/root/testdata/sf0.001"


def test_stations_and_extract(spark, tmp_path):
    cli.run(spark, ["stations", f"{SF}/master_station_list.parquet", f"{tmp_path}/s", "--resolution", "daily", "--years", "2000", "2024", "--near", "38", "-98", "3000"])
    assert spark.read.csv(f"{tmp_path}/s", header=True).count() > 0
    obs = spark.read.parquet(f"{SF}/obs_daily.parquet").withColumnRenamed("station", "station_id")
    obs.write.parquet(f"{tmp_path}/d")
    cli.run(spark, ["extract", f"{tmp_path}/d", f"{SF}/master_station_list.parquet", f"{tmp_path}/x", "--resolution", "daily", "--years", "2022", "2023"])
    tidy = spark.read.csv(f"{tmp_path}/x", header=True)
    assert "quality_flag" in tidy.columns and tidy.count() > 0


def test_inventory_profile_refresh(spark, tmp_path, capsys):
    cli.run(spark, ["inventory", SF, f"{tmp_path}/i", "--source", "test"])
    assert spark.read.parquet(f"{tmp_path}/i").where("is_data_file").count() > 10
    cli.run(spark, ["profile", f"{SF}/obs_1min.parquet", f"{tmp_path}/p", "--time-column", "timestamp_utc"])
    assert spark.read.parquet(f"{tmp_path}/p").first().total_rows > 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('STATION,DATE,REPORT_TYPE,TMP,DEW,AA1\nA,2024-02-03T04:05:00,FM-15,"+0022,1","-0011,1","01,0038,9,5"\n')
    args = ["refresh", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"]
    cli.run(spark, [*args, "--dry-run"])
    assert capsys.readouterr().out.strip().endswith("1")
    for _ in range(2):
        cli.run(spark, args)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 1
