import datetime as dt
import io
import tarfile

from stationweave import schemas
from stationweave.sources import delimited, files, fixed


def text(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_station_list(spark):
    rows = fixed.station_list(text(spark, "USW00094728  40.7789  -73.9692   42.7 NY NY CITY CNTRL PARK            ", "CA001234567  45.0000  -75.0000  100.0 ON ELSEWHERE", "")).collect()
    assert [tuple(r) for r in rows] == [("USW00094728", 40.7789, -73.9692, 42.7, "NY", "NY CITY CNTRL PARK")]


def history_line(**v):
    line = [" "] * 540
    for n, a, b in fixed.HISTORY:
        for i, ch in enumerate(v.get(n, "")[: b - a]):
            line[a + i] = ch
    return "".join(line)


def test_station_history(spark, tmp_path):
    lines = [
        "HEADER LINE TO SKIP",
        history_line(ncei_id="20001", begin_date="00010101", end_date="99991231", station_name="PEÑA", country_code="US", state="TX", lat_dec="31.5", lon_dec="-97.1", icao_id="KAAA"),
        history_line(ncei_id="20001", begin_date="19500101", end_date="19601231", station_name="OLD", country_code="US", state="TX"),
        history_line(ncei_id="20002", end_date="99991231", station_name="ISLA", state="PR", lat_dec="18.0"),
        history_line(ncei_id="20003", station_name="ABROAD", country_code="CA", state="ON"),
    ]
    (tmp_path / "h.txt").write_bytes("\n".join(lines).encode("latin-1"))
    rows = fixed.station_history(fixed.lines(spark, str(tmp_path / "h.txt"), "ISO-8859-1", skip=1)).orderBy("ncei_id", "station_name").collect()
    assert [(r.ncei_id, r.station_name, r.begin_date, r.end_date, r.is_active, r.has_coordinates) for r in rows] == [
        ("20001", "OLD", dt.date(1950, 1, 1), dt.date(1960, 12, 31), False, False), ("20001", "PEÑA", None, dt.date(9999, 12, 31), True, True),
        ("20002", "ISLA", None, dt.date(9999, 12, 31), True, False),
    ]


def dly(station, ym, element, slots):
    return station + ym + element + "".join(slots.get(d, "-9999   ") for d in range(1, 32))


def test_daily_elements(spark):
    t = text(
        spark, dly("USW00094728", "202402", "TMAX", {1: "  106   ", 3: "-9999 I ", 30: "   50   "}), dly("USW00094728", "202402", "PRCP", {1: "   25T  "}),
        dly("USW00094728", "202402", "AWND", {1: "   11   "}), "too short", dly("USW00094728", "202402", "TMIN", {2: "  -33   "})[:29],
    )
    wide = fixed.daily_wide(t).orderBy("DATE").collect()
    assert [(r.DATE.day, r.PRCP, r.TMAX, r.TMIN) for r in wide] == [(1, 2.5, 10.6, None), (3, None, None, None)]
    long = {(r.date.day, r.element): (r.value, r.mflag, r.qflag) for r in fixed.daily_elements(t).collect()}
    assert long == {(1, "TMAX"): (106, "", ""), (3, "TMAX"): (None, "", "I"), (1, "PRCP"): (25, "T", "")}


def test_minute_lines(spark):
    rows = fixed.minute_lines(
        text(
            spark, "94728KNYC NYC2024010119300030 NP 0.01 39973 39955 29.90 29.90 41 33", "94728KNYC NYC2024010100301930 NP 0.02 M 39955 29.90 29.90 M 33",
            "94728KNYC NYC2024010112001700 NP x 0.05 a b c d 40 9999", "94728KNYC short", "",
        )
    ).orderBy("timestamp_utc").collect()
    assert [(r.wban, r.icao, r.timestamp_utc, r.precip_in, r.temp_f, r.dew_f) for r in rows] == [
        ("94728", "KNYC", dt.datetime(2023, 12, 31, 19, 30), 0.02, None, 33.0), ("94728", "KNYC", dt.datetime(2024, 1, 1, 17, 0), 0.05, 40.0, None),
        ("94728", "KNYC", dt.datetime(2024, 1, 2, 0, 30), 0.01, 41.0, 33.0),
    ]


def test_hourly_feed(spark, tmp_path):
    (tmp_path / "h.csv").write_text(
        'STATION,DATE,REPORT_TYPE,TMP,DEW,AA1\nA,2024-02-03T04:05:00,FM-15,"+0022,1","-0011,1","01,0038,9,5"\nA,2024-02-03T05:05:00,FM-15,"+9999,9","+9999,9",\n'
        'A,2024-02-03T06:05:00,,"+9999,9","+0100,1","06,9999,9,9"\nA,not-a-date,FM-15,"+0022,1","-0011,1",\nA,20240203T070500Z,FM-15,garbage,"+0005,1","01,0010"\n'
    )
    df = delimited.as_text(spark, str(tmp_path / "h.csv"))
    rows = delimited.hourly_feed(df).orderBy("hour").collect()
    got = [(r.hour, r.minute, r.year, r.month, r.day, r.report_type, r.precip_hours, r.precip_qc, r.temp_qc) for r in rows]
    assert got == [(4, 5, 2024, 2, 3, "FM-15", 1, "5", "1"), (6, 5, 2024, 2, 3, "", 6, "9", "9"), (7, 5, 2024, 2, 3, "FM-15", None, "", "")]
    assert [(round(r.temperature_c, 1) if r.temperature_c is not None else None, round(r.dewpoint_c, 1), r.precip_mm and round(r.precip_mm, 1)) for r in rows] == [(2.2, -1.1, 3.8), (None, 10.0, None), (None, 0.5, None)]
    assert delimited.hourly_feed(df).schema.fieldNames() == schemas.OBS_HOURLY.fieldNames()
    wide = delimited.hourly_wide(df).collect()
    assert wide[0].precip_1_depth_mm == 3.8 and wide[0].precip_4_depth_mm is None and wide[1].temperature_c is None
    assert delimited.subset(spark, str(tmp_path / "h.csv"), ["DEW", "NONE", "DATE"]).columns == ["DEW", "DATE"]


def test_quarter_feed(spark):
    head = {"STATION": "USC00010008", "NAME": "N", "LATITUDE": "31", "LONGITUDE": "-86", "ELEVATION": "x", "DATE": "2024-01-05"}
    rows = [
        {**head, "ELEMENT": "QPCP", "0000Val": "12", "0000MF": " ", "0000QF": "nan", "0015Val": "0", "0030Val": "-9999", "0045Val": "-5", "2345Val": "abc"},
        {**head, "ELEMENT": "HPCP", "0000Val": "12"}, {**head, "ELEMENT": "QGAG", "DATE": "bad", "0000Val": "12"}, {**head, "ELEMENT": "QGAG", "0000Val": "99999", "2345Val": "7", "2345QF": "Q"},
    ]
    columns = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    got = sorted((r.element, r.time, r.precip_in, r.flag_quality, r.state, r.elevation) for r in delimited.quarter_feed(df).collect())
    assert got == [("QGAG", "2345", 0.07, "Q", "AL", None), ("QPCP", "0000", 0.12, "", "AL", None), ("QPCP", "0015", 0.0, "", "AL", None)]


def test_history_file(spark, tmp_path):
    (tmp_path / "i.csv").write_text(
        "USAF,WBAN,STATION NAME,CTRY,STATE,ICAO,LAT,LON,ELEV(M),BEGIN,END\n725030,14732,A,US,NY,KLGA,40.8,-73.9,3,19730101,20240101\n725030,14732,B,US,NY,KLGA,40.8,-73.9,3,19730101,20250101\n"
        "999999,1,C,US,NY,,40,-73,3,1,2\n725040,123,D,US,NY,,80,-73,3,1,2\n1,23,E,US,TX,,31,-97,3,1,2\n725050,1,F,CA,ON,,45,-75,3,1,2\n"
    )
    rows = delimited.history_stations(delimited.as_text(spark, str(tmp_path / "i.csv"))).orderBy("station_id").collect()
    assert [(r.station_id, r.name) for r in rows] == [("00000100023", "E"), ("72503014732", "B")]


def test_listing(spark):
    html = '<a href="a.csv">a</a></td>\n<td align="right">2026-03-14 05:04</td><a href="b.csv">b</a>   15-Jan-2024 10:30\n<a href="a.csv">a</a> 16-Jan-2024 10:30 <a href="up/">up</a> 16-Jan-2024 10:30 <a href="?C=N">x</a> 16-Jan-2024 10:30'
    rows = files.listing(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).orderBy("name").collect()
    assert [(r.page_id, r.name, r.modified) for r in rows] == [(1, "a.csv", dt.datetime(2026, 3, 14, 5, 4)), (1, "b.csv", dt.datetime(2024, 1, 15, 10, 30))]


def test_archives_and_trees(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "1min").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".git" / "x.dat").write_text("no")
    (root / "1min" / "64060KABE200002.parquet").write_bytes(b"")
    with tarfile.open(root / "all.tar.gz", "w:gz") as tar:
        for name, body in {"d/USC1.csv": "a,b\n1,2\n", "d/other.txt": "no\n"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    lines = files.archive_members(spark, str(root / "all.tar.gz"), suffix=".csv", prefix="USC").collect()
    assert [(r.member, r.value) for r in lines] == [("d/USC1.csv", "a,b"), ("d/USC1.csv", "1,2")]
    found = files.catalogued(files.tree(spark, str(root)), "ASOS", f"file:{root}").orderBy("filename").collect()
    assert [(r.filename, r.subfolder, r.station_id_raw, r.is_data_file, r.anomaly_flag) for r in found] == [
        ("64060KABE200002.parquet", "1min", "0KABE", True, "empty_file"), ("all.tar.gz", "root", None, False, None),
    ]


def test_profiles_and_schemas(spark, tmp_path):
    spark.createDataFrame([("b", 1), ("a", 2)], "d string, x int").coalesce(1).write.parquet(f"{tmp_path}/p/one")
    spark.createDataFrame([("c", 1.5)], "d string, y double").coalesce(1).write.parquet(f"{tmp_path}/p/two")
    rows = files.profile(spark, f"{tmp_path}/p", "d").orderBy("total_rows").collect()
    assert [(r.total_rows, r.min_datetime, r.max_datetime, r.has_data) for r in rows] == [(1, "c", "c", True), (2, "a", "b", True)]
    both = files.union_by_name(spark, f"{tmp_path}/p/one", f"{tmp_path}/p/two")
    assert sorted(both.columns) == ["d", "x", "y"] and both.count() == 3
    assert [r.column_name for r in files.described(both).orderBy("position").collect()] == both.columns
    assert files.sample_schema(spark, f"{tmp_path}/p/one", ".parquet")["columns"] == ["d", "x"]
    assert files.sample_schema(spark, f"{tmp_path}/none", ".parquet")["note"]
    assert files.sample_schema(spark, "x", ".dat")["columns"] == ["raw_line"]


def test_state_files(tmp_path):
    p = str(tmp_path / "s.json")
    assert files.read_state(p) == {}
    files.write_state(p, {"a": 1})
    assert files.read_state(p) == {"a": 1} and not files.unchanged(str(tmp_path / "v"), "1")
    (tmp_path / "v").write_text("1\n")
    assert files.unchanged(str(tmp_path / "v"), "1")


def test_conform(spark):
    df = schemas.conform(spark.createDataFrame([("a", "x", 1)], "station string, prcp string, more int"), schemas.OBS_DAILY)
    assert df.columns == schemas.OBS_DAILY.fieldNames() and df.first().PRCP is None
    assert schemas.empty(spark, schemas.MASTER).count() == 0 and len(schemas.MASTER) == 38
