"""The problems' operators on NULLs in any column, ties, repeated rows, empty tables and extra columns with the operators' own names."""

import math
import random

import pytest
from pyspark.sql import functions as F
from stationweave.operators import consolidate, harmonise, multivalue, proximity, regular_grid, spikes

NAN = float("nan")
OBS = "obs_id bigint, station_id string, date string, report_type string, temperature_c float, dewpoint_c float, precip_mm float, ingested_at timestamp"
TYPES = [("FM-15", True), ("SOD", False), (None, True)]


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame(TYPES, "report_type string, is_reading boolean")


def clash(df, *names):
    """df with further columns of the operators' own names."""
    return df.select("*", *[F.lit(7).alias(n) for n in names if n not in df.columns])


# ---------------------------------------------------------------- problem 1


def record(n=600, seed=1):
    """An honest record of a reading every 20 minutes, as (t, temp, dew, rain)."""
    r, temp, out = random.Random(seed), 10.0, []
    for i in range(n):
        temp += r.gauss(0, 0.25)
        out.append([1_700_000_000 + 1200 * i, round(temp, 1), round(temp - 4 + r.gauss(0, 0.2), 1), round(r.expovariate(0.5) + 0.1, 1) if r.random() < 0.1 else 0.0])
    return out


def readings(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, t bigint, temp double, dew double, rain double, slack double")


def test_spikes_runs_and_impossible_values(spark):
    a = record()
    a[100][1] += 15
    a[200][1] += 12
    a[201][1] += 12.5  # two in a row
    for i in range(300, 340):
        a[i][1] = 9.9  # stuck
    for i in range(420, 600):
        a[i][1] += 9.0  # a lasting change
        a[i][2] += 9.0
    a[50][3] = 300.0
    a[60][3], a[61][1] = -1.0, 99.0
    a[70][2] = a[70][1] + 3
    rows = [(i, "s", *x, 0.05) for i, x in enumerate(a)]
    rows += [(10_000, *rows[100][1:]), (10_001, None, *rows[100][2:]), (10_002, "s", None, 99.0, None, NAN, 0.05), (10_003, "one", 5, 1.0, 0.0, 0.0, 0.05)]
    df = clash(readings(spark, rows).withColumn("rain", F.nanvl("rain", F.lit(None))), "bucket", "measure", "kind", "own", "x")
    got = {}
    for r in spikes.bad_readings(df).collect():
        got.setdefault(r.field_name, set()).add(r.id)
    want = {100, 200, 201, 10_000, *range(300, 340), 61, 10_002}
    assert want <= got["temperature_c"] <= want | {299, 340} and got["precip_mm"] == {50, 60} and 70 in got["dewpoint_c"]
    assert not {i for i in got["temperature_c"] if 400 < i < 600}


def test_a_run_across_buckets_is_one_run(spark):
    a = record(4000, 3)  # 55 days: over a bucket's border
    border = next(i for i, x in enumerate(a) if x[0] // spikes.BUCKET_S != a[0][0] // spikes.BUCKET_S)
    for i in range(border - 9, border + 9):
        a[i][1] = 5.5
    found = {r.id for r in spikes.bad_readings(readings(spark, [(i, "s", *x, 0.05) for i, x in enumerate(a)])).where("field_name = 'temperature_c'").collect()}
    assert set(range(border - 9, border + 9)) <= found


def test_differing_values_of_an_instant_are_each_judged(spark):
    a = record()
    rows = [(i, "s", *x, 0.05) for i, x in enumerate(a)] + [(9000, "s", a[250][0], a[250][1] + 20, None, None, 0.05)]
    found = {r.id for r in spikes.bad_readings(readings(spark, rows)).collect()}
    assert 9000 in found and 250 not in found


def test_no_readings(spark):
    assert spikes.bad_readings(readings(spark, [])).count() == 0


def test_chunks_give_what_one_pass_gives(spark, monkeypatch):
    import pyarrow as pa

    rows = [(f"s{s}", b, True, t, s * 100_000 + b * 1000 + t, float(t % 7), None, None) for s in range(3) for b in range(3) for t in range(40)]
    table = pa.table(dict(zip(("source", "bucket", "own", "t", "id", "temp", "dew", "rain"), map(list, zip(*rows)))))
    table = table.set_column(6, "dew", pa.array([None] * len(rows), pa.float64())).set_column(7, "rain", pa.array([None] * len(rows), pa.float64()))

    def scan(chunk):
        monkeypatch.setattr(spikes, "CHUNK_ROWS", chunk)
        out = pa.Table.from_batches(list(spikes._scan(iter(table.to_batches(max_chunksize=25))))).to_pylist()
        total = {}
        for r in out:
            k = tuple(v for c, v in r.items() if c != "n") if r["kind"] == "hist" else tuple(r.values())
            total[k] = total.get(k, 0) + (r["n"] if r["kind"] == "hist" else 1)
        return total

    assert scan(30) == scan(10**9)


# ---------------------------------------------------------------- problem 2


def test_units_of_records(spark, types):
    """A station in °F, one that changes to tenths, an honest one; NULLs and an empty daily table."""
    r, rows, k = random.Random(4), [], 0
    for s, kind in (("F", "f"), ("C", "c"), ("X", "x")):
        for i in range(24 * 30):
            c = 15 + 8 * math.sin(i / 3.8) + r.gauss(0, 1)
            v = c * 1.8 + 32 if kind == "f" else c * 10 if kind == "x" and i >= 400 else c
            rows.append((k, s, f"2024-01-{1 + i // 24:02d}T{i % 24:02d}:00:00", "FM-15", float(round(v, 1)) if kind != "x" or i < 400 else float(round(v)), float(round(c - 3 + r.gauss(0, 0.5), 1)), None, None))
            k += 1
    rows += [(k, None, None, None, None, None, None, None), (k + 1, "F", "bad", "FM-15", 70.0, NAN, 0.0, None), (k + 1, "F", "bad", "FM-15", 70.0, NAN, 0.0, None)]
    obs = clash(spark.createDataFrame(rows, OBS), "kind", "t", "source", "day")
    daily = spark.createDataFrame([], "station string, date date, prcp double, tmax double, tmin double")
    said = spark.createDataFrame([], "source string, src string, channel string, unit_code string, t_from bigint, t_until bigint")
    minute = spark.createDataFrame([], "min_id bigint, wban string, timestamp_utc timestamp_ntz, temp_f double, precip_in double, dew_f double")
    reports = spark.createDataFrame([], "report_id bigint, station_id string, temp_text string, precip_text string")
    hourly = harmonise.hourly_rows(obs, types)
    stretches = harmonise.hourly_segments(hourly.where("reading"), daily, said)
    found = harmonise.foreign_values(hourly, stretches, minute, harmonise.minute_segments(minute, said), reports)
    units = {}
    for x in found.collect():
        units.setdefault(x.unit_code, []).append(x.row_id)
    assert set(units) == {"degF", "degC_tenths"} and len([i for i in units["degF"] if i < 720]) == 720
    assert abs(len(units["degC_tenths"]) - 320) <= 2


def test_observers_texts(spark):
    rows = [(1, "a", "71 °F", "0.5 in"), (2, "A ", "65", "trace"), (3, "a", None, ""), (4, "b", "12,5 C", "6 x 0.01 in"), (5, None, "288 K", "1 3/8 in"), (6, "c", "missing", "2 l/m2")]
    got = {(r.report_id, r.field_name): (round(r.value, 3), r.unit_code) for r in harmonise.read_texts(spark.createDataFrame(rows, "report_id bigint, station_id string, temp_text string, precip_text string")).collect()}
    assert got[1, "temp_text"] == (71, "degF") and got[2, "temp_text"] == (65, "degF") and got[4, "temp_text"] == (12.5, "degC")
    assert got[1, "precip_text"] == (0.5, "in") and got[4, "precip_text"][1] == "in_hundredths" and got[5, "precip_text"] == (1.375, "in") and got[6, "precip_text"] == (2, "mm")
    assert (3, "temp_text") not in got and (6, "temp_text") not in got and (2, "precip_text") not in got


# ---------------------------------------------------------------- problem 3


def test_records_in_any_notation(spark):
    rows = [
        (1, 1, " usw1 ", "2024-01-01T00:00:00", "TMAX", "1.50"), (1, 2, "USW1", "20240101T0000Z", "TMAX", " 1.5"), (0, 9, "USW1", "2024-01-01T01:00:00+01:00", "TMAX", "1.5"),
        (2, 1, "USW1", "2024-01-01T00:00:00", "TMAX", "1.6"), (3, 1, None, None, None, None), (4, 1, None, None, None, None), (5, 1, "USW1", "bad", "TMAX", "x"), (5, 1, "USW1", "bad", "TMAX", "x"),
        (6, 1, "USW1", "2024-01-01T00:00:00", "TMAX", "-0"), (7, 1, "USW1", "2024-01-01T00:00:00", "TMAX", "0.0"),
    ]
    df = clash(spark.createDataFrame(rows, "file_id bigint, rec_no int, station_id string, obs_time string, element string, value_text string"), "k_time", "r", "kept_file")
    c = consolidate.consolidate(df)
    assert sorted((r.file_id, r.rec_no) for r in c.kept.collect()) == [(0, 9), (2, 1), (3, 1), (5, 1), (6, 1)]
    assert sorted((r.file_id, r.rec_no) for r in c.repeats.collect()) == [(1, 1), (1, 2), (4, 1), (7, 1)]
    assert consolidate.consolidate(df.limit(0)).rows == 0


def test_checksum_sees_a_lost_and_a_doubled_row(spark):
    df = spark.range(50).select("id", F.lit(None).cast("string").alias("n"))
    assert consolidate.multiset_checksum(df) == consolidate.multiset_checksum(df.repartition(7))
    assert len({consolidate.multiset_checksum(x) for x in (df, df.where("id > 0"), df.union(df.limit(1)))}) == 3


# ---------------------------------------------------------------- problem 4


def places(text):
    return [(i, v) for i, v in enumerate(multivalue.segment(text), 1) if v is not None]


@pytest.mark.parametrize("text, want", [
    ("A|B", [(1, "A"), (2, "B")]), (" [A; B ,C] ", [(1, "A"), (2, "B"), (3, "C")]), ("A||B|", [(1, "A"), (3, "B")]), ("A and B", [(1, "A"), (2, "B")]),
    ('"A, x";B', [(1, "A, x"), (2, "B")]), ("A B  C", [(1, "A"), (2, "B"), (3, "C")]), ("A|A", [(1, "A"), (2, "A")]), ("", []), (None, []), ("  ", []), ("|;,", []), ("A、B", [(1, "A"), (2, "B")]),
])
def test_places_of_a_field(text, want):
    assert places(text) == want


def test_long_fields_and_joined_values():
    values = [f"K{i:04d}" for i in range(3000)]
    for d in ("|", " ; ", "\t", "，"):
        assert [v for _, v in places(d.join(values))] == values


def test_fields_of_a_table(spark):
    df = clash(spark.createDataFrame([("a", "X|Y", None), ("a", "X|Y", None), ("b", "X", ""), (None, "P;Q", "R")], "k string, f string, g string"), "key", "field_name", "text", "x")
    rows = sorted((str(r.k), r.field_name, r.pos, r.id_value) for r in multivalue.split_fields(df, "k", ["f", "g"], spark.createDataFrame([(None,)], "v string")).collect())
    assert rows == [("None", "f", 1, "P"), ("None", "f", 2, "Q"), *[("a", "f", 1, "X")] * 2, *[("a", "f", 2, "Y")] * 2]


# ---------------------------------------------------------------- problem 5


def slow_grid(rows, hold=7200):
    """Cells of a station by plain loops: (n_readings, coverage, mean temperature)."""
    steps = {}
    for t, v in rows:
        steps.setdefault(t, []).append(v)
    ts, cells = sorted(steps), {}
    for i, t in enumerate(ts):
        end = min(ts[i + 1] if i + 1 < len(ts) else t + hold, t + hold)
        v = [x for x in steps[t] if x is not None]
        for c in range(t // 3600, (end - 1) // 3600 + 1):
            n, cov, sv, sw = cells.get(c, (0, 0, 0.0, 0))
            w = min(end, c * 3600 + 3600) - max(t, c * 3600)
            cells[c] = (n + (t // 3600 == c), cov + w, sv + (sum(v) / len(v) * w if v else 0), sw + (w if v else 0))
    return cells


def test_grid_by_brute_force(spark, types):
    r = random.Random(8)
    at = sorted(r.randrange(0, 40 * 86400) for _ in range(400))
    rows = [(1_700_000_000 + t, r.choice([None, float(r.randrange(100))])) for t in at]
    obs = [(i, "s", None, "FM-15", v, 1.0, None, None) for i, (t, v) in enumerate(rows)]
    df = spark.createDataFrame([(*o[:2], t, *o[3:]) for o, (t, _) in zip(obs, rows)], OBS.replace("date string", "t0 bigint"))
    df = df.withColumn("date", F.date_format(F.timestamp_seconds("t0"), "yyyy-MM-dd'T'HH:mm:ss")).drop("t0")
    more = spark.createDataFrame([(9, "s", "2023-11-20T00:00:00", "SOD", 1.0, 1.0, 1.0, None), (9, None, "2023-11-20T00:00:00", "FM-15", 1.0, 1.0, 1.0, None), (9, "s", "2023-11-20T00:00:00", "fm-15 ", NAN, None, None, None), (9, "s", None, "FM-15", 1.0, None, None, None)], OBS)
    got = {x.cell: x for x in regular_grid.regular_grid(clash(df.unionByName(more), "cell", "t", "bucket", "year", "own"), types).collect()}
    want = slow_grid(rows)
    assert set(got) == set(range(min(got), max(got) + 1)) and min(got) == rows[0][0] // 3600
    for c, x in got.items():
        n, cov, sv, sw = want.get(c, (0, 0, 0, 0))
        assert x.n_readings == n and abs(x.coverage - cov / 3600) < 1e-9 and x.status == ("observed" if n else "held" if cov else "missing")
        assert (x.temperature_c is None) == (sw == 0) and (sw == 0 or abs(x.temperature_c - sv / sw) < 1e-6)


def test_grid_of_nothing(spark, types):
    assert regular_grid.regular_grid(spark.createDataFrame([], OBS), types).count() == 0


# ---------------------------------------------------------------- problem 6


def km(a, b, c, d):
    p, q, s, t = map(math.radians, (a, b, c, d))
    h = math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(max(h, 0.0), 1.0)))


@pytest.mark.parametrize("radius", [2.0, 300.0])
def test_distances_by_brute_force(spark, radius):
    r = random.Random(2)
    spots = [(0.0, 179.99), (0.0, -179.99), (89.99, 10.0), (89.99, -170.0), (-60.0, 0.0), (45.0, 7.0)]
    near = lambda: (lambda p: (max(-90.0, min(90.0, p[0] + r.gauss(0, 0.02))), (p[1] + r.gauss(0, 0.02) + 540) % 360 - 180))(r.choice(spots))
    a = [(f"a{i}", *near()) for i in range(60)] + [("x", None, 1.0), ("y", NAN, 1.0), ("z", 0.0, 0.0), ("w", 95.0, 1.0), ("a0", *near())]
    b = [(i, *near()) for i in range(150)] + [(900, 1.0, None), (901, 0.0, 0.0), (902, 10.0, 181.0)]
    da = clash(spark.createDataFrame(a, "ncei_id string, lat_dec double, lon_dec double"), "x", "y", "_cell", "_strip", "ring")
    db = clash(spark.createDataFrame(b, "cov_id bigint, lat double, lon double"), "clat", "x1", "_level")
    got = proximity.within_distance(da, "ncei_id", "lat_dec", "lon_dec", db, "cov_id", "lat", "lon", radius)
    ok = lambda p: p[1] is not None and p[2] is not None and p[1] == p[1] and abs(p[1]) <= 90 and abs(p[2]) <= 180 and (p[1], p[2]) != (0.0, 0.0)
    want = {(p[0], q[0]) for p in a for q in b if ok(p) and ok(q) and km(p[1], p[2], q[1], q[2]) <= radius}
    assert {(x.ncei_id, x.cov_id) for x in got.collect()} == want and want


def crossings(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def test_regions_of_all_sizes(spark):
    r = random.Random(6)
    star = lambda cx, cy, size, n: [(cx + size * (0.4 + 0.6 * r.random()) * math.cos(2 * math.pi * k / n), cy + size * (0.4 + 0.6 * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = {"tiny": star(10, 10, 0.02, 9), "town": star(10.1, 10, 0.3, 40), "country": star(12, 14, 8, 60), "wide": star(0, 20, 60, 12), "line": [(1.0, 1.0), (2.0, 2.0)], "none": None,
             "square": [(10.0, 10.0), (10.0, 11.0), (11.0, 11.0), (11.0, 10.0)], "over": [(179.0, 5.0), (181.0, 5.0), (181.0, 7.0), (179.0, 7.0)]}
    regions = spark.createDataFrame([(n, None if ring is None else [{"x": float(x), "y": float(y)} for x, y in ring]) for n, ring in rings.items()], "name string, ring array<struct<x:double,y:double>>")
    points = [(i, r.gauss(10, s), r.gauss(10, s)) for i, s in enumerate([0.02] * 100 + [0.3] * 100 + [8] * 150 + [30] * 50)]
    points += [(900, 10.0, 10.5), (901, 11.0, 11.0), (902, -179.5, 6.0), (903, 179.5, 6.0), (0, *points[0][1:])]
    points = [(i, max(-180.0, min(180.0, x)), max(-90.0, min(90.0, y))) for i, x, y in points]
    got = {(p.name, p.id) for p in proximity.points_in_regions(spark.createDataFrame(points, "id bigint, x double, y double"), regions).collect()}
    want = {(n, i) for n, ring in rings.items() if ring and len(ring) > 2 for i, x, y in points if crossings(x, y, ring) or (n == "over" and crossings(x + 360, y, ring))}
    assert got == want and {n for n, _ in want} >= {"tiny", "town", "country", "wide", "square", "over"}
