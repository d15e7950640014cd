import re
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from stationweave.functions.temporal import iso_epoch, with_epoch

CASES = [
    "2024-01-31T23:59:59", " 2024-02-29 00:00 ", "20240229T0105", "20240229T010507Z", "2024-02-29T01:05:07.123+05:30", "2024-02-29T01:05-0330", "2024-02-29t01:05z",
    "2024-02-29T01:05+05", "2024-02-30T00:00", "2023-13-01T00:00", "2024-01-01", "T12:53:00Z", "2024-01-01T24:00", "2024-01-01T24:01", "2024-01-01T23:60", "not-a-date", "", None,
    "0000-00-00T00:00:00", "2023-06-1", "2024-01-01T00:00:00,5", "20240101T000000,25-01:00",
]
FORM = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?(Z|[+-]\d{2}(?::?\d{2})?)?$")


def slow(text):
    """The same by the standard library."""
    if text is None:
        return None
    t = text.strip().upper()
    m = FORM.match(t)
    if not m or (t[4] == "-") != (":" in t[:16]) or (t[4] != "-" and t[8] != "T"):
        return None
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups()[:6])
    if mi > 59 or s > 59 or h * 3600 + mi * 60 + s > 86400:
        return None
    try:
        at = datetime(y, mo, d, tzinfo=timezone.utc) + timedelta(hours=h, minutes=mi, seconds=s)
    except ValueError:
        return None
    z = m.group(7)
    if z and z != "Z":
        digits = z[1:].replace(":", "").ljust(4, "0")
        at -= timedelta(minutes=int(digits[:2]) * 60 + int(digits[2:])) * (-1 if z[0] == "-" else 1)
    return int(at.timestamp())


def test_notations(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "d string").select("d", iso_epoch(F.col("d")).alias("t"))
    assert [(r.d, r.t) for r in df.collect()] == [(c, slow(c)) for c in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), st.sampled_from(["%Y-%m-%dT%H:%M:%S", "%Y%m%dT%H%M", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S"]), st.sampled_from(["", "Z", "+05:30", "-0800", "+03"])), min_size=60, max_size=60))
def test_any_instant(spark, made):
    texts = [d.strftime(f) + z for d, f, z in made]
    df = with_epoch(spark.createDataFrame([(c,) for c in texts], "d string"), "d", "t")
    assert [r.t for r in df.collect()] == [slow(c) for c in texts]


def test_the_parser_stands_once_in_a_plan(spark):
    df = with_epoch(spark.createDataFrame([("2024-01-01T00:00", 1)], "d string, t int"), "d", "t", only_valid=True)
    df = df.where("t > 5 AND t IS NOT NULL").select("t", (F.col("t") + 1).alias("u"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("regexp_replace") == 2
    assert [(r.t, r.u) for r in df.collect()] == [(1704067200, 1704067201)]
