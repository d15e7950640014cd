"""Instants out of text, as whole epoch seconds that depend on no time zone setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date and time of day, extended or basic, optional seconds, fraction and offset. Blanks around it are cut first.
ISO_INSTANT = (
    r"^(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{8}T\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?$"
)


def _bare(text: Column) -> Column:
    return F.upper(F.trim(text))


def _extended(t: Column) -> Column:
    """The extended form of a text in basic form; any other stays."""
    basic = F.regexp_replace(
        F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})", "$1-$2-$3T$4:$5"), r"^(.{16})(\d{2})", "$1:$2"
    )
    return F.when(F.substring(t, 5, 1) == "-", t).otherwise(basic)


def _epoch(t: Column, x: Column) -> Column:
    """Epoch seconds of a bare text t, with its extended form x."""
    two = lambda c, at: F.substring(c, at, 2).try_cast("int")
    h, m = two(x, 12), two(x, 15)
    s = F.when(F.substring(x, 17, 1) == ":", two(x, 18)).otherwise(0)
    # in a text of the right form a sign so near the end belongs to the offset
    sign = lambda n: F.substring(t, -n, 1).isin("+", "-")
    ahead = lambda n: F.when(F.substring(t, -n, 1) == "-", -60).otherwise(60)
    shift = (
        F.when(t.endswith("Z"), 0)
        .when(sign(6), ahead(6) * (two(t, -5) * 60 + two(t, -2)))
        .when(sign(5), ahead(5) * (two(t, -4) * 60 + two(t, -2)))
        .when(sign(3), ahead(3) * two(t, -2) * 60)
        .otherwise(0)
    )
    of_day = h * 3600 + m * 60 + s
    ok = t.rlike(ISO_INSTANT) & (m < 60) & (s < 60) & (of_day <= 86400)
    day = F.substring(x, 1, 10).try_cast("date")
    return F.when(ok, F.unix_date(day).cast("bigint") * 86400 + of_day - shift)


def iso_epoch(text: Column) -> Column:
    """Epoch seconds (bigint) of an ISO 8601 date with time of day; UTC unless it has an offset.

    NULL for anything else: a bare date, a bare time, words, a day or hour that
    doesn't exist. 24:00 is the start of the next day. Fractions are cut.

    One regular expression decides whether the text has the form; the parts are
    then cut out by position. That is several times cheaper than a cast to
    timestamp and uses no time zone setting. Over many rows with_epoch is cheaper.
    """
    t = _bare(text)
    return _epoch(t, _extended(t))


def with_epoch(df: DataFrame, text: str, name: str = "t", only_valid: bool = False) -> DataFrame:
    """df with iso_epoch of a text column, worked out once per row; only_valid leaves out rows where it's NULL.

    As a plain column the whole expression would be copied into every filter and
    key that uses it, and its inner parts into each other. Steps that are used
    more than once stay projections of their own, and a generator over one value
    is a border that no filter crosses.
    """
    held = [c for c in df.columns if c != name]
    df = df.withColumn("_bare", _bare(F.col(text)))
    df = df.withColumn("_extended", _extended(F.col("_bare")))
    one = F.array(_epoch(F.col("_bare"), F.col("_extended")))
    return df.select(*held, F.explode(F.array_compact(one) if only_valid else one).alias(name))


def epoch_text(seconds: Column, pattern: str = "yyyy-MM-dd HH:00") -> Column:
    """UTC text of epoch seconds for the few patterns used here, without the session's zone."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    within = F.pmod(seconds, F.lit(86400))
    hour = F.lpad((F.floor(within / 3600)).cast("string"), 2, "0")
    minute = F.lpad((F.floor(within % 3600 / 60)).cast("string"), 2, "0")
    if pattern == "yyyy-MM-dd HH:00":
        return F.concat(day, F.lit(" "), hour, F.lit(":00"))
    if pattern == "yyyy-MM-dd HH:mm":
        return F.concat(day, F.lit(" "), hour, F.lit(":"), minute)
    raise ValueError(f"no such pattern: {pattern}")


def epoch_of(ts: Column) -> Column:
    """Epoch seconds of a timestamp_ntz column that holds UTC."""
    return F.unix_date(ts.cast("date")).cast("bigint") * 86400 + (
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )


def epoch_year(seconds: Column) -> Column:
    """UTC calendar year of epoch seconds."""
    return F.year(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")))
