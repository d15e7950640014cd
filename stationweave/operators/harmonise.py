"""Quantities recorded in different units, brought to °C and mm.

Where a unit stands in the text it is read by the trie segmentation of
functions.unit_text: observers' texts and remarks on instruments. Where values
come bare, each source's record is decided as a sequence: per source and day,
sums of the evidence for each unit are aggregated in the JVM (spread above the
dew point, magnitude and rounding of precipitation, agreement with daily totals);
dynamic programming over the days finds the cheapest sequence of units, with
remarks as priors; and the readings of the days around a change place it exactly.

Only sums per source and day, and the readings of the days around a change, ever
reach Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import epoch_of, with_epoch
from ..functions.unit_text import PRECIPITATION, TEMPERATURE, measured, unit_of
from ..functions.units import TO_DEG_C, TO_MM, convert, to_common
from ..session import materialise

DAY = 86400
FOREVER = 1 << 40
#: Cost of a change of unit, and of a record that doesn't begin in the field's own unit.
CHANGE, FOREIGN = 16.0, 4.0
#: A day's temperatures count as at most so many readings: they share the faults of one dew point sensor.
DAY_READINGS = 8
#: What a remark that names a unit adds to each of its days, and to each reading near a change.
REMARK_DAY, REMARK_ROW = 6.0, 4.0
#: Days on either side of a change within which its exact place is sought.
AROUND = 2
#: Fixed values of the evidence: usual spread of temperature above dew point in °C and its width; median of a wet reading in mm and the width of its logarithm.
SPREAD, SPREAD_WIDTH = 3.0, 2.5
WET_LOG, WET_WIDTH = math.log(2.2), 1.3

TEMP_UNITS, PRECIP_UNITS = tuple(TO_DEG_C), tuple(TO_MM)

SEGMENTS = "src string, source string, channel string, unit_code string, t_from bigint, t_until bigint"


def temperature_evidence(value: Column, dew_c: Column, unit: str) -> Column:
    """Log-likelihood (about) of a temperature under a unit, given the dew point in °C; 0 without a dew point."""
    s = to_common(value, unit) - dew_c
    fit = -F.abs(s - SPREAD) / SPREAD_WIDTH - F.when(s < -0.6, F.lit(4.0)).otherwise(0.0)
    fit = F.greatest(fit, F.lit(-6.0))
    if unit.endswith("_tenths"):  # counts of tenths are whole numbers
        fit = fit - F.when(F.abs(value - F.round(value)) > 0.01, F.lit(5.0)).otherwise(0.0)
    return F.when(dew_c.isNotNull() & value.isNotNull(), fit).otherwise(0.0)


#: Numbers per unit that a recorded value is a whole multiple of, and that step in mm.
_STEPS = {"mm": (10.0, 0.1), "mm_tenths": (1.0, 0.1), "cm": (100.0, 0.1), "in": (100.0, 0.254), "in_hundredths": (1.0, 0.254)}
#: One-minute gauges tip at a hundredth of an inch; other units are roundings of that.
_TIPS = {"mm": 0.254, "mm_tenths": 2.54, "cm": 0.0254, "in": 0.01, "in_hundredths": 1.0}


def precipitation_evidence(value: Column, unit: str, centre: float = WET_LOG, width: float = WET_WIDTH) -> Column:
    """Log-probability (about) of a wet reading under a unit; 0 for a dry or missing one."""
    per, step_mm = _STEPS[unit]
    factor = TO_MM[unit][0]
    mm = F.ln(value) + math.log(factor)
    fit = -0.5 * F.pow((mm - centre) / width, F.lit(2.0)) - mm + math.log(step_mm)
    off = F.abs(value * per - F.round(value * per)) > F.lit(0.02)
    fit = fit - F.when(off, F.lit(5.0)).otherwise(0.0)
    return F.when(value > 0, F.greatest(fit, F.lit(-12.0))).otherwise(0.0)


def tip_evidence(value: Column, unit: str) -> Column:
    """Log-probability (about) of a one-minute gauge reading under a unit: a small whole number of tips, rounded."""
    tips = value / _TIPS[unit]
    # a value in a unit coarser than the tip is rounded to two decimals
    slack = max(0.02, 0.006 / _TIPS[unit])
    off = F.abs(tips - F.round(tips)) > F.lit(slack)
    fit = -F.abs(F.ln(F.greatest(tips, F.lit(0.01)) / 1.6)) * 1.5 - F.when(off, F.lit(4.0)).otherwise(0.0) - slack
    return F.when(value > 0, F.greatest(fit, F.lit(-8.0))).otherwise(0.0)


# ---------------------------------------------------------------- remarks

_IGNORED = re.compile(r"no change|doesn't|does not|display|paper|asked|checked|visitor", re.I)
_TEMP_WORD = re.compile(r"\b(temp|tmp|temperature|thermometer|air)\b", re.I)
_RAIN_WORD = re.compile(r"\b(precip|precipitation|gauge|rain|aa1)\b", re.I)
_MINUTE = re.compile(r"\b(1-min|one-minute|1 min)\b", re.I)
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d)?Z?")
_CHANNEL_WORDS = re.compile(
    r"1-min|one-minute|\bfeed\b|of this site|\btmp channel\b|air temperature|temperature|thermometer|\btemp\b|\baa1 depth\b"
    r"|rain gauge|\bgauge\b|\bprecip\b|\bchannel\b|new logger|\bsite sends\b|values of the|\bnow\b|\bthroughout\b|never changed|\bwas\b"
    r"|\bkept\b|\bbefore\b|\bbetween\b|corrected since|then set back|\bfrom\b|\buntil\b|\bon\b|\bare\b|\band\b",
    re.I,
)


def remark(text: str | None) -> tuple[str, str, str, int, int] | None:
    """(src, channel, unit code, from, until) that a remark on an instrument states, or None.

    Times are epoch seconds; a remark without times holds throughout. Remarks
    that deny a change, or speak of a display or a form, state nothing.
    """
    if not text or _IGNORED.search(text):
        return None
    minute = bool(_MINUTE.search(text))
    rain, temp = _RAIN_WORD.search(text), _TEMP_WORD.search(text)
    if bool(rain) == bool(temp):
        return None
    dimension = PRECIPITATION if rain else TEMPERATURE
    stamps = [int(pd.Timestamp(s.rstrip("Z"), tz="UTC").timestamp()) for s in _STAMP.findall(text)]
    words = _CHANNEL_WORDS.sub(" , ", _STAMP.sub(" , ", text))
    code = unit_of(words, dimension)
    if code is None:
        return None
    a, b = 0, FOREVER
    low = text.lower()
    if len(stamps) >= 2:
        a, b = stamps[0], stamps[1]
    elif len(stamps) == 1:
        if re.search(r"\b(before|until)\b", low):
            b = stamps[0]
        else:
            a = stamps[0]
    return "obs_1min" if minute else "obs_hourly", dimension, code, a, b


def remarks(notes: DataFrame) -> DataFrame:
    """(source, src, channel, unit_code, t_from, t_until) of the remarks that state a unit; source is the station id, for one-minute sites its last five characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for station, text in zip(b["station_id"], b["note_text"]):
                if station and (r := remark(text)):
                    rows.append((station.strip().upper()[-5:] if r[0] == "obs_1min" else station.strip().upper(), *r))
            yield pd.DataFrame(rows, columns=["source", "src", "channel", "unit_code", "t_from", "t_until"])

    return notes.select("station_id", "note_text").mapInPandas(
        run, "source string, src string, channel string, unit_code string, t_from bigint, t_until bigint"
    )


# ---------------------------------------------------------------- sequences of units


def best_sequence(evidence: np.ndarray, own: int) -> np.ndarray:
    """Index of the unit of each day: the path of greatest evidence less the cost of its changes.

    evidence: days x units. own: the field's unit, which wins ties.
    """
    n, k = evidence.shape
    start = np.full(k, -FOREIGN)
    start[own] = 0.0
    score = evidence[0] + start
    back = np.zeros((n, k), dtype=np.int32)
    for i in range(1, n):
        top = int(np.argmax(score + 1e-9 * (np.arange(k) == own)))
        stay = score >= score[top] - CHANGE
        back[i] = np.where(stay, np.arange(k), top)
        score = np.where(stay, score, score[top] - CHANGE) + evidence[i]
    path = np.empty(n, dtype=np.int32)
    path[-1] = int(np.argmax(score + 1e-9 * (np.arange(k) == own)))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _triples(said) -> list[tuple[str, int, int]]:
    return [] if said is None else [(x["unit_code"], int(x["t_from"]), int(x["t_until"])) for x in said]


def _day_segments(units: tuple[str, ...], own: int):
    """Function over one source's days: its runs of equal unit, as rows of (.., unit, first day, day after)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day", kind="stable")
        e = pdf[[f"l_{u}" for u in units]].to_numpy(dtype=float)
        days = pdf["day"].to_numpy()
        for u, a, b in _triples(pdf["said"].iloc[0]):
            if u in units:
                whole = (days * DAY >= a) & ((days + 1) * DAY <= b)
                e[whole, units.index(u)] += REMARK_DAY
        path = best_sequence(e, own)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
        # the cut between two days lies somewhere from the last day before to the first after
        return pd.DataFrame(
            {
                "src": pdf["src"].iloc[0],
                "source": pdf["source"].iloc[0],
                "channel": pdf["channel"].iloc[0],
                "unit_code": [units[path[a]] for a in cuts[:-1]],
                "day_from": [-(FOREVER // DAY) if a == 0 else int(days[a]) for a in cuts[:-1]],
                "day_until": [FOREVER // DAY if b == len(path) else int(days[b]) for b in cuts[1:]],
                "next_unit": [units[path[b]] if b < len(path) else None for b in cuts[1:]],
                "last_day": [int(days[b - 1]) for b in cuts[1:]],
            }
        )

    return run


_DAY_SEGMENTS = (
    "src string, source string, channel string, unit_code string, day_from bigint, day_until bigint, "
    "next_unit string, last_day bigint"
)


def _with_said(days: DataFrame, said: DataFrame) -> DataFrame:
    """Each source's first-listed remarks beside its days, as an array of (unit, from, until)."""
    list_of = said.distinct().groupBy("src", "source", "channel").agg(
        F.collect_list(F.struct("unit_code", "t_from", "t_until")).alias("said")
    )
    return days.join(list_of, ["src", "source", "channel"], "left")


def _place_cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where, among the readings around a change, the old unit ends: the cut of greatest evidence."""
    pdf = pdf.sort_values(["t", "id"], kind="stable")
    r = pdf.iloc[0]
    t, old, new = pdf["t"].to_numpy(), pdf["e_old"].to_numpy(dtype=float), pdf["e_new"].to_numpy(dtype=float)
    for u, a, b in _triples(r["said"]):
        held = (t >= a) & (t < b)
        if u == r["unit_code"]:
            old, new = old + REMARK_ROW * held, new + REMARK_ROW * ~held
        elif u == r["next_unit"]:
            new, old = new + REMARK_ROW * held, old + REMARK_ROW * ~held
    gain = np.concatenate([[0.0], np.cumsum(old - new)])
    k = int(np.argmax(gain))
    cut = int(t[k]) if k < len(t) else int(t[-1]) + 1
    return pd.DataFrame(
        {"src": [r["src"]], "source": [r["source"]], "channel": [r["channel"]], "day_until": [r["day_until"]], "cut": [cut]}
    )


def _segments(
    days: DataFrame, rows: DataFrame, said: DataFrame, units: tuple[str, ...], own: str, evidence
) -> DataFrame:
    """Segments of one channel: which unit each source used from when until when."""
    spans = materialise(
        _with_said(days, said)
        .groupBy("src", "source", "channel")
        .applyInPandas(_day_segments(units, units.index(own)), _DAY_SEGMENTS)
    )
    changes = spans.where("next_unit IS NOT NULL").select(
        "src", "source", "channel", "unit_code", "next_unit", "day_until", "last_day"
    )
    # a change meets the readings of its own days only
    days_near = F.explode(F.sequence(F.col("last_day") - AROUND, F.col("day_until") + AROUND)).alias("day")
    changes = _with_said(changes, said).select("*", days_near)
    near = rows.withColumn("day", F.floor(F.col("t") / DAY)).join(changes, ["source", "day"])
    score = lambda unit: sum(
        (F.when(unit == u, evidence(u)).otherwise(0.0) for u in units), F.lit(0.0)
    )
    placed = (
        near.select(
            "src", "source", "channel", "unit_code", "next_unit", "day_until", "said", "t", "id",
            score(F.col("unit_code")).alias("e_old"), score(F.col("next_unit")).alias("e_new"),
        )
        .groupBy("src", "source", "channel", "day_until")
        .applyInPandas(_place_cut, "src string, source string, channel string, day_until bigint, cut bigint")
    )
    ends = placed.select("src", "source", "channel", "day_until", F.col("cut").alias("t_until"))
    starts = placed.select("src", "source", "channel", F.col("day_until").alias("day_from"), F.col("cut").alias("t_from"))
    return (
        spans.join(ends, ["src", "source", "channel", "day_until"], "left")
        .join(starts, ["src", "source", "channel", "day_from"], "left")
        .where(F.col("unit_code") != own)
        .select(
            "src",
            "source",
            "channel",
            "unit_code",
            F.coalesce("t_from", F.when(F.col("day_from") < 0, -FOREVER).otherwise(F.col("day_from") * DAY)).alias("t_from"),
            F.coalesce("t_until", F.when(F.col("day_until") >= FOREVER // DAY, FOREVER).otherwise(F.col("day_until") * DAY)).alias("t_until"),
        )
    )


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _capped(unit: str) -> Column:
    return F.col(f"t_{unit}") * F.least(F.lit(1.0), F.lit(float(DAY_READINGS)) / F.col("n_temp"))


def _kinds(report_types: DataFrame) -> DataFrame:
    """The types that are readings, in capitals: a small fixed table."""
    return (
        report_types.where("is_reading")
        .select(F.upper(F.trim("report_type")).alias("kind"))
        .where("kind IS NOT NULL")
        .distinct()
    )


def _measured(obs: DataFrame, *more: Column | str) -> DataFrame:
    return obs.select(
        F.col("obs_id").alias("id"),
        F.col("station_id").alias("source"),
        F.upper(F.trim("report_type")).alias("kind"),
        "date",
        _number("temperature_c").alias("temp"),
        _number("dewpoint_c").alias("dew"),
        _number("precip_mm").alias("rain"),
        *more,
    )


def reading_rows(obs: DataFrame, report_types: DataFrame) -> DataFrame:
    """(id, source, temp, dew, rain, t): the rows of obs_hourly whose type is a reading, NaN as NULL.

    t is NULL where the date can't be read. Types are compared without letter
    case and blanks; rows of a NULL type are no readings.
    """
    return with_epoch(_measured(obs).join(_kinds(report_types), "kind", "left_semi").drop("kind"), "date").drop("date")


def hourly_rows(obs: DataFrame, report_types: DataFrame) -> DataFrame:
    """(id, source, temp, dew, rain, seen, t, reading): all rows of obs_hourly.

    t is the report's time or NULL, seen that time or else the one of its
    arrival, reading whether its type is a reading.
    """
    kinds = _kinds(report_types).withColumn("is_kind", F.lit(True))
    rows = with_epoch(_measured(obs, "ingested_at").join(kinds, "kind", "left").drop("kind"), "date").drop("date")
    return rows.select(
        "id", "source", "temp", "dew", "rain", F.coalesce("t", epoch_of(F.col("ingested_at"))).alias("seen"), "t",
        F.coalesce("is_kind", F.lit(False)).alias("reading"),
    )


def hourly_segments(readings: DataFrame, daily: DataFrame, said: DataFrame) -> DataFrame:
    """Stretches of obs_hourly records in a unit other than °C or mm: SEGMENTS.

    readings: reading_rows, best written out before, as it is read several
    times. Evidence is taken from rows with a source and a time. Stations without
    evidence keep the field's unit. An empty table gives an empty result.
    """
    rows = readings.where("source IS NOT NULL AND t IS NOT NULL")
    day = F.floor(F.col("t") / DAY).alias("day")
    sums = rows.groupBy("source", day).agg(
        *[F.sum(temperature_evidence(F.col("temp"), F.col("dew"), u)).alias(f"t_{u}") for u in TEMP_UNITS],
        *[F.sum(precipitation_evidence(F.col("rain"), u)).alias(f"p_{u}") for u in PRECIP_UNITS],
        F.sum(F.when(F.col("rain") > 0, F.col("rain"))).alias("wet"),
        F.max("temp").alias("hi"),
        F.min("temp").alias("lo"),
        F.count("temp").alias("n_temp"),
    )
    totals = daily.select(
        F.col("station").alias("source"),
        F.unix_date("date").cast("bigint").alias("day"),
        _number("prcp").alias("prcp"),
        _number("tmax").alias("tmax"),
        _number("tmin").alias("tmin"),
    )
    totals = totals.groupBy("source", "day").agg(*[F.max(c).alias(c) for c in ("prcp", "tmax", "tmin")])
    sums = materialise(sums.join(totals, ["source", "day"], "left"))
    head = [F.lit("obs_hourly").alias("src"), "source"]

    def extremes(u: str) -> Column:
        """Agreement of a day's extremes with the daily table: much for equality, little against it (a bad reading may be an extreme)."""
        out = F.lit(0.0)
        for mine, theirs in (("hi", "tmax"), ("lo", "tmin")):
            gap = F.abs(to_common(F.col(mine), u) - F.col(theirs))
            out = out + F.coalesce(F.when(gap <= 0.35, 15.0).otherwise(F.greatest(-gap, F.lit(-5.0))), F.lit(0.0))
        return out

    temp_days = sums.where("n_temp > 0").select(
        *head,
        F.lit(TEMPERATURE).alias("channel"),
        "day",
        *[(_capped(u) + extremes(u)).alias(f"l_{u}") for u in TEMP_UNITS],
    )

    def total(u: str) -> Column:
        d = F.ln(F.col("wet") * TO_MM[u][0] / F.col("prcp"))
        fit = F.when(d > 0, -0.5 * F.pow(d / 0.4, F.lit(2.0))).otherwise(-0.5 * F.pow(d / 0.7, F.lit(2.0)))
        return F.when((F.col("wet") > 0) & (F.col("prcp") > 0), F.greatest(1.5 * fit, F.lit(-9.0))).otherwise(0.0)

    rain_days = sums.where("wet > 0").select(
        *head,
        F.lit(PRECIPITATION).alias("channel"),
        "day",
        *[(F.col(f"p_{u}") + total(u)).alias(f"l_{u}") for u in PRECIP_UNITS],
    )
    t = _segments(
        temp_days, rows.where("temp IS NOT NULL"), said, TEMP_UNITS, "degC",
        lambda u: temperature_evidence(F.col("temp"), F.col("dew"), u),
    )
    p = _segments(
        rain_days, rows.where("rain > 0"), said, PRECIP_UNITS, "mm", lambda u: precipitation_evidence(F.col("rain"), u)
    )
    return t.unionByName(p)


def minute_segments(obs: DataFrame, said: DataFrame) -> DataFrame:
    """Stretches of obs_1min records in a unit other than °F or inches: SEGMENTS with the wban as source.

    Rows with a NULL wban or time give no evidence and no stretch.
    """
    rows = obs.select(
        F.col("wban").alias("source"),
        F.col("min_id").alias("id"),
        epoch_of(F.col("timestamp_utc")).alias("t"),
        _number("temp_f").alias("temp"),
        to_common(_number("dew_f"), "degF").alias("dew"),
        _number("precip_in").alias("rain"),
    ).where("source IS NOT NULL AND t IS NOT NULL")
    day = F.floor(F.col("t") / DAY).alias("day")
    days = materialise(
        rows.groupBy("source", day).agg(
            *[F.sum(temperature_evidence(F.col("temp"), F.col("dew"), u)).alias(f"t_{u}") for u in TEMP_UNITS],
            *[F.sum(tip_evidence(F.col("rain"), u)).alias(f"p_{u}") for u in PRECIP_UNITS],
            F.count_if(F.col("rain") > 0).alias("n_wet"),
            F.count("temp").alias("n_temp"),
        )
    )
    head = [F.lit("obs_1min").alias("src"), "source"]
    t = _segments(
        days.where("n_temp > 0").select(*head, F.lit(TEMPERATURE).alias("channel"), "day", *[_capped(u).alias(f"l_{u}") for u in TEMP_UNITS]),
        rows.where("temp IS NOT NULL"), said, TEMP_UNITS, "degF",
        lambda u: temperature_evidence(F.col("temp"), F.col("dew"), u),
    )
    p = _segments(
        days.where("n_wet > 0").select(*head, F.lit(PRECIPITATION).alias("channel"), "day", *[F.col(f"p_{u}").alias(f"l_{u}") for u in PRECIP_UNITS]),
        rows.where("rain > 0"), said, PRECIP_UNITS, "in", lambda u: tip_evidence(F.col("rain"), u),
    )
    return t.unionByName(p)


def in_common_units(readings: DataFrame, stretches: DataFrame) -> DataFrame:
    """reading_rows with temp and rain in °C and mm, and slack, the rounding of the converted temperature in °C.

    Rows outside every stretch stay as they are; one without a time is converted
    where its source used the unit throughout.
    """
    per = stretches.groupBy("source").agg(
        F.collect_list(F.struct("channel", "unit_code", "t_from", "t_until")).alias("held")  # a few per source
    )
    t = F.col("t")

    def unit(channel: str) -> Column:
        here = F.filter(
            "held",
            lambda s: (s["channel"] == channel)
            & F.coalesce((t >= s["t_from"]) & (t < s["t_until"]), (s["t_from"] <= -FOREVER) & (s["t_until"] >= FOREVER)),
        )
        return F.get(here, F.lit(0))["unit_code"]

    out = readings.join(per, "source", "left").withColumns({"u_t": unit(TEMPERATURE), "u_p": unit(PRECIPITATION)})
    slack = F.when(F.col("u_t").isNull(), 0.05).otherwise(0.5)
    return out.select(
        "id",
        "source",
        "t",
        F.coalesce(convert(F.col("temp"), F.col("u_t"), TO_DEG_C), F.col("temp")).alias("temp"),
        "dew",
        F.coalesce(convert(F.col("rain"), F.col("u_p"), TO_MM), F.col("rain")).alias("rain"),
        slack.alias("slack"),
    )


# ---------------------------------------------------------------- observers' texts


def read_texts(reports: DataFrame) -> DataFrame:
    """(report_id, station, field_name, value, unit_code) of every text that holds a number, one row per field.

    unit_code is what the text names, else what the station's other texts of the
    field name most often (ties: the code first in order), else what the
    station's median allows: a bare temperature is kelvin where that is above 200,
    °F above 45; other bare values are in the field's own unit.
    """
    fields = {"temp_text": TEMPERATURE, "precip_text": PRECIPITATION}
    long = reports.select(
        "report_id",
        F.upper(F.trim("station_id")).alias("station"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
        ).alias("x"),
    ).select("report_id", "station", "x.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [measured(t, fields[f]) for t, f in zip(b["text"], b["field_name"])]
            out = b[["report_id", "station", "field_name"]].copy()
            out["value"] = np.array([np.nan if v is None else v for v, _ in got], dtype=float)
            out["named"] = [u for _, u in got]
            yield out[[v is not None for v, _ in got]]

    read = long.where("text IS NOT NULL").mapInPandas(
        run, "report_id bigint, station string, field_name string, value double, named string"
    )
    votes = (
        read.where("named IS NOT NULL")
        .groupBy("station", "field_name", "named")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("station", "field_name")
        .agg(F.min_by("named", F.struct(-F.col("n"), F.col("named"))).alias("usual"))
    )
    # a station that never names a unit is judged by the median of what it writes
    middle = read.groupBy("station", "field_name").agg(F.percentile_approx("value", 0.5, 1000).alias("middle"))
    guess = F.when(F.col("field_name") == "precip_text", "mm").otherwise(
        F.when(F.col("middle") > 200, "K").when(F.col("middle") > 45, "degF").otherwise("degC")
    )
    usual = middle.join(votes, ["station", "field_name"], "left").select(
        "station", "field_name", F.coalesce("usual", guess).alias("usual")
    )
    return read.join(usual, ["station", "field_name"], "left").select(
        "report_id", "station", "field_name", "value", F.coalesce("named", "usual").alias("unit_code")
    )


# ---------------------------------------------------------------- results


def foreign_values(
    hourly: DataFrame, hourly_stretches: DataFrame, minute: DataFrame, minute_stretches: DataFrame, reports: DataFrame
) -> DataFrame:
    """(src_table, row_id, field_name, unit_code, value, common): every value in a unit other than its field's.

    hourly: hourly_rows, best written out before. common is the value in °C or mm. Missing values, words without a number and
    zero precipitation are no values here.
    """

    def bare(df: DataFrame, src: str, fields: dict[str, tuple[str, str]], cuts: DataFrame) -> DataFrame:
        here = cuts.select("source", "channel", "unit_code", "t_from", "t_until")
        kept = [F.struct(F.lit(ch).alias("channel"), F.lit(f).alias("field_name"), F.col(c).alias("value")) for c, (f, ch) in fields.items()]
        rows = df.join(here.select("source").distinct(), "source", "left_semi")
        rows = rows.select("source", "row_id", "t", F.inline(F.array(*kept))).where(
            F.col("value").isNotNull() & ((F.col("channel") == TEMPERATURE) | (F.col("value") != 0))
        )
        hit = rows.join(here, ["source", "channel"]).where("t >= t_from AND t < t_until")
        return hit.select(
            F.lit(src).alias("src_table"), F.col("row_id").cast("bigint").alias("row_id"), "field_name", "unit_code", "value",
            convert(F.col("value"), F.col("unit_code")).alias("common"),
        )

    a = bare(
        hourly.select("source", F.col("id").alias("row_id"), F.col("seen").alias("t"), "temp", "rain"), "obs_hourly",
        {"temp": ("temperature_c", TEMPERATURE), "rain": ("precip_mm", PRECIPITATION)}, hourly_stretches,
    )
    at = epoch_of(F.col("timestamp_utc")).alias("t")
    b = bare(
        minute.select(F.col("wban").alias("source"), F.col("min_id").alias("row_id"), at, _number("temp_f").alias("temp"), _number("precip_in").alias("rain")),
        "obs_1min", {"temp": ("temp_f", TEMPERATURE), "rain": ("precip_in", PRECIPITATION)}, minute_stretches,
    )
    own = F.when(F.col("field_name") == "temp_text", "degC").otherwise("mm")
    c = (
        read_texts(reports)
        .where((F.col("unit_code") != own) & ((F.col("field_name") == "temp_text") | (F.col("value") != 0)))
        .select(
            F.lit("raw_reports").alias("src_table"), F.col("report_id").alias("row_id"), "field_name", "unit_code", "value",
            convert(F.col("value"), F.col("unit_code")).alias("common"),
        )
    )
    return a.unionByName(b).unionByName(c)
