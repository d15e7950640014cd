"""Implausible readings, judged by what their own source normally shows.

Three kinds of rule, all on values already brought to °C and mm:

* plausibility: outside physical bounds, negative precipitation, a dew point
  above the temperature;
* leaps: one reading, or two in a row, that leave the readings before and after
  in the same direction. The leap is measured on residuals from the source's own
  seasonal and daily course, and cut off by peaks over threshold: a generalised
  Pareto distribution is fitted to each source's excesses over a high quantile,
  its shape drawn towards that of all sources, and the cutoff is the level that
  an honest record exceeds with a fixed small risk. Precipitation is cut off by
  a fit on the logarithm of wet readings, with a wide empty gap below;
* stuck values: runs of one repeated value; the lengths of a source's own runs
  get a tail fit as well.

The order of a source's readings is worked out in buckets of time, each sorted on
its own and shown the readings of a day on either side. What reaches beyond a
bucket, runs that touch its border, is a table of at most two rows per source,
bucket and measure. The fits work on histograms, so no source's readings ever
meet in one task. Only readings that might be cases leave the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BUCKET_S = 30 * 86400
#: Parts of the day for which a bucket keeps a normal value.
PARTS = 8
MEASURES = ("temp", "dew", "rain")
FIELD = {"temp": "temperature_c", "dew": "dewpoint_c", "rain": "precip_mm"}

#: Physical bounds in °C and mm per reading: a little beyond the extremes ever measured at the ground.
BOUNDS = {"temp": (-90.0, 60.0), "dew": (-100.0, 40.0), "rain": (0.0, 500.0)}
#: A dew point may lie so far above the temperature by rounding alone.
ROUNDING_C = 0.05
#: Neighbours further away than this in seconds say nothing about a leap.
NEIGHBOUR_S = 24 * 3600
#: Readings of a source's whole record that may exceed a leap's cutoff by chance, and runs a run's: the fixed risks.
RISK, RUN_RISK = 0.003, 0.01
#: Histogram steps: °C of a leap, natural logarithm of a wet reading.
LEAP_STEP, LOG_STEP = 0.05, 0.05
#: Leaps: quantile of the peaks that is the threshold, share left out of the first fit, excesses needed, and how many
#: excesses the shape of all sources weighs as much as.
THRESHOLD, LEAP_TRIM, EXCESSES, POOL = 0.9, 0.1, 3, 500.0
#: Runs and wet readings: shares of a source's peaks at whose survival the tail is read; the share left out of the first fit; peaks needed.
LEVELS, TRIM, LEAST = (0.3, 0.1, 0.03), 0.02, 8
#: The same share and number for runs, of which a record has fewer.
RUN_TRIM, RUN_PEAKS = 0.1, 30
#: A stuck run is longer than the cutoff and at least this many readings.
RUN_LEAST = 10
#: A leap counts only above the cutoff and this many °C.
LEAP_LEAST = 2.0
#: A wet spike is above the cutoff and this many times anything else the source records.
WET_GAP = 2.5
WET_PART, WET_MOST = 0.5, 4.0
#: Rows that a task looks at together, whole buckets of them.
CHUNK_ROWS = 200_000


def plausible(value: Column, measure: str) -> Column:
    low, high = BOUNDS[measure]
    return F.coalesce((value >= low) & (value <= high), F.lit(False))


def implausible_rows(rows: DataFrame, tolerance: Column | None = None) -> DataFrame:
    """(id, measure): values out of bounds, and dew points above a plausible temperature.

    tolerance: how far above is still rounding, per row.
    """
    slack = F.lit(ROUNDING_C) if tolerance is None else tolerance
    bad = {m: F.col(m).isNotNull() & ~plausible(F.col(m), m) for m in MEASURES}
    above = plausible(F.col("temp"), "temp") & (F.col("dew") > F.col("temp") + slack)
    bad["dew"] = bad["dew"] | F.coalesce(above, F.lit(False))
    hits = F.array_compact(F.array(*[F.when(bad[m], F.lit(m)) for m in MEASURES]))
    return rows.select("id", F.explode(hits).alias("measure"))


# ---------------------------------------------------------------- the ordered record


def in_buckets(rows: DataFrame) -> DataFrame:
    """(source, bucket, own, t, id, measures): every dated reading in its bucket, and in the next one whose border is within a day.

    Implausible values are left out, so that they are nobody's neighbour.
    Partitions hold whole buckets, in order. However much one source has, a
    bucket has at most the seconds of its 30 days, times their deliveries.
    """
    clean = [F.when(plausible(F.col(m), m), F.col(m)).alias(m) for m in MEASURES]
    at = lambda s: F.floor((F.col("t") + s) / BUCKET_S).cast("bigint")
    held = F.array_distinct(F.array(at(0), at(-NEIGHBOUR_S), at(NEIGHBOUR_S)))
    return (
        rows.where("source IS NOT NULL AND t IS NOT NULL")
        .select("source", "t", "id", *clean)
        .where(F.coalesce(*MEASURES).isNotNull())
        .withColumn("bucket", F.explode(held))
        .select("source", "bucket", (F.col("bucket") == at(0)).alias("own"), "t", "id", *MEASURES)
        .repartition("source", "bucket")
        .sortWithinPartitions("source", "bucket", "t", "id")
    )


def _shifted(x: np.ndarray, k: int, fill) -> np.ndarray:
    """x with the value of the place k before (k < 0: after) in each place."""
    out = np.full(len(x), fill, dtype=x.dtype)
    if k > 0:
        out[k:] = x[:-k]
    else:
        out[:k] = x[-k:]
    return out


def daily_course(g: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The normal value at each instant: medians by bucket and part of the day, joined by straight lines.

    Medians, so that spikes don't move it. g: numbers of the buckets, ascending.
    """
    part = (t % 86400) // (86400 // PARTS)
    cell = (g - g[0]) * PARTS + part
    order = np.lexsort((v, cell))
    held, first, n = np.unique(cell[order], return_index=True, return_counts=True)
    table = np.full((int(g[-1] - g[0]) + 1) * PARTS, np.nan)
    x = v[order]
    table[held] = (x[first + (n - 1) // 2] + x[first + n // 2]) / 2
    table = table.reshape(-1, PARTS)
    n = (~np.isnan(table)).sum(axis=1, keepdims=True)
    mean = np.nansum(table, axis=1, keepdims=True) / np.maximum(n, 1)
    table = np.where(np.isnan(table), mean, table)
    x = (t % 86400) / (86400 // PARTS) - 0.5
    k = np.floor(x).astype(np.int64)
    row = table[g - g[0]]
    here = np.arange(len(g))
    return (1 - (x - k)) * row[here, k % PARTS] + (x - k) * row[here, (k + 1) % PARTS]


def leaps(g: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How far each instant's residual leaves the instants before and after in one direction, alone or with one neighbour; 0 if it doesn't."""
    near = {k: (_shifted(g, k, -1) == g) & (np.abs(_shifted(t, k, 0) - t) <= NEIGHBOUR_S) for k in (1, -1, 2, -2)}
    b1, a1, b2, a2 = (_shifted(r, k, np.nan) for k in (1, -1, 2, -2))

    def away(ok: np.ndarray, before: np.ndarray, after: np.ndarray, *values: np.ndarray) -> np.ndarray:
        sign = np.sign(r - before)
        d = np.minimum.reduce([sign * (x - y) for x in values for y in (before, after)])
        return np.where(ok & (d > 0), d, 0.0)

    alone = away(near[1] & near[-1], b1, a1, r)
    first = away(near[1] & near[-1] & near[-2], b1, a2, r, a1)
    second = away(near[1] & near[2] & near[-1], b2, a1, r, b1)
    return np.maximum.reduce([alone, first, second])


_KINDS = "kind string, source string, bucket bigint, measure string, at int, id bigint, x double, n bigint"
FIRST, LAST = 1, 2


class _Out:
    """Rows of _KINDS, collected column by column."""

    def __init__(self, names: pa.Array):
        self.names, self.parts = names, []

    def add(self, kind: str, measure: str, code, *, bucket=0, at=0, id=0, x=0.0, n=0) -> None:  # noqa: A002
        size = len(code)
        if size:
            full = lambda v, kind: np.broadcast_to(np.asarray(v, dtype=kind), size)
            self.parts.append(
                pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(kind, size), self.names.take(pa.array(code)), pa.array(full(bucket, np.int64)), pa.repeat(measure, size),
                        pa.array(full(at, np.int32)), pa.array(full(id, np.int64)), pa.array(full(x, np.float64)), pa.array(full(n, np.int64)),
                    ],
                    names=["kind", "source", "bucket", "measure", "at", "id", "x", "n"],
                )
            )

    def histogram(self, name: str, code: np.ndarray, bins: np.ndarray) -> None:
        if len(code):
            low = int(bins.min())
            width = int(bins.max()) - low + 1
            both, n = np.unique(code.astype(np.int64) * width + (bins.astype(np.int64) - low), return_counts=True)
            self.add("hist", name, (both // width).astype(np.int32), x=both % width + low, n=n)


def _look(out: _Out, m: str, code, bucket, g, own, t, ids, v) -> None:
    """What one measure of whole buckets in order has to report: histograms, readings that may be cases, runs at the borders."""
    i = np.flatnonzero(~np.isnan(v))
    if not len(i):
        return
    code, bucket, g, own, t, ids, v = (x[i] for x in (code, bucket, g, own, t, ids, v))
    begins = (_shifted(g, 1, -1) != g) | (_shifted(t, 1, -1) != t)
    first, of = np.flatnonzero(begins), np.cumsum(begins) - 1
    fg, ft, fv = g[first], t[first], v[first]
    same = v == fv[of]
    if m != "rain":
        course = daily_course(fg, ft, fv)
        r = fv - course
        leap = leaps(fg, ft, r)
        rows = np.where(same, leap[of], 0.0)
        # another value at the same second meets the neighbours of that second
        for k in np.flatnonzero(~same).tolist():
            j = int(of[k])
            if 0 < j < len(first) - 1 and fg[j - 1] == fg[j] == fg[j + 1] and ft[j] - ft[j - 1] <= NEIGHBOUR_S and ft[j + 1] - ft[j] <= NEIGHBOUR_S:
                up, down = v[k] - course[j] - r[j - 1], v[k] - course[j] - r[j + 1]
                rows[k] = min(abs(up), abs(down)) if up * down > 0 else 0.0
        mine = own[first]
        out.histogram(f"{m}_leap", code[first][mine], np.ceil(leap[mine] / LEAP_STEP))
        hit = own & (rows > LEAP_LEAST)
        out.add("leap", m, code[hit], id=ids[hit], x=rows[hit])
    else:
        hit = own & (v > 0)
        out.add("wet", m, code[hit], id=ids[hit], x=v[hit])
    # runs, among a bucket's own instants only
    j = np.flatnonzero(own[first])
    if not len(j):
        return
    rg, rv, rc, rb = fg[j], fv[j], code[first][j], bucket[first][j]
    opens = _shifted(rg, 1, -1) != rg
    starts = opens | (_shifted(rv, 1, np.nan) != rv)
    a, run = np.flatnonzero(starts), np.cumsum(starts) - 1
    length = np.diff(np.append(a, len(j)))
    closes = np.append(opens[1:], True)[a + length - 1]
    at = FIRST * opens[a] + LAST * closes
    counts = rv[a] > 0 if m == "rain" else np.ones(len(a), dtype=bool)
    inner = counts & (at == 0)
    out.histogram(f"{m}_run", rc[a][inner], length[inner])
    out.add("edge", m, rc[a][at > 0], bucket=rb[a][at > 0], at=at[at > 0], x=rv[a][at > 0], n=length[at > 0])
    if m == "rain":  # of a stuck gauge only the first reading speaks for what the source records
        wet = rv[a] > 0
        out.histogram("rain_log", rc[a][wet], np.floor(np.log(rv[a][wet]) / LOG_STEP))
    # every row of a run that is long, or may be
    of_run = np.full(len(first), -1, dtype=np.int64)
    of_run[j] = run
    k = np.where(own & same, of_run[of], -1)
    may = np.append(counts & ((at > 0) | (length >= RUN_LEAST)), False)[k]
    hit, k = np.flatnonzero(may), k[may]
    border = at[k] > 0
    out.add("run", m, code[hit[~border]], id=ids[hit[~border]], x=length[k[~border]])
    out.add("rest", m, code[hit[border]], bucket=bucket[hit[border]], at=at[k[border]], id=ids[hit[border]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_KINDS of a partition of in_buckets, in chunks of whole buckets."""
    held: list[pa.RecordBatch] = []
    size = 0

    def look(table: pa.Table) -> Iterator[pa.RecordBatch]:
        source = table.column("source").combine_chunks().dictionary_encode()
        if isinstance(source, pa.ChunkedArray):
            source = source.combine_chunks()
        code = source.indices.to_numpy()
        bucket, own, t, ids = (table.column(c).to_numpy() for c in ("bucket", "own", "t", "id"))
        g = np.cumsum((_shifted(code, 1, -1) != code) | (_shifted(bucket, 1, -(1 << 40)) != bucket))
        out = _Out(source.dictionary)
        for m in MEASURES:
            v = table.column(m).to_numpy(zero_copy_only=False).astype(np.float64)
            _look(out, m, code, bucket, g, own, t, ids, v)
        yield from out.parts

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK_ROWS:
            table = pa.Table.from_batches(held)
            source, bucket = table.column("source"), table.column("bucket").to_numpy()
            last = source[-1].as_py()
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0
            while cut < table.num_rows and source[cut].as_py() != last:
                cut += 1
            if cut:
                yield from look(table.slice(0, cut))
                table = table.slice(cut)
            held, size = table.to_batches(), table.num_rows if cut else 0
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield from look(table)


def scanned(rows: DataFrame) -> DataFrame:
    """_KINDS of all rows: one shuffle, one pass."""
    return in_buckets(rows).mapInArrow(_scan, _KINDS)


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole lengths of one source's runs of a measure that touch a bucket's border; `begins` marks the piece that a run begins with."""
    pdf = pdf.sort_values(["bucket", "at"], kind="stable").reset_index(drop=True)
    value, at, n = pdf["x"].to_numpy(), pdf["at"].to_numpy(), pdf["n"].to_numpy()
    # a run goes on if the piece ends its bucket and the next piece, in the next bucket with readings, begins that one
    goes_on = np.zeros(len(pdf), dtype=bool)
    goes_on[1:] = (at[:-1] >= LAST) & (at[1:] != LAST) & (value[1:] == value[:-1])
    run = np.cumsum(~goes_on) - 1
    return pdf[["source", "bucket", "measure", "at", "x"]].assign(length=np.bincount(run, n)[run].astype(np.int64), begins=~goes_on)


def linked(found: DataFrame) -> DataFrame:
    """(source, bucket, measure, at, x, length, begins) of the runs that touch a border."""
    return (
        found.where("kind = 'edge'")
        .select("source", "bucket", "measure", "at", "x", "n")
        .groupBy("source", "measure")
        .applyInPandas(_link, "source string, bucket bigint, measure string, at int, x double, length bigint, begins boolean")
    )


# ---------------------------------------------------------------- tail cutoffs


def pareto_cutoff(values: np.ndarray, counts: np.ndarray, pooled: float | None, risk: float = RISK) -> tuple[float, float, float]:
    """(cutoff, shape, excesses) of peaks given as a histogram: the level that `risk` readings are expected to exceed.

    Peaks over the threshold quantile get a generalised Pareto distribution by
    probability-weighted moments. The shape that one record gives is noise, so it
    counts as much as it has excesses, the pooled one as much as POOL; without a
    pooled one the tail is exponential. Counts are spread over the lattice on
    which the source records. The first fit leaves out the highest peaks, later
    ones what the last fit cut off, until the cutoff stays. Infinite, with no
    excesses, where there are too few.
    """
    order = np.argsort(values, kind="stable")
    v, n = values[order].astype(float), counts[order].astype(float)
    v, n = v[v > 0], n[v > 0]
    if n.sum() < 5 * EXCESSES:
        return math.inf, 0.0, 0.0
    gaps = np.diff(v)
    step = float(np.median(gaps[: max(1, len(gaps) // 2)])) if len(gaps) else LEAP_STEP
    spread = ((np.arange(8) + 0.5) / 8 - 0.5) * step
    x, w = (v[:, None] + spread).ravel(), np.repeat(n / 8, 8)
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    keep, cut, own, m = np.cumsum(w) <= (1 - LEAP_TRIM) * w.sum(), math.inf, 0.0, 0.0
    for _ in range(30):
        xs, ws = x[keep], w[keep]
        if not len(xs):
            return math.inf, 0.0, 0.0
        u = xs[min(int(np.searchsorted(np.cumsum(ws), THRESHOLD * ws.sum())), len(xs) - 1)]
        e, ew = xs[xs > u] - u, ws[xs > u]
        m = float(ew.sum())
        if m < EXCESSES:
            return math.inf, 0.0, 0.0
        b0 = float((e * ew).sum() / m)
        b1 = float((e * (1 - (np.cumsum(ew) - ew / 2) / m) * ew).sum() / m)
        own = 2 - b0 / (b0 - 2 * b1) if b0 > 2 * b1 else -1.0
        shape = 0.0 if pooled is None else (m * max(own, -0.5) + POOL * pooled) / (m + POOL)
        scale, times = b0 * (1 - shape), max(m / risk, 1.0)
        again = u + (scale * math.log(times) if abs(shape) < 1e-9 else scale / shape * (times**shape - 1))
        if abs(again - cut) < 1e-6:
            break
        cut, keep = again, x <= again
    return cut, own, m


def tail_cutoff(values: np.ndarray, counts: np.ndarray, risk: float = RUN_RISK, trim: float = TRIM, least: int = LEAST) -> float:
    """The level that `risk` readings of a sample are expected to exceed: peaks over threshold.

    values: 0 or more, as a histogram with counts; zeros are readings without a
    peak. For runs and wet readings, of which a record has few, the tail is the
    exponential one. Its scale comes from survival at LEVELS of the peaks, read at
    values that occur, so a source that records whole degrees is fitted on its
    own lattice; where all levels fall on one value, the step from 0 serves.
    The first fit leaves out the share `trim` of the highest peaks, later ones what the last
    fit cut off, until the cutoff stays. Infinity below `least` peaks.
    """
    order = np.argsort(values, kind="stable")
    v, n = values[order].astype(float), counts[order].astype(float)
    everything = n.sum()
    n = np.where(v > 0, n, 0.0)
    if n.sum() < least:
        return math.inf

    def fit(m: np.ndarray) -> float:
        total = m.sum()
        if total <= 0:
            return math.inf
        cum = np.cumsum(m)
        points: list[tuple[float, float]] = []
        for level in LEVELS:
            x = v[min(int(np.searchsorted(cum, (1 - level) * total, side="right")), len(v) - 1)]
            if not points or x > points[-1][0] + 1e-9:
                points.append((x, max(m[v > x].sum(), 0.5) / everything))
        if len(points) < 2:
            points = [(0.0, total / everything), *points]
        if len(points) < 2:
            return math.inf
        (x0, s0), (x1, s1) = points[0], points[-1]
        scale = (x1 - x0) / math.log(s0 / s1) if s0 > s1 else 0.0
        return x1 + scale * math.log(max(everything * s1 / risk, 1.0))

    keep = np.minimum(n, np.maximum(0.0, n.sum() * (1 - trim) - (np.cumsum(n) - n)))
    cut = fit(keep)
    for _ in range(8):
        again = fit(np.where(v <= cut, n, 0.0))
        if not abs(again - cut) > 1e-6:
            break
        cut = again
    return cut


def wet_cutoff(logs: np.ndarray, counts: np.ndarray) -> float:
    """Level of the logarithm above which wet readings are spikes: well into the fitted tail, with a gap below.

    The fit alone would be bold in a short record, the gap alone blind. A value
    counts if it lies at least WET_PART of the way from the source's middle to
    the fitted cutoff and nothing lies within the factor WET_GAP below it. Where
    there is no such gap, because a value lies between, those count that exceed
    WET_GAP times the cutoff fitted to the amounts themselves: what the source
    would record at most.
    """
    order = np.argsort(logs, kind="stable")
    v, n = logs[order].astype(float), counts[order].astype(float)
    if n.sum() < 4:
        return math.inf
    middle = v[int(np.searchsorted(np.cumsum(n), n.sum() / 2))]
    cut = min(tail_cutoff(np.maximum(v - middle, 0.0), n), WET_MOST)
    for i in range(1, len(v)):
        if v[i] >= middle + WET_PART * cut and v[i] - v[i - 1] >= math.log(WET_GAP):
            return v[i] - LOG_STEP / 2
    return math.log(WET_GAP * tail_cutoff(np.exp(v), n))


def _shapes(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one source's leaps say about the shape of the tail."""
    out = []
    for m, h in pdf.groupby("measure"):
        _, shape, n = pareto_cutoff(h["x"].to_numpy() * LEAP_STEP, h["n"].to_numpy(), None)
        if n:
            out.append((m, shape))
    return pd.DataFrame(out, columns=["measure", "shape"])


def _cutoffs(pooled: dict[str, float]):
    """Function from one source's histograms to its cutoffs; a leap's is infinite where no fit is possible."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: (h["x"].to_numpy(), h["n"].to_numpy()) for k, h in pdf.groupby("measure")}
        none = (np.zeros(0), np.zeros(0))
        out = []
        for m in ("temp", "dew"):
            bins, n = of.get(f"{m}_leap", none)
            v = bins * LEAP_STEP
            mean = float((v * n).sum() / n[v > 0].sum()) if (v > 0).any() else None
            out.append(("leap", m, pareto_cutoff(v, n, pooled.get(f"{m}_leap", 0.0))[0], mean))
        for m in MEASURES:
            bins, n = of.get(f"{m}_run", none)
            cut = tail_cutoff(bins - 1, n, trim=RUN_TRIM, least=RUN_PEAKS)
            # too few repeats to fit: the source hardly ever repeats a value
            out.append(("run", m, float(RUN_LEAST) if math.isinf(cut) else max(cut + 1, float(RUN_LEAST)), None))
        bins, n = of.get("rain_log", none)
        out.append(("wet", "rain", float(np.exp(wet_cutoff(bins * LOG_STEP, n))), None))
        return pd.DataFrame(out, columns=["kind", "measure", "cut", "mean"]).assign(source=pdf["source"].iloc[0])

    return run


def cutoffs(found: DataFrame, links: DataFrame) -> DataFrame:
    """(source, kind, measure, cut): the cutoffs of every source.

    Histograms are summed before they move, at most a few hundred bins per
    source. Two numbers per measure come to the driver: the median shape of all
    sources' tails, and the median cutoff in mean leaps, which a source too short
    for a fit takes times its own mean leap.
    """
    runs = links.where(F.col("begins") & ((F.col("measure") != "rain") | (F.col("x") > 0))).select(
        "source", F.concat("measure", F.lit("_run")).alias("measure"), F.col("length").cast("double").alias("x"), F.lit(1).cast("bigint").alias("n")
    )
    hist = found.where("kind = 'hist'").select("source", "measure", "x", "n").unionByName(runs)
    hist = materialise(hist.groupBy("source", "measure", "x").agg(F.sum("n").alias("n")))
    shapes = hist.where(F.col("measure").endswith("_leap")).groupBy("source").applyInPandas(_shapes, "measure string, shape double")
    pooled = {r["measure"]: r["s"] for r in shapes.groupBy("measure").agg(F.percentile_approx("shape", 0.5, 1000).alias("s")).collect()}
    cuts = materialise(
        hist.groupBy("source").applyInPandas(_cutoffs(pooled), "kind string, measure string, cut double, mean double, source string")
    )
    times = F.percentile_approx(F.col("cut") / F.col("mean"), 0.5, 1000).alias("k")
    usual = cuts.where("kind = 'leap' AND mean > 0 AND cut < double('inf')").groupBy("measure").agg(times).collect()  # two rows
    infinite = F.col("cut") == float("inf")
    cut = F.col("cut")
    for r in usual:
        cut = F.when(infinite & (F.col("kind") == "leap") & (F.col("measure") == r["measure"]), F.coalesce(F.col("mean") * r["k"], cut)).otherwise(cut)
    return cuts.select("source", "kind", "measure", cut.alias("cut"))


def bad_readings(rows: DataFrame) -> DataFrame:
    """(id, field_name): every implausible, leaping or stuck value of the rows.

    rows: id, source, t (epoch seconds or NULL), temp, dew, rain in °C and mm,
    slack (rounding of the temperature in °C), readings only; read twice. NULL
    measures are never flagged. A row without time or source is judged by
    plausibility alone. A reading delivered twice is flagged in both rows. Of
    differing values of one source at the same second each is judged against the
    seconds before and after; runs go by the first of them by id. A source too
    short for a fit takes the usual cutoff in units of its own mean leap.
    """
    found = materialise(scanned(rows))
    links = materialise(linked(found))
    rest = (
        found.where("kind = 'rest'")
        .select("source", "bucket", "measure", "at", "id")
        .join(links.where(F.col("length") >= RUN_LEAST), ["source", "bucket", "measure", "at"])
        .select(F.lit("run").alias("kind"), "source", "measure", "id", F.col("length").cast("double").alias("x"))
    )
    may = found.where("kind IN ('leap', 'wet', 'run')").select("kind", "source", "measure", "id", "x").unionByName(rest)
    by_tail = may.join(cutoffs(found, links), ["source", "kind", "measure"]).where(F.col("x") > F.col("cut")).select("id", "measure")
    named = F.element_at(F.create_map(*[F.lit(s) for kv in FIELD.items() for s in kv]), F.col("measure"))
    return (
        implausible_rows(rows, F.col("slack"))
        .unionByName(by_tail)
        .distinct()
        .select("id", named.alias("field_name"))
    )
