"""Irregular readings onto a regular UTC grid.

Each reading is valid from its instant until the next reading of its source, at
most `hold_s` seconds: a step function. The validity intervals are cut at the
grid's cell borders; a cell's value is the time-weighted average of the pieces
in it, its coverage the fraction of the cell that they fill.

The order within a source is found in buckets of time: a window runs over
(source, bucket), and a reading early in a bucket is also shown to the bucket
before, as far as the hold time reaches back. So a source with a third of all
rows is spread over many tasks, and the steps are those of one long series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import epoch_text, epoch_year, with_epoch

BUCKET_S = 30 * 86400
MEASURES = ("temperature_c", "dewpoint_c", "precip_mm")


def readings(obs: DataFrame, report_types: DataFrame) -> DataFrame:
    """(station_id, t, measures): rows that are readings, at their UTC second.

    A reading is of a type with is_reading (letter case and blanks aside), has a
    measure that is neither NULL nor NaN, and a valid ISO 8601 date with time of
    day. NaN measures become NULL. Rows with a NULL station_id are no reading of
    any station.
    """
    kinds = (
        report_types.where("is_reading")
        .select(F.upper(F.trim("report_type")).alias("kind"))
        .where("kind IS NOT NULL")
        .distinct()
    )
    clean = [F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in MEASURES]
    rows = obs.select("station_id", F.upper(F.trim("report_type")).alias("kind"), "date", *clean)
    rows = rows.where(F.coalesce(*MEASURES).isNotNull() & F.col("station_id").isNotNull()).join(kinds, "kind", "left_semi")
    return with_epoch(rows, "date", only_valid=True).select("station_id", "t", *MEASURES)


def validity_intervals(rows: DataFrame, hold_s: int = 7200) -> DataFrame:
    """(station_id, t, t_end, measures): the step function of each station.

    Readings of one station at the same second are one step with their mean.
    hold_s must be less than the bucket of 30 days.
    """
    steps = rows.groupBy("station_id", "t").agg(*[F.avg(m).alias(m) for m in MEASURES])
    own = F.floor(F.col("t") / BUCKET_S)
    shown = F.when(F.floor((F.col("t") - hold_s) / BUCKET_S) < own, F.array(own, own - 1)).otherwise(F.array(own))
    steps = steps.withColumn("bucket", F.explode(shown))
    steps = steps.withColumn("t_next", F.lead("t").over(Window.partitionBy("station_id", "bucket").orderBy("t")))
    limit = F.col("t") + hold_s
    return steps.where(F.col("bucket") == own).select(
        "station_id", "t", F.least(F.coalesce("t_next", limit), limit).alias("t_end"), *MEASURES
    )


def regular_grid(obs: DataFrame, report_types: DataFrame, cell_s: int = 3600, hold_s: int = 7200) -> DataFrame:
    """One row per station and grid cell, from the cell of its first to that of its last reading in each UTC year.

    Columns: station_id, cell (number of the cell since 1970), cell_start (UTC
    text), n_readings (distinct instants), coverage (0 to 1), the time-weighted
    mean of each measure, and status: `observed` (a reading lies in the cell),
    `held` (an earlier reading is still valid in it), `missing`. Means of cells
    that aren't covered are NULL. Without any reading the result is empty.
    """
    pieces = validity_intervals(readings(obs, report_types), hold_s).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("t") / cell_s), F.floor((F.col("t_end") - 1) / cell_s)))
    )
    start = F.col("cell") * cell_s
    lasts = F.least(F.col("t_end"), start + cell_s) - F.greatest(F.col("t"), start)
    pieces = pieces.withColumns({"lasts": lasts, "own": F.floor(F.col("t") / cell_s) == F.col("cell")})
    mean = lambda m: F.try_divide(
        F.sum(F.col(m) * F.col("lasts")), F.sum(F.when(F.col(m).isNotNull(), F.col("lasts")))
    )
    # a held piece may reach into the next year, whose grid begins with a reading of its own
    cells = pieces.groupBy("station_id", "cell").agg(
        F.count_if("own").alias("n_readings"),
        (F.sum("lasts") / F.lit(float(cell_s))).alias("coverage"),
        *[mean(m).alias(m) for m in MEASURES],
    )
    span = (
        cells.where("n_readings > 0")
        .groupBy("station_id", epoch_year(F.col("cell") * cell_s).alias("year"))
        .agg(F.min("cell").alias("a"), F.max("cell").alias("b"))
    )
    grid = span.select("station_id", F.explode(F.sequence("a", "b")).alias("cell"))
    n = F.coalesce("n_readings", F.lit(0))
    return grid.join(cells, ["station_id", "cell"], "left").select(
        "station_id",
        "cell",
        epoch_text(F.col("cell") * cell_s, "yyyy-MM-dd HH:mm").alias("cell_start"),
        n.alias("n_readings"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        *MEASURES,
        F.when(n > 0, "observed").when(F.col("coverage") > 0, "held").otherwise("missing").alias("status"),
    )
