"""Points near other points, and the region that holds a point.

Regions are polygons in the longitude/latitude plane. Their edges are binned into
latitude strips and, within a strip, into longitude cells whose number falls with
the cosine of the latitude. Points meet the edges of their own cell by an
equi-join; the crossings of a ray towards the east are summed by point and
region; an odd number means inside. A point on an edge or corner is found by its
own test and counts as inside.

Small regions and whole countries get along in one join: the height of the strips
doubles from level to level, and a region uses the level at which it spans a few
strips only. Points carry a row for each level.

"Within a distance" is the same join with a polygon around each circle, all on
one level, followed by the exact great-circle distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, great_circle_km, has_place

#: Corners of the polygon around a circle.
CORNERS = 8
#: Height of the strips of level 0 in degrees, number of levels, and strips that a region spans at its own level, about.
STRIP_DEG, LEVELS, STRIPS = 0.05, 9, 16


def _cells_in(strip: Column, height: Column) -> Column:
    """Number of longitude cells of a latitude strip: about as wide as high."""
    poleward = F.greatest(F.abs(strip), F.abs(strip + 1)) * height
    wide = F.cos(F.radians(F.least(poleward, F.lit(90.0))))
    return F.greatest(F.floor(F.lit(360.0) / height * wide), F.lit(1))


def _cell(lon: Column, cells: Column) -> Column:
    return F.floor((lon + 180.0) / F.lit(360.0) * cells)


def points_in_regions(points: DataFrame, regions: DataFrame, strip_deg: float | None = None) -> DataFrame:
    """(region columns, point columns) of every point that lies in a region, its boundary included.

    strip_deg: one height of strips for all, where all regions are about as
    high; left out, each region uses the level that suits it.

    points: any columns besides x (longitude) and y (latitude), both finite.
    regions: any columns besides ring, an array of struct<x,y> of corners in
    order, not closed; longitudes may run past ±180, then a shifted copy is
    searched too. Regions with fewer than three corners hold nothing. Repeated
    rows on either side give their pair once.
    """
    keep = [c for c in regions.columns if c != "ring"]
    r = regions.where(F.size("ring") >= 3).select(
        *keep,
        "ring",
        F.array_min(F.transform("ring", lambda v: v["x"])).alias("_x0"),
        F.array_max(F.transform("ring", lambda v: v["x"])).alias("_x1"),
    )
    r = r.withColumn(
        "_shift",
        F.explode(
            F.array_compact(
                F.array(
                    F.lit(0.0),
                    F.when(F.col("_x0") < -180, F.lit(360.0)),
                    F.when(F.col("_x1") > 180, F.lit(-360.0)),
                )
            )
        ),
    )
    n = F.size("ring")
    edges = F.transform(
        "ring",
        lambda v, i: F.struct(
            (v["x"] + F.col("_shift")).alias("x1"),
            v["y"].alias("y1"),
            (F.element_at("ring", (i + 1) % n + 1)["x"] + F.col("_shift")).alias("x2"),
            F.element_at("ring", (i + 1) % n + 1)["y"].alias("y2"),
        ),
    )
    r = r.withColumns({"_edges": edges, "_x0": F.col("_x0") + F.col("_shift"), "_x1": F.col("_x1") + F.col("_shift")})
    if strip_deg is None:
        tall = F.array_max(F.transform("ring", lambda v: v["y"])) - F.array_min(F.transform("ring", lambda v: v["y"]))
        level = F.ceil(F.log2(F.greatest(tall / F.lit(STRIP_DEG * STRIPS), F.lit(1.0)))).cast("int")
        r = r.withColumn("_level", F.least(level, F.lit(LEVELS - 1)))
        points = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    else:
        r, points = r.withColumn("_level", F.lit(0)), points.withColumn("_level", F.lit(0))
    h = F.lit(strip_deg or STRIP_DEG) * F.pow(F.lit(2.0), F.col("_level"))
    r = r.withColumn(
        "_strip",
        F.explode(
            F.sequence(
                F.floor(F.array_min(F.transform("_edges", lambda e: e["y1"])) / h),
                F.floor(F.array_max(F.transform("_edges", lambda e: e["y1"])) / h),
            )
        ),
    )
    # an edge belongs to each strip that it touches
    r = r.withColumn(
        "_edges",
        F.filter(
            "_edges",
            lambda e: (F.floor(F.least(e["y1"], e["y2"]) / h) <= F.col("_strip"))
            & (F.floor(F.greatest(e["y1"], e["y2"]) / h) >= F.col("_strip")),
        ),
    ).withColumn("_n", F.size("_edges"))
    cells = _cells_in(F.col("_strip"), h)
    r = r.withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.greatest(_cell(F.col("_x0"), cells), F.lit(0)),
                F.greatest(F.least(_cell(F.col("_x1"), cells), cells), F.lit(0)),
            )
        ),
    )
    r = r.withColumn("_e", F.explode("_edges")).select(*keep, "_shift", "_x0", "_x1", "_level", "_strip", "_cell", "_n", "_e.*")

    mine = [c for c in points.columns if c != "_level"]
    strip = F.floor(F.col("y") / h)
    p = points.withColumn("_strip", strip).withColumn("_cell", _cell(F.col("x"), _cells_in(F.col("_strip"), h)))
    j = r.join(p, ["_level", "_strip", "_cell"]).where(F.col("x").between(F.col("_x0"), F.col("_x1")))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    cross = ((y1 > y) != (y2 > y)) & (x < x1 + F.try_divide((y - y1) * (x2 - x1), y2 - y1))
    on_edge = (
        ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    found = j.groupBy(*keep, "_shift", *mine).agg(
        F.count_if(cross).alias("_crossings"),
        F.count(F.lit(1)).alias("_rows"),
        F.max("_n").alias("_n"),
        F.bool_or(on_edge).alias("_edge"),
    )
    # a row that comes k times meets every edge of its strip k times
    once = F.col("_crossings") * F.col("_n") / F.col("_rows")
    return found.where(F.col("_edge") | (F.pmod(F.round(once), F.lit(2)) == 1)).select(*keep, *mine)


def circle_ring(lat: Column, lon: Column, radius_km: float) -> Column:
    """A polygon that holds all places within radius_km of (lat, lon).

    Eight corners where the circle is nearly an ellipse in the plane; the
    bounding rectangle near the poles or for a large radius; all longitudes when
    a pole lies inside.
    """
    d = radius_km / EARTH_KM
    dlat = math.degrees(d)
    ratio = F.lit(math.sin(d)) / F.cos(F.radians(lat))
    dlon = F.degrees(F.asin(F.least(ratio, F.lit(1.0))))
    out = 1.01 / math.cos(math.pi / CORNERS)
    corner = lambda k: F.struct(
        (lon + dlon * (out * math.sin(2 * math.pi * (k + 0.5) / CORNERS))).alias("x"),
        (lat + dlat * (out * math.cos(2 * math.pi * (k + 0.5) / CORNERS))).alias("y"),
    )
    octagon = F.array(*[corner(k) for k in range(CORNERS)])
    pole = F.abs(lat) + dlat * 1.01 >= 90
    west = F.when(pole, F.lit(-180.0)).otherwise(lon - dlon * 1.01)
    east = F.when(pole, F.lit(180.0)).otherwise(lon + dlon * 1.01)
    south, north = F.greatest(lat - dlat * 1.01, F.lit(-90.0)), F.least(lat + dlat * 1.01, F.lit(90.0))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.array(at(west, south), at(west, north), at(east, north), at(east, south))
    curved = (F.abs(F.tan(F.radians(lat))) * d > 0.005) | F.lit(d > 0.005)
    return F.when(curved | pole, box).otherwise(octagon)


def within_distance(
    centres: DataFrame,
    centre_key: str,
    centre_lat: str,
    centre_lon: str,
    points: DataFrame,
    point_key: str,
    point_lat: str,
    point_lon: str,
    radius_km: float,
) -> DataFrame:
    """(centre_key, point_key, distance_km) of all pairs at most radius_km apart by great circle.

    A row has no place, and no pair, when a coordinate is NULL, NaN or outside
    ±90/±180, or both are 0. Distances cross the 180° meridian and the poles.
    Repeated rows give their pair once. Other columns are never looked at.
    """
    c = centres.select(
        F.col(centre_key).alias("centre_key"),
        F.col(centre_lat).cast("double").alias("clat"),
        F.col(centre_lon).cast("double").alias("clon"),
    ).where(has_place(F.col("clat"), F.col("clon")))
    p = points.select(
        F.col(point_key).alias("point_key"),
        F.col(point_lat).cast("double").alias("y"),
        F.col(point_lon).cast("double").alias("x"),
    ).where(has_place(F.col("y"), F.col("x")))
    regions = c.withColumn("ring", circle_ring(F.col("clat"), F.col("clon"), radius_km))
    strip = max(0.05, 2 * math.degrees(radius_km / EARTH_KM))
    near = points_in_regions(p, regions, strip)
    d = great_circle_km(F.col("clat"), F.col("clon"), F.col("y"), F.col("x"))
    return (
        near.withColumn("distance_km", d)
        .where(F.col("distance_km") <= radius_km)
        .select(F.col("centre_key").alias(centre_key), F.col("point_key").alias(point_key), "distance_km")
    )
