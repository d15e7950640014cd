"""Entries of another list matched with the stations they describe.

Both lists are sorted by several keys, each robust against other dirt: the name
from its front and from its back, the place along two space-filling curves, and
every id. An entry meets the stations whose rank lies within a window around its
own in any of these orders, so the pairs grow with the entries, not with the
product of the lists. Each pair gets a weight, the sum of log2 odds of what agrees
and what doesn't; an entry's confidence in a station is that station's share of
the odds among all it met and the chance that it has none.

An entry gets at most one station. A station may get several entries: lists hold
a station once for every period or id that it had.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle_km, has_place
from ..session import materialise

#: Stations on either side of an entry in each order.
WINDOW = 50
#: log2 odds that a pair must have to weigh as much as "no station in the list".
NO_STATION = 9.0

#: What a station is, and how its words are abbreviated. The first that occurs counts.
KINDS = {
    "municipal": "MUNICIPAL|MUNICPL|MUNI", "international": "INTERNATIONAL|INTL|INT", "regional": "REGIONAL|RGNL|RGL|REG",
    "county": "COUNTY|CNTY|CO", "base": "A F B|A F|AIR F B|AIR FORCE|AIR|AFB|A", "ranger": "RANGER|RNGR",
    "experiment": "EXPERIMENT|EXPT|EXP", "water": "WATER|WTR", "power": "POWERHOUSE|POWER|PWR|PH", "light": "LIGHTHOUSE|LT|L H|LH",
    "dam": "DAM", "fire": "FIRE|F",
}
OTHER_WORDS = "AIRPORT|ARPT|APT|AP|STATION|STN|STA|FORCE|BASE|PLANT|PLT|HSE|HOUSE|NORTH|SOUTH|EAST|WEST|SAINT|MOUNT|ST|MT|NO"
PREFIXES = {w.lower(): w for w in ("SAINT", "MOUNT", "NORTH", "SOUTH", "EAST", "WEST")}
_VOCABULARY = rf"^({'|'.join(KINDS.values())}|{OTHER_WORDS}|.{{1,3}}|\d+)$"


def _first_of(text: Column, words: dict[str, str], pattern: str) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern.format(w)), F.lit(k)) for k, w in words.items()])


def _named(df: DataFrame, name: str) -> DataFrame:
    """df with words, stem (the longest word that is no kind of station), kind, prefix and place number of a name."""
    text = F.regexp_replace(F.upper(name), r"['’.]|\s*/\s*\w+\s*$", "")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    for short, long in (("N", "NORTH"), ("S", "SOUTH"), ("E", "EAST"), ("W", "WEST"), ("ST", "SAINT"), ("MT", "MOUNT")):
        text = F.regexp_replace(text, rf"^{short} ", f"{long} ")
    df = df.withColumn("_text", F.when(text != "", text))
    words = F.split("_text", " ")
    proper = F.filter(words, lambda w: ~w.rlike(_VOCABULARY))
    longest = lambda ws: F.element_at(F.array_sort(ws, lambda a, b: F.length(b) - F.length(a)), 1)
    number = F.regexp_extract("_text", r"(?:^| )(\d{1,3}(?: [NSEW]{1,3})?|NO \d+)(?= |$)", 1)
    cut = F.regexp_extract("_text", r" (NO)$", 1)  # a number lost with the end of the name
    return df.withColumns(
        {
            "words": F.filter(words, lambda w: F.length(w) > 3),
            "stem": F.when(F.size(proper) > 0, longest(proper)).otherwise(longest(words)),
            "kind": _first_of(F.col("_text"), KINDS, r" ({0})( |$)|^({0}) "),
            "prefix": _first_of(F.col("_text"), PREFIXES, r"^({0}) "),
            "number": F.regexp_replace(F.coalesce(F.nullif(number, F.lit("")), F.nullif(cut, F.lit(""))), r"^NO (\d+)$", "$1 NO"),
        }
    ).drop("_text")


def _ids(pattern: str, *columns: str) -> Column:
    """All distinct matches of a pattern's first group in the columns."""
    found = [F.coalesce(F.regexp_extract_all(F.upper(c), F.lit(pattern), 1), F.array().cast("array<string>")) for c in columns]
    return F.array_distinct(F.concat(*found))


def stations(master: DataFrame) -> DataFrame:
    """What is compared of the master list: ncei_id, name parts, st, lat, lon, elev, icaos, wbans."""
    df = master.select(
        "ncei_id", F.col("station_name").alias("name"), F.upper(F.trim("state")).alias("st"),
        F.col("lat_dec").alias("lat"), F.col("lon_dec").alias("lon"), F.col("elev_m").alias("elev"),
        _ids(r"\b([A-Z][A-Z0-9]{3})\b", "icao_ids").alias("icaos"),
        F.array_union(_ids(r"\b(\d{5})\b", "wban_ids"), _ids(r"USW\d{3}(\d{5})\b", "ghcnd_ids")).alias("wbans"),
    )
    return _placed(_named(df, "name"))


def entries(history: DataFrame) -> DataFrame:
    """The same of the history list, by hist_id. Ids that mean none are left out; a wban's lost leading zeros are restored."""
    icao = F.upper(F.trim("icao"))
    wban = F.trim("wban")
    one = lambda c, ok: F.when(ok, F.array(c)).otherwise(F.array().cast("array<string>"))
    df = history.select(
        "hist_id", F.col("station_name").alias("name"), F.upper(F.trim("st")).alias("st"),
        "lat", "lon", F.col("elev_m").alias("elev"),
        one(icao, icao.rlike("^[A-Z][A-Z0-9]{3}$")).alias("icaos"),
        one(F.lpad(wban, 5, "0"), wban.rlike(r"^\d{1,5}$") & ~wban.isin("99999", "0", "00000")).alias("wbans"),
    )
    return _placed(_named(df, "name"))


def _placed(df: DataFrame) -> DataFrame:
    """df with lat and lon as doubles, both NULL where they are no place, NaN elevations and blank states NULL."""
    lat, lon, elev = F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("elev").cast("double")
    ok = has_place(lat, lon)
    return df.withColumns(
        {"lat": F.when(ok, lat), "lon": F.when(ok, lon), "elev": F.when(~F.isnan(elev), elev), "st": F.nullif("st", F.lit(""))}
    )


def _curve(lat: Column, lon: Column, shift: float) -> Column:
    """A place on a Z-curve of cells of about 40 m, as text that sorts; shift moves the curve's seams, in degrees.

    The longitude runs round from 0 to 360, so two shifts have their seams at different meridians.
    """
    bits = 20
    x = F.floor(F.pmod(lon + F.lit(180.0 + shift), F.lit(360.0)) / 360.0 * (1 << bits)).cast("bigint")
    y = F.floor((lat + F.lit(90.0 + shift)) / 360.0 * (1 << bits)).cast("bigint")
    z = reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("bigint")), 2 * i + k)
            for i in range(bits)
            for k, v in enumerate((x, y))
        ],
    )
    return F.lpad(F.hex(z), 12, "0")


def _sorted_rows(df: DataFrame, key: str, side: int) -> DataFrame:
    """(order, at, side, id): a row for each key of each record; a record without a value has no place in that order."""
    rest = F.concat_ws(" ", F.coalesce("number", F.lit("")), F.coalesce("kind", F.lit("")))
    keys = [
        F.array(F.concat_ws(" ", "stem", F.coalesce("st", F.lit("")), rest)),
        F.array(F.concat_ws(" ", F.reverse("stem"), rest, F.coalesce("st", F.lit("")))),
        F.array(_curve(F.col("lat"), F.col("lon"), 0.0)),
        F.array(_curve(F.col("lat"), F.col("lon"), 31.7)),
        F.col("icaos"),
        F.col("wbans"),
    ]
    present = [F.col("stem").isNotNull()] * 2 + [F.col("lat").isNotNull()] * 2 + [F.lit(True)] * 2
    found = F.flatten(
        F.array(*[
            F.transform(F.when(p, k).otherwise(F.array().cast("array<string>")), lambda v, n=n: F.struct(F.lit(n).alias("order"), v.alias("at")))
            for n, (k, p) in enumerate(zip(keys, present))
        ])
    )
    return df.select(F.col(key).cast("string").alias("id"), F.explode(found).alias("x")).select(
        "x.order", "x.at", F.lit(side).alias("side"), "id"
    )


def candidates(left: DataFrame, right: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ncei_id, hist_id) as text: the pairs whose ranks lie within the window in any order, once each.

    The rank is counted among stations only. Rows are sorted by range over all
    partitions and numbered from the partitions' counts, so no order is ever
    brought together in one task.
    """
    rows = _sorted_rows(left, "ncei_id", 0).unionByName(_sorted_rows(right, "hist_id", 1))
    by = ["order", "at", "side", "id"]
    rows = materialise(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("part").agg(F.count_if(F.col("side") == 0).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.withColumn("rank", F.sum((F.col("side") == 0).cast("bigint")).over(upto))
        .join(F.broadcast(offsets), "part")
        .select("order", "side", "id", (F.col("rank") + F.col("offset")).alias("rank"))
    )
    ranked = materialise(ranked)
    block = lambda r: F.floor(r / F.lit(window)).cast("bigint")
    m = ranked.where("side = 0").select("order", F.col("id").alias("ncei_id"), F.col("rank").alias("mr"), block(F.col("rank")).alias("block"))
    h = ranked.where("side = 1").select("order", F.col("id").alias("hist_id"), F.col("rank").alias("hr")).withColumn(
        "block", F.explode(F.sequence(block(F.col("hr") - window), block(F.col("hr") + window)))
    )
    near = (F.col("mr") > F.col("hr") - window) & (F.col("mr") <= F.col("hr") + window)
    return h.join(m, ["order", "block"]).where(near).select("ncei_id", "hist_id").distinct()


def _weight() -> Column:
    """log2 odds of a pair m, h by all that both have."""
    m, h = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"h.{c}"))
    # the distance of a missing place isn't NULL but 0
    km = F.when(m("lat").isNotNull() & h("lat").isNotNull(), great_circle_km(m("lat"), m("lon"), h("lat"), h("lon")))
    place = (
        F.when(km.isNull(), 0.0).when(km <= 0.8, 6.5).when(km <= 1.6, 5.5).when(km <= 3, 3.0).when(km <= 8, 0.5)
        .when(km <= 30, -2.0).when(km <= 100, -4.0).otherwise(-8.0)
    )
    # a sign left out, most often that of western longitudes
    mirrored = great_circle_km(F.abs(m("lat")), F.abs(m("lon")), F.abs(h("lat")), F.abs(h("lon")))
    place = F.when((km > 100) & (mirrored <= 1.6), 4.0).otherwise(place)
    letters = lambda c: F.array_sort(F.split(c, ""))
    # a pair of letters changed about is one slip
    slips = lambda w: F.when((F.levenshtein(w, m("stem")) == 2) & (letters(w) == letters(m("stem"))), 1).otherwise(
        F.levenshtein(w, m("stem"))
    )
    off = F.array_min(F.transform(F.array_union(h("words"), F.array(h("stem"))), slips))
    name = (
        F.when(off.isNull(), 0.0).when(off == 0, 8.0).when(off == 1, 5.5).when((off == 2) & (F.length(m("stem")) > 6), 2.5)
        .when(off <= 3, -1.5).otherwise(-7.0)
    )
    named = h("stem").isNotNull() & m("stem").isNotNull()

    def part(c: str, same: float, one: float, other: float) -> Column:
        a, b = m(c), h(c)
        return F.when(~named | (a.isNull() & b.isNull()), 0.0).when(a == b, same).when(a.isNull() | b.isNull(), one).otherwise(other)

    cut = F.coalesce(m("number").startswith(h("number")), F.lit(False)) & (m("number") != h("number"))
    no = (h("number") == "NO") & m("number").endswith("NO")
    number = F.when(named & (cut | F.coalesce(no, F.lit(False))), 1.5).otherwise(part("number", 4.0, -2.5, -5.0))

    def shared(c: str, same: float, other: float) -> Column:
        return F.when((F.size(m(c)) == 0) | (F.size(h(c)) == 0), 0.0).when(F.arrays_overlap(m(c), h(c)), same).otherwise(other)

    st = F.when(m("st").isNull() | h("st").isNull(), 0.0).when(m("st") == h("st"), 1.0).otherwise(-7.0)
    feet = lambda a, b: F.when(F.abs(a) > 10, F.abs(a * 3.28084 - b))
    d = F.least(F.abs(m("elev") - h("elev")), feet(m("elev"), h("elev")) / 2, feet(h("elev"), m("elev")) / 2)
    elev = F.when(d.isNull(), 0.0).when(d <= 5, 3.0).when(d <= 15, 1.0).when(d <= 100, -0.5).otherwise(-1.0)
    parts = [place, name, number, part("kind", 3.0, -2.5, -4.5), part("prefix", 2.0, -2.0, -3.0), st, elev]
    return reduce(lambda a, b: a + b, [*parts, shared("icaos", 6.0, -1.5), shared("wbans", 6.0, -1.5)])


def scored(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ncei_id, hist_id, weight) of pairs of ids given as text."""
    return (
        pairs.alias("p")
        .join(left.alias("m"), F.col("p.ncei_id") == F.col("m.ncei_id").cast("string"))
        .join(right.alias("h"), F.col("p.hist_id") == F.col("h.hist_id").cast("string"))
        .select("m.ncei_id", "h.hist_id", _weight().alias("weight"))
    )


def assign(weights: DataFrame, least: float = 0.5) -> DataFrame:
    """(ncei_id, hist_id, confidence): for each entry its likeliest station, if its confidence is at least `least`.

    Of stations alike in weight the one with the lowest id.
    """
    odds = F.pow(F.lit(2.0), F.col("weight") - F.lit(NO_STATION))
    best = weights.groupBy("hist_id").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "ncei_id")).alias("b"), F.sum(odds).alias("all")
    )
    share = F.pow(F.lit(2.0), -F.col("b.w") - F.lit(NO_STATION)) / (F.col("all") + 1)
    return best.select("b.ncei_id", "hist_id", share.alias("confidence")).where(F.col("confidence") >= least)


def match(master: DataFrame, history: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ncei_id, hist_id, confidence): the master station of each history entry that has one.

    Keys are the lists' own, each taken as unique; a row repeated in either counts
    once. Anything else may be missing, abbreviated, misspelt or wrong.
    """
    left = materialise(stations(master.dropDuplicates(["ncei_id"])))
    right = materialise(entries(history.dropDuplicates(["hist_id"])))
    return assign(scored(left, right, candidates(left, right, window)))
