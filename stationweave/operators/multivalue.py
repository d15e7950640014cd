"""Fields that hold several values: one value per row, with its place kept.

A dictionary of known whole values is searched in each field by a multi-pattern
automaton. Dynamic programming then covers the field with values and delimiters
at the highest score: a quoted stretch and a known value score far above a plain
run of characters, so a delimiter inside a legitimate value ("N/A",
"41994; old site") is not a cut.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary of at most so many values is sent to every task (about 40 MB as an automaton). A larger one is joined.
MAX_BROADCAST_VALUES = 200_000

# Fixed values of the field notations.
DELIMITERS = "|;,/+&\t\n\r、；，¦"
BLANKS = "  　"
WORD_DELIMITERS = ("and",)
QUOTES = {'"': '"', "'": "'", "“": "”"}
BRACKETS = {"[": "]", "{": "}", "(": ")"}
#: Whole values with a delimiter inside that every field may hold.
ALWAYS_KNOWN = ("N/A", "n/a", "N.A.")

QUOTED, KNOWN, PLAIN = 50.0, 3.0, 1.0

#: A field with none of these is a single value.
ANY_DELIMITER = r"[|;,/+&\t\n\r、；，¦  　]"


def _bare(text: str) -> tuple[int, int]:
    """Start and end of the text without blanks at its ends and an enclosing pair of brackets."""
    a, b = 0, len(text)
    while True:
        while a < b and (text[a] in BLANKS or text[a].isspace()):
            a += 1
        while b > a and (text[b - 1] in BLANKS or text[b - 1].isspace()):
            b -= 1
        if b - a >= 2 and BRACKETS.get(text[a]) == text[b - 1] and text.find(text[b - 1], a) == b - 1:
            a, b = a + 1, b - 1
            continue
        return a, b


def _delimiter_end(text: str, i: int, b: int) -> tuple[int, bool]:
    """End of the delimiter that starts at i (i if none), and whether it is more than blanks.

    Blanks beside a delimiter belong to it.
    """
    j = i
    while j < b and text[j] in BLANKS:
        j += 1
    if j < b and text[j] in DELIMITERS:
        j += 1
        while j < b and text[j] in BLANKS:
            j += 1
        return j, True
    if j > i:
        for w in WORD_DELIMITERS:
            k = j + len(w)
            if text[j:k].lower() == w and k < b and text[k] in BLANKS:
                while k < b and text[k] in BLANKS:
                    k += 1
                return k, True
        return j, False
    return i, False


def segment(text: str | None, known: Iterable[tuple[int, int]] = ()) -> list[str | None]:
    """The places of a field in order: a value, or None for an empty place between two delimiters.

    known: (start, end) of dictionary values found in the text; one counts only
    if it begins and ends at a delimiter, a quote or an end of the field. NULL,
    empty and blank fields, and a field of delimiters only, have no value.
    """
    if text is None:
        return []
    a, b = _bare(text)
    if a == b:
        return []
    spans: dict[int, list[tuple[int, float, str]]] = {}

    def at_start(i: int) -> bool:
        return i == a or text[i - 1] in DELIMITERS or text[i - 1] in BLANKS

    def at_end(j: int) -> bool:
        return j == b or text[j] in DELIMITERS or text[j] in BLANKS

    for i, j in known:
        if a <= i < j <= b and at_start(i) and at_end(j):
            spans.setdefault(i, []).append((j, KNOWN * (j - i), text[i:j]))
    # best[i]: (score, next cut, what), from the end; what is a value, or a delimiter as (is_explicit,)
    best: list[tuple[float, int, object]] = [(float("-inf"), b, None)] * (b + 1)
    best[b] = (0.0, b, None)
    for i in range(b - 1, a - 1, -1):
        options: list[tuple[float, int, object]] = []
        j, explicit = _delimiter_end(text, i, b)
        if j > i:
            options.append((best[j][0], j, (explicit,)))
        if at_start(i):
            for end, score, value in spans.get(i, ()):
                options.append((score + best[end][0], end, value))
            if (close := QUOTES.get(text[i])) and (k := text.find(close, i + 1)) > 0:
                while k != -1 and k < b and not at_end(k + 1):
                    k = text.find(close, k + 1)
                if k != -1 and k < b:
                    options.append((QUOTED * (k + 1 - i) + best[k + 1][0], k + 1, text[i + 1 : k]))
        if text[i] not in DELIMITERS and text[i] not in BLANKS:
            k = i + 1
            while k < b and text[k] not in DELIMITERS and text[k] not in BLANKS:
                k += 1
            options.append((PLAIN * (k - i) + best[k][0], k, text[i:k]))
        best[i] = max(options, key=lambda o: o[0])
    places: list[str | None] = []
    i, open_place = a, True
    while i < b:
        _, j, what = best[i]
        if isinstance(what, tuple):
            if what[0] or not open_place:
                if open_place:
                    places.append(None)
                open_place = True
        else:
            value = what.strip().strip("".join(QUOTES) + "".join(QUOTES.values())).strip()
            places.append(value or None)
            open_place = False
        i = j
    return places


def _automaton(values: Iterable[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, len(v))
    if len(a):
        a.make_automaton()
    return a


def _hits(automaton, text: str) -> list[tuple[int, int]]:
    return [(end + 1 - n, end + 1) for end, n in automaton.iter(text)] if len(automaton) else []


def _boundary_spans(text: str, longest: int) -> list[tuple[int, int, str]]:
    """The stretches between two boundaries of a field, as segment() sees them, of at most `longest` characters: the candidates of the join."""
    a, b = _bare(text)
    cut = set(DELIMITERS + BLANKS)
    starts = [i for i in range(a, b) if i == a or text[i - 1] in cut]
    ends = [j for j in range(a + 1, b + 1) if j == b or text[j] in cut]
    return [(i, j, text[i:j]) for i in starts for j in ends[bisect_right(ends, i) : bisect_right(ends, i + longest)]]


def split_fields(
    df: DataFrame, key: str, fields: list[str], dictionary: DataFrame, min_values: int = 2
) -> DataFrame:
    """(key, field_name, pos, id_value): one row per value of each field that holds at least min_values values.

    dictionary: one string column of known whole values, any number of rows;
    NULLs in it are ignored. Up to MAX_BROADCAST_VALUES distinct values go to the
    tasks as one automaton; beyond, the candidate stretches of the distinct
    fields are joined with the dictionary, with the same result.

    pos counts places from 1; an empty place between two delimiters takes a
    number and gives no row. Blanks beside a delimiter, repeated blanks, an
    enclosing pair of brackets and a delimiter at the very end make no place. A
    value given twice gives two rows, a repeated input row as well. NULL, empty
    and blank fields give no row. Other columns of df are never looked at.
    """
    spark = df.sparkSession
    long = df.select(
        F.col(key).alias("key"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])
        ).alias("x"),
    ).select("key", "x.*")
    if min_values > 1:  # decided before any row leaves the JVM
        long = long.where(F.trim("text").rlike(ANY_DELIMITER))
    else:
        long = long.where(F.trim("text") != "")
    words = dictionary.select(F.col(dictionary.columns[0]).cast("string").alias("value")).where(
        F.length("value") > 1
    ).distinct()
    held = [r[0] for r in words.limit(MAX_BROADCAST_VALUES + 1).collect()]
    if len(held) <= MAX_BROADCAST_VALUES:
        shared = spark.sparkContext.broadcast(sorted({*held, *ALWAYS_KNOWN}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(shared.value)
            for b in batches:
                yield _rows(b, [segment(t, _hits(automaton, t)) for t in b["text"]], min_values)

        out = long
    else:
        texts = long.select("text").distinct()
        # no known value is longer, so a field's candidates grow with its length, not with its square
        longest = max(int(words.agg(F.max(F.length("value"))).first()[0]), *map(len, ALWAYS_KNOWN))
        candidates = texts.mapInPandas(
            lambda bs: (
                pd.DataFrame([(t, i, j, v) for t in b["text"] for i, j, v in _boundary_spans(t, longest)], columns=["text", "i", "j", "value"])
                for b in bs
            ),
            "text string, i int, j int, value string",
        )
        always = spark.createDataFrame([(v,) for v in ALWAYS_KNOWN], "value string")
        found = (
            candidates.join(words.unionByName(always).distinct(), "value", "left_semi")
            .groupBy("text")
            .agg(F.collect_list(F.struct("i", "j")).alias("spans"))  # bounded by the field's own length
        )
        out = long.join(found, "text", "left").select("key", "field_name", "text", "spans")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                spans = [[(s["i"], s["j"]) for s in x] if x is not None else [] for x in b["spans"]]
                yield _rows(b, [segment(t, s) for t, s in zip(b["text"], spans)], min_values)

    kind = dict(df.dtypes)[key]
    return out.mapInPandas(run, f"key {kind}, field_name string, pos bigint, id_value string").withColumnRenamed(
        "key", key
    )


def _rows(b: pd.DataFrame, places: list[list[str | None]], least: int) -> pd.DataFrame:
    rows = [
        (k, f, n, v)
        for k, f, p in zip(b["key"], b["field_name"], places)
        if sum(v is not None for v in p) >= least
        for n, v in enumerate(p, 1)
        if v is not None
    ]
    return pd.DataFrame(rows, columns=["key", "field_name", "pos", "id_value"])
