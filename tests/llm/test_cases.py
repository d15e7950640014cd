"""NULLs, empty and very long texts, repeated rows, empty tables and extra columns with the operators' own names."""

import pytest
from pyspark.sql import functions as F
from stationweave.llm import entities, packing, splitting, tokens
from stationweave.llm.encoder import TOKENIZERS, VOCABULARY, encoder

LONG = "Rain gauge 12.5 mm, wind NW. " * 12_000  # 350,000 characters
DOCS = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (5, LONG), (6, "x" * 9000), (None, "no number"), (7, "\x00﻿​"), (8, "観測" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    return df.select("*", F.lit(9).alias("key"), F.lit(9).alias("ids"), F.lit(9).alias("piece"), F.lit("w").alias("source"), F.lit(9).alias("c0"), F.lit(9).alias("shard"), F.lit(9).alias("part"))


def test_encoding(spark, docs):
    e = encoder(f"{TOKENIZERS}/{VOCABULARY}")
    got = sorted(((r.doc_id or 0, len(r.ids)) for r in tokens.encode_corpus(docs).collect()))
    assert got == sorted((k or 0, int(e.count([t])[0])) for k, t in DOCS)
    text = next(r.ids for r in tokens.encode_corpus(docs).collect() if r.doc_id == 5)
    assert b"".join(e.vocabulary.token[i] for i in text).decode() == LONG
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_pieces(docs):
    rows = splitting.split_corpus(docs).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    texts = dict(DOCS)
    for k, pieces in of.items():
        pieces.sort(key=lambda r: (r.piece_no, r.char_from))
        assert all(r.n_tokens <= splitting.LIMIT for r in pieces)
        if k != 4:
            text, end = texts[k] or "", 0
            for r in pieces:
                assert r.char_from <= end and (texts[k] is None or r.piece == text[r.char_from : r.char_to])
                end = r.char_to
            assert end == len(text)
    assert of.keys() == texts.keys() and len(of[4]) == 2 and of[1][0].piece is None and len(of[5]) > 150
    assert splitting.split_corpus(docs.limit(0)).count() == 0


def test_packing(docs):
    lengths = tokens.count_tokens(docs, ["doc_id", "source"])
    rows = packing.pack_corpus(lengths.withColumn("size", F.lit(1)).withColumn("place", F.lit(1)), shard_tokens=20_000).collect()
    total, held = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        if r.container_id is not None:
            held[r.container_id] = held.get(r.container_id, 0) + r.size
    e = encoder(f"{TOKENIZERS}/{VOCABULARY}")
    want = {}
    for k, t in DOCS:
        want[k] = want.get(k, 0) + int(e.count([t])[0])
    assert total == want and max(held.values()) <= packing.CAPACITY


M = "ncei_id string, station_name string, state string, lat_dec double, lon_dec double, elev_m double, icao_ids string, wban_ids string, ghcnd_ids string"
H = "hist_id bigint, station_name string, st string, lat double, lon double, elev_m double, icao string, wban string"


def test_matching_of_nothing_and_of_the_same(spark):
    m = spark.createDataFrame([("a", "PELERDALE DAM", "KS", 38.0, -98.0, 200.0, "KAAA", "01001", None)] * 2 + [("b", None, None, None, None, None, None, None, None)], M)
    h = spark.createDataFrame([(1, "PELERDALE DAM", "KS", 38.0, -98.0, 200.0, "KAAA", "01001")] * 2 + [(2, None, None, None, None, None, None, None), (3, "", "", float("nan"), 0.0, 0.0, "", "99999")], H)
    more = lambda df: df.select("*", F.lit(1).alias("order"), F.lit(1).alias("words"), F.lit(1).alias("weight"), F.lit(1).alias("side"))
    found = [(r.ncei_id, r.hist_id) for r in entities.match(more(m), more(h)).collect()]
    assert found == [("a", 1)]
    assert entities.match(m.limit(0), h).count() == 0 and entities.match(m, h.limit(0)).count() == 0


def test_copies_of_a_station_tie_to_the_lowest_id(spark):
    m = spark.createDataFrame([(k, "PELERDALE DAM 7", "KS", 38.0, -98.0, 200.0, "KAAA", "01001", None) for k in ("b", "a")], M)
    h = spark.createDataFrame([(1, "PELERDALE DAM 7", "KS", 38.0, -98.0, 200.0, "KAAA", "01001")], H)
    w = entities.scored(entities.stations(m), entities.entries(h), spark.createDataFrame([("a", "1"), ("b", "1")], "ncei_id string, hist_id string"))
    assert [r.ncei_id for r in entities.assign(w, 0.0).collect()] == ["a"]
