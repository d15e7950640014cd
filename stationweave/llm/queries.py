"""The queries of the problems on texts and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import read
from . import entities, packing, splitting, tokens


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return entities.match(
        read(spark, d, "master_station_list", "ncei_id", "station_name", "state", "lat_dec", "lon_dec", "elev_m", "icao_ids", "wban_ids", "ghcnd_ids"),
        read(spark, d, "isd_history", "hist_id", "station_name", "st", "lat", "lon", "elev_m", "icao", "wban"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a master station and a history entry that describe the same station."""
    return _matched(spark, d).select("ncei_id", "hist_id")


def p7_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their confidence."""
    return _matched(spark, d).withColumn("confidence", F.round("confidence", 4))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode_corpus(read(spark, d, "documents", "doc_id", "text"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of 2048 tokens, mixed by source."""
    lengths = materialise(tokens.count_tokens(read(spark, d, "documents", "doc_id", "source", "text"), ["doc_id", "source"]))
    return packing.pack_corpus(lengths)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents in pieces of at most 512 tokens, each with up to 64 tokens of the one before."""
    return splitting.split_corpus(read(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p7_found, p7_confidence, p8_ids, p9_packed, p10_pieces)}

#: None of these can be stated in SQL; they are tested against other encoders, brute force and exact round trips.
ORACLE: dict[str, str] = {}
