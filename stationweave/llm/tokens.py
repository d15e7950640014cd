"""Token ids and token counts of a corpus under a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoder import TOKENIZERS, VOCABULARY, encoder


def _path(tokenizers: str, vocabulary: str) -> str:
    return f"{tokenizers.rstrip('/')}/{vocabulary}"


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(key, ids): the token ids of every row's whole text, without special tokens.

    NULL and empty texts have the empty list. Strings that look like special
    tokens are ordinary text. A repeated row gives a repeated result. No shuffle:
    texts stay where they are read; other columns are never looked at.
    """
    path = _path(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            flat, counts = e.encode(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    tokenizers: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The columns `keep` and n_tokens, the number of token ids of each row's text; 0 for NULL and empty texts."""
    path = _path(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = e.count(b.column(b.num_columns - 1).to_pylist())
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, type=pa.int64())], names=[*names, "n_tokens"])

    kinds = dict(docs.dtypes)
    names = [f"c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, keep)) + ", n_tokens bigint"
    out = docs.select(*[docs[c].alias(n) for n, c in zip(names, keep)], text).mapInArrow(run, schema)
    return out.toDF(*keep, "n_tokens")
