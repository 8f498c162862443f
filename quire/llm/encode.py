"""Encoding of a corpus with a public tokenizer, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import VOCABULARY, pieces, tokenizer

#: Ids after which a batch is handed on, which bounds a worker's memory whatever the texts' lengths.
BATCH_IDS = 1_000_000


def encode(df: DataFrame, key: str, text: str, *, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): every row's token ids without special tokens.

    Null and empty texts give an empty list. Rows that repeat give as many rows; the key may be
    null. A map over the rows as they lie: no shuffle, and a text is encoded piece by piece, so a
    very long one costs time in proportion to its length.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            flat, ends, size, begun = [], [0], 0, 0
            for i in range(len(texts)):
                value = texts[i].as_py()
                if value:
                    flat.append(b"".join(bpe.encode_pieces(pieces(value))))
                    size += len(flat[-1]) // 4
                ends.append(size)
                if size >= BATCH_IDS or i == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(b"".join(flat), np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, i + 1 - begun), ids], ["key", "ids"])
                    flat, ends, size, begun = [], [0], 0, i + 1

    picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, *, path: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of each list of ids; null for null, '' for an empty list."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType())])
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)
