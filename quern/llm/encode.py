"""Encoding of a whole corpus, and token counts, with a public byte-level tokenizer (see bpe)."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from quern import runtime
from quern.llm import bpe

#: Ids or rows after which a task hands on a batch.
_BATCH_IDS = 2_000_000


def _broadcast(df: DataFrame, vocabulary: str):
    """The vocabulary file's bytes (under 2 MB for the public ones) for the workers."""
    data = bpe.read_vocabulary(vocabulary)
    if len(data) > 32 << 20:
        raise ValueError(f"{vocabulary} has {len(data)} bytes; a vocabulary of at most 32 MB can be broadcast")
    runtime.ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(data)


def encode_texts(df: DataFrame, id_col: str, text_col: str, ids: str = "ids", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """One row (id, ids) for each row of df. A narrow pass without a shuffle; null and empty texts give an empty list,
    ids may be null or repeated, and other columns of df are not read."""
    shared = _broadcast(df, vocabulary)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_of(shared.value)
        gc.disable()  # millions of small cached objects, none in cycles
        try:
            for b in batches:
                start, found, total = 0, [], 0
                for i, text in enumerate(b.column(1)):
                    found.append(encoder.encode(text.as_py()))
                    total += len(found[-1])
                    if total > _BATCH_IDS or i + 1 == b.num_rows:
                        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(found)), lists], names=[id_col, ids])
                        start, found, total = i + 1, [], 0
        finally:
            gc.enable()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text_col: str, keep: list[str], n: str = "n_tokens", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """The columns of keep and the number of tokens of the text; 0 for null and empty texts."""
    shared = _broadcast(df, vocabulary)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(n, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_of(shared.value)
        gc.disable()
        try:
            for b in batches:
                counts = pa.array([encoder.count(x.as_py()) for x in b.column(len(keep))], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], counts], names=[*keep, n])
        finally:
            gc.enable()

    return df.select(*keep, text_col).mapInArrow(run, schema)
