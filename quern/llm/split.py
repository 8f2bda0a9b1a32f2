"""Splitting oversized texts at natural boundaries, with overlap.

Sizes are in tokens. A text's token ends are prefix sums over its tokens' bytes; its natural boundaries are sorted
arrays of byte positions that are token ends too. From the start of a piece, a binary search finds the last boundary
within the limit: of paragraphs, then lines, then sentences if it leaves a piece of at least half the limit, then of
words anywhere beyond the overlap; where there is none, a hard cut follows at the limit, never inside a character.
The next piece starts `overlap` tokens before that end, moved back to the start of a word (by at most 32 tokens, and a quarter of the limit).
Only where such a start leaves no room for a further character within the limit does a piece follow without overlap.

Every piece encodes to at most `limit` tokens by itself (for limits below 6 a piece of one character can have more); pieces cover the text without a gap. Defined cases: null and
empty texts give no piece; a text within the limit gives itself; ids may be null or repeated.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm import bpe
from quern.llm.encode import _broadcast

_SNAP = 32


def boundaries(data: np.ndarray) -> list[np.ndarray]:
    """Byte positions behind paragraphs, lines and sentences, and before words, each sorted."""
    n = len(data)
    at = np.arange(n)
    blank = (data == 32) | (data == 9) | (data == 13)
    newline = data == 10
    following = np.concatenate((data[1:], [10]))
    solid = np.where(~blank, at, -1)
    before = np.concatenate(([-1], np.maximum.accumulate(solid)[:-1])) if n else solid
    last_of_run = newline & (following != 10) & (following != 13)
    paragraph = last_of_run & (before >= 0) & newline[np.maximum(before, 0)]
    stop = (data == 46) | (data == 33) | (data == 63)
    gap = (following == 32) | (following == 10) | (following == 13) | (following == 9)
    sentence = np.flatnonzero(stop & gap) + 1
    if n > 2:
        wide = np.flatnonzero(((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)) | ((data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & ((data[2:] == 0x81) | (data[2:] == 0x9F)))) + 3
        sentence = np.union1d(sentence, wide)
    word = (blank | newline) & ~((following == 32) | (following == 9) | (following == 13) | (following == 10))
    word_at = np.flatnonzero(word)
    word_at = np.where(data[word_at] == 32, word_at, word_at + 1)
    return [np.flatnonzero(paragraph) + 1, np.flatnonzero(last_of_run) + 1, sentence, word_at]


def split_text(encoder: bpe.Encoder, text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of each piece of a text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    ids = encoder.encode(text)
    n = len(ids)
    if n <= limit:
        return [(0, len(text.encode("utf-8", "replace")), n)] if n else []
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(encoder.lengths[ids])  # ends[k]: bytes of the first k + 1 tokens
    levels = []
    for positions in boundaries(data):
        k = np.searchsorted(ends, positions)
        levels.append((k[(k < n) & (ends[np.minimum(k, n - 1)] == positions)] + 1).tolist())  # as numbers of tokens
    whole = np.concatenate(([True], (data[ends[:-1]] & 0xC0) != 0x80, [True]))  # token edges between characters

    def last(level: list[int], low: int, high: int) -> int:
        i = bisect_right(level, high) - 1
        return level[i] if i >= 0 and level[i] > low else 0

    def byte(k: int) -> int:
        return int(ends[k - 1]) if k else 0

    pieces, start, reached, snap = [], 0, 0, min(_SNAP, limit // 4)
    while True:
        room = limit
        while True:
            high = min(start + room, n)
            if high == n:
                end = n
            else:
                end = next((e for level in levels[:3] if (e := last(level, max(reached, start + max(overlap, limit // 2)), high))), 0)
                end = end or last(levels[3], max(reached, start + overlap + snap), high)
                if not end:
                    end = high
                    while not whole[end] and end > reached:
                        end -= 1
                    if end <= reached:  # the overlap leaves no room for a whole character: go on without one
                        start, room = reached, limit
                        end = next(k for k in range(reached + 1, n + 1) if whole[k])
                        if end - start < limit:
                            continue
            size = encoder.count(raw[byte(start) : byte(end)].decode("utf-8", "replace"))
            if size <= limit or not whole[start + 1 : end].any():
                break
            room = min(room, end - start) - (size - limit)
        pieces.append((byte(start), byte(end), size))
        if end == n:
            return pieces
        back = end - overlap
        reached = end
        snapped = last(levels[3], back - snap - 1, back) if overlap else 0
        back = snapped if snapped > start else back
        while back > start and not whole[back]:
            back -= 1
        start = back if back > start else end


def split_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    limit: int = 1024,
    overlap: int = 64,
    texts: bool = True,
    vocabulary: str = bpe.DEFAULT_VOCABULARY,
) -> DataFrame:
    """One row (id, piece, n_pieces, start_byte, end_byte, n_tokens[, piece_text]) for each piece of each text, in a
    narrow pass without a shuffle. texts=False leaves the piece's text out."""
    shared = _broadcast(df, vocabulary)
    fields = [df.schema[id_col], *(T.StructField(c, T.LongType(), False) for c in ("piece", "n_pieces", "start_byte", "end_byte", "n_tokens"))]
    schema = T.StructType(fields + [T.StructField("piece_text", T.StringType())] * texts)
    kinds = [None, *[pa.int64()] * 5, *[pa.string()] * texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_of(shared.value)
        names = [f.name for f in schema]
        gc.disable()
        try:
            for b in batches:
                rows, size = [], 0
                for i, value in enumerate(b.column(1)):
                    text = value.as_py()
                    if not text:
                        continue
                    pieces = split_text(encoder, text, limit, overlap)
                    raw = text.encode("utf-8", "replace") if texts else b""
                    for k, (x, y, m) in enumerate(pieces, 1):
                        rows.append((i, k, len(pieces), x, y, m, *[raw[x:y].decode("utf-8", "replace")] * texts))
                        size += (y - x) * texts
                    if size > 32 << 20:
                        yield _batch(b, rows, names, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(b, rows, names, kinds)
        finally:
            gc.enable()

    def _batch(b, rows, names, kinds):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:]))], names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1024, overlap: int = 64, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """The ids of the texts that had to be cut. A text of at most `limit` bytes can't have more tokens than that, and is
    passed over before the tokenizer."""
    large = df.where(F.octet_length(text_col) > limit)
    return split_texts(large, id_col, text_col, limit, overlap, False, vocabulary).where("piece = 2").select(id_col)
