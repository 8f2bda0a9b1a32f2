"""Several values packed in one field: one row per value, with its place in the field.

Works on the UTF-8 buffers of whole Arrow batches: quote parity and delimiter masks are computed over all bytes
of a batch at once, child offsets are derived from them, a list array is built and flattened with its parents'
ordinals. Only rows whose quotes don't balance are read character by character.

Notation read:
- separators `|`, `;`, `,`, `•`, line break, tab, and `/` between spaces; they may be mixed in one field;
- a value may be enclosed in double or single quotes, and then hold separators; a doubled quote inside is one quote;
- a bracketed list, as JSON or as Python repr, with backslash escapes; there only the comma separates;
- an apostrophe or quote within a value that doesn't start with it is part of the value.

Defined cases: null, empty and blank fields, and the word NONE in any case, give no row; empty parts are no values
and take no place; repeated values count each time; a quote that is never closed is an ordinary character.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from quern import runtime

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in "|;,\n\t"]] = True
_WIDE_SPACE = "[\u0085   -​    　﻿]"
_ENDS = " \t\n\r\x0b\x0c\u0085             ​    　﻿"


def _unescape(text: str, quote: str) -> str:
    for read in (json.loads, ast.literal_eval) if quote == '"' else (ast.literal_eval,):
        try:
            return read(quote + text + quote)
        except (ValueError, SyntaxError):
            pass
    return text


def scan_one(field: str) -> list[str]:
    """The values of one field, read character by character: the definition, and the way for unbalanced quotes."""
    s = field.strip(_ENDS)
    if not s or s.lower() == "none":
        return []
    listed = len(s) > 1 and s[0] == "[" and s[-1] == "]"
    if listed:
        s = s[1:-1]

    def is_cut(i: int) -> bool:
        if listed:
            return s[i] == ","
        return s[i] in "|;,\n\t•" or s[i] == "/" and (i == 0 or s[i - 1] in _ENDS) and (i + 1 == len(s) or s[i + 1] in _ENDS)

    def closing(start: int) -> int:
        """Where the quote opened at start closes; -1 if it doesn't."""
        i, q = start + 1, s[start]
        while i < len(s):
            if listed and s[i] == "\\":
                i += 2
                continue
            if s[i] == q:
                if i + 1 < len(s) and s[i + 1] == q:
                    i += 2
                    continue
                j = i + 1
                while j < len(s) and s[j] in _ENDS and not is_cut(j):
                    j += 1
                if j == len(s) or is_cut(j):
                    return i
            i += 1
        return -1

    values, i, begin = [], 0, 0
    while i <= len(s):
        if i < len(s) and s[i] in "\"'" and not s[begin:i].strip(_ENDS) and (end := closing(i)) > 0:
            i = end + 1
            continue
        if i == len(s) or is_cut(i):
            part = s[begin:i].strip(_ENDS)
            if len(part) > 1 and part[0] in "\"'" and part[-1] == part[0]:
                q, part = part[0], part[1:-1]
                part = _unescape(part, q) if listed and "\\" in part else part.replace(q + q, q)
            part = part.strip(_ENDS)
            if part and part.lower() != "none":
                values.append(part)
            begin = i + 1
        i += 1
    return values


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def scan_batch(fields: pa.Array) -> pa.ListArray:
    """The values of each field of a batch, as one list array."""
    fields = pc.fill_null(fields.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(fields, _WIDE_SPACE).to_numpy(zero_copy_only=False)
    n = len(fields)
    offsets = np.frombuffer(fields.buffers()[1], np.int64, n + 1, fields.offset * 8).astype(np.int64)
    data = np.frombuffer(fields.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size, lens = len(data), np.diff(offsets)
    if not size:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    row = np.repeat(np.arange(n), lens)
    space = _SPACE[data]
    # bracketed lists: outer brackets become blanks, and only the comma separates
    solid = np.flatnonzero(~space)
    srow = row[solid]
    lead = np.flatnonzero(np.diff(srow, prepend=-1) != 0)
    tail = np.append(lead[1:], len(solid))[: len(lead)] - 1
    listed = np.zeros(n, bool)
    brackets = (data[solid[lead]] == 91) & (data[solid[tail]] == 93) & (tail > lead)
    listed[srow[lead[brackets]]] = True
    in_list = listed[row]
    space[solid[lead[brackets]]] = True
    space[solid[tail[brackets]]] = True
    # separators, before quotes are known
    edge_before = np.zeros(size, bool)
    edge_before[offsets[:-1][lens > 0]] = True
    edge_after = np.zeros(size, bool)
    edge_after[offsets[1:][lens > 0] - 1] = True
    before = np.concatenate(([True], space[:-1])) | edge_before
    after = np.concatenate((space[1:], [True])) | edge_after
    sep = np.where(in_list, data == 44, _SEPARATOR[data] | (data == 47) & before & after)
    if (data == 0xE2).any():  # the bullet's three bytes
        bullet = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0xA2) & ~in_list[:-2])
        for k in range(3):
            sep[bullet + k] = True
    # quotes that open or close a value: only blanks between them and a separator or an end of the field
    at = np.arange(size)
    quote = (data == 34) | (data == 39)
    slash = data == 92
    if slash.any():
        run = at - np.maximum.accumulate(np.where(slash, -1, at))
        quote &= ~(in_list & (np.concatenate(([0], run[:-1])) % 2 == 1) & ~edge_before)
    # a quote after an opening quote or before a closing one is plain text, so neighbours that count are not blank
    plain = ~space | sep
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(plain, at, -1))[:-1]))
    nxt = np.concatenate((np.minimum.accumulate(np.where(plain, at, size)[::-1])[::-1][1:], [size]))
    opens = quote & ((last < offsets[row]) | sep[np.maximum(last, 0)])
    closes = quote & ((nxt >= offsets[row + 1]) | sep[np.minimum(nxt, size - 1)])
    double, single = quote & (data == 34), quote & (data == 39) & (opens | closes)
    base = offsets[row]

    def parity(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks)))
        return (total[1:] - total[base]) % 2 == 1

    in_double, in_single = parity(double), parity(single)
    # rows that parity can't settle: a quote left open, both kinds crossing, or an edge quote in the wrong place
    wrong = (single & in_double) | (single & in_single & ~opens) | (single & ~in_single & ~closes) | (opens & closes & quote)
    wrong |= double & in_double & ~opens & ~in_single & (np.concatenate(([0], data[:-1])) != 34)
    wrong |= double & ~in_double & ~closes & ~in_single & (np.concatenate((data[1:], [0])) != 34)
    odd |= _per_row(wrong, offsets) > 0
    odd |= (_per_row(double, offsets) % 2 == 1) | (_per_row(single, offsets) % 2 == 1)
    cut = sep & ~in_double & ~in_single
    # segments between cuts; the first and last non-blank byte of each that has any
    segment = np.cumsum(np.concatenate(([True], cut[:-1])) | edge_before)
    keep = np.flatnonzero(~space & ~cut & ~odd[row])
    kseg = segment[keep]
    lead = np.flatnonzero(np.diff(kseg, prepend=-1) != 0)
    first = keep[lead]
    final = keep[np.append(lead[1:], len(keep))[: len(lead)] - 1] if len(lead) else first
    quoted = (final > first) & (data[first] == data[final]) & ((data[first] == 34) | (data[first] == 39)) & opens[first] & closes[final]
    mark = data[first]
    parent = row[first]
    begin, end = first + quoted, final + 1 - quoted
    width = end - begin
    shift = np.concatenate(([0], np.cumsum(width)))
    gather = np.repeat(begin - shift[:-1], width) + np.arange(shift[-1])
    values = pa.LargeStringArray.from_buffers(len(width), pa.py_buffer(shift.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[gather])))
    special = quoted & ((_per_row((data == 92) | (data == 34) | (data == 39), np.append(begin, size)) > 0) if len(begin) else quoted)
    if special.any():
        where = np.flatnonzero(special)
        fixed = []
        for i, text in zip(where, values.take(pa.array(where)).to_pylist()):
            q = chr(mark[i])
            fixed.append(_unescape(text, q) if listed[parent[i]] and "\\" in text else text.replace(q + q, q))
        values = pc.replace_with_mask(values, pa.array(special), pa.array(fixed, pa.large_string()))
    values = pc.utf8_trim(values, characters=_ENDS)
    good = pc.and_(pc.not_equal(values, ""), pc.not_equal(pc.utf8_lower(values), "none")).to_numpy(zero_copy_only=False)
    values, parent = values.filter(pa.array(good)), parent[good]
    if odd.any():
        rows = np.flatnonzero(odd)
        lists = [scan_one(x) for x in fields.take(pa.array(rows)).to_pylist()]
        parent = np.concatenate((parent, np.repeat(rows, [len(x) for x in lists]))).astype(np.int64)
        values = pa.concat_arrays([values, pa.array([v for x in lists for v in x], pa.large_string())])
        order = np.argsort(parent, kind="stable")
        parent, values = parent[order], values.take(pa.array(order))
    counts = np.bincount(parent, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values.cast(pa.string()))


def unpack_field(df: DataFrame, id_col: str, field: str, pos: str = "pos", val: str = "val") -> DataFrame:
    """One row (id, pos, val) for each value of the field. A narrow pass without a shuffle; the id may be null or
    repeated, and other columns of df, whatever their names, are not read."""
    runtime.ship(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(pos, T.LongType()), T.StructField(val, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = scan_batch(b.column(1))
            parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[:-1]
            ordinal = np.arange(len(parents)) - starts[parents] + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(parents)), pa.array(ordinal.astype(np.int64)), lists.flatten()], names=[id_col, pos, val])

    return df.select(id_col, field).mapInArrow(run, schema)
