"""Byte-level BPE by a public vocabulary, with a rank queue on a hierarchical bitmap.

Encoding runs at three levels. A text is cut at single blanks before a non-blank, where the vocabulary's pattern
always cuts too; each piece is looked up in a cache. An unknown piece is split by the pattern into pre-tokens, and
an unknown pre-token is merged by the rank queue: one bucket of linked-list positions per merge rank, a bitmap
of the ranks in use in words of 256 bits under a summary of the words in use, find-first-set for the next rank, entries whose pair has changed
skipped as stale. A pre-token of n bytes costs O(n log n) at most, whatever its length (the log is the sort of a
bucket), so long unbroken strings need no cut.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; every text can
be encoded, since each byte is a token.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import regex

#: Fixed value: the pre-token pattern that belongs to the public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes (about, with overheads) at which a worker empties a cache, and characters up to which a piece or pre-token is kept;
#: results don't depend on them.
CACHE_BYTES, CACHED_LENGTH = 96 << 20, 128
_ENTRY = 200  # bytes of an entry's objects beside its characters and ids
_BLANK_RUN, _CUT = re.compile(r" (?!\S)"), re.compile(r" (?=\S)")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pieces(dict):
    """Cache of pieces; an unknown piece is encoded on first look-up. Long ones, which hardly recur, are not kept, so
    texts without blanks fill no memory."""

    def __init__(self, encode, most: int = CACHE_BYTES) -> None:
        super().__init__()
        self.encode, self.most, self.held = encode, most, 0

    def __missing__(self, piece: str):
        found = self.encode(piece)
        if len(piece) <= CACHED_LENGTH:
            # a character takes up to four bytes in memory, and its ids up to sixteen
            self.held += _ENTRY + 4 * len(piece) + (len(found) if type(found) is bytes else 0)
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[piece] = found
        return found


class Encoder:
    def __init__(self, vocabulary: bytes) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in vocabulary.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.pattern = regex.compile(PATTERN)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)  # bytes of each id
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.pretokens = Pieces(lambda token: array("i", self.merge(token.encode("utf-8", "replace"))).tobytes())
        self.pieces = Pieces(self.encode_piece)
        self.counts = Pieces(lambda piece: len(self.pieces[piece]) // 4)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n, get = len(data), ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        stop = after[:]  # where the token at a position ends; 0 once merged away
        buckets: dict[int, list[int]] = {}  # rank -> positions of pairs that had it when entered
        words: dict[int, int] = {}  # rank >> 8 -> bits of the ranks in use
        top = 0  # bits of the words in use

        def push(rank: int, position: int) -> None:
            nonlocal top
            if rank in buckets:
                buckets[rank].append(position)
            else:
                buckets[rank] = [position]
                word = rank >> 8
                words[word] = words.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word

        for i in range(n - 1):
            if (rank := get(data[i : i + 2])) is not None:
                push(rank, i)
        while top:
            word = (top & -top).bit_length() - 1  # find first set, in the summary and in its word
            bits = words[word]
            low = bits & -bits
            rank = word << 8 | low.bit_length() - 1
            if bits == low:
                del words[word]
                top &= top - 1
            else:
                words[word] = bits ^ low
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                j = after[i]
                if not stop[i] or j >= n or get(data[i : stop[j]]) != rank:
                    continue  # stale
                stop[i], stop[j] = stop[j], 0
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (new := get(data[i : stop[k]])) is not None:
                        push(new, i)
                if (h := before[i]) >= 0 and (new := get(data[h : stop[i]])) is not None:
                    push(new, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : stop[i]]])
            i = after[i]
        return out

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece, as 32-bit integers."""
        tokens = self.pattern.findall(piece)
        if len(tokens) == 1 and len(piece) <= 64:
            return array("i", self.merge(piece.encode("utf-8", "replace"))).tobytes()
        return b"".join(map(self.pretokens.__getitem__, tokens))

    def cut(self, text: str) -> list[str]:
        """The text's pieces: cut before each blank that precedes a non-blank."""
        if "\0" in text:
            return [text]
        if _BLANK_RUN.search(text) is None:
            return text.replace(" ", "\0 ").split("\0")
        return _CUT.sub("\0 ", text).split("\0")

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.cut(text))), np.int32)

    def count(self, text: str | None) -> int:
        """len(encode(text)), without building the ids."""
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.cut(text)))


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: bytes) -> Encoder:
    """The worker's encoder of this vocabulary; kept between tasks."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


