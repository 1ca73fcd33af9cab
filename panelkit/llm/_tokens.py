"""Words of Arrow string columns as numpy arrays: where each word starts and ends, and a 64-bit hash of its bytes.

The buffers of a record batch are read in place. A word's bytes are taken eight at a time, and each eight are mixed into
its hash by a non-linear bijection; the length takes part. Words above ``LONG`` bytes are hashed by BLAKE2b. So the cost
is a few vector operations per word, and words of special structure (repeats, swaps, doubled patterns, which collide
under a polynomial modulo 2**64 in any odd base) are as far apart as any others: unequal words, not made to collide by
someone who solves for it, share a hash about once in 2**64 pairs. Runs of words are hashed by doubling, likewise mixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one pass of the tokenizer takes at once; a longer word extends its pass.
BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
_ODD = 0x9E3779B97F4A7C15

#: ``lut[byte]``: 0 for a separator, else the value hashed for that byte.
BLANK_WORDS = np.arange(1, 257, dtype=np.uint16)
BLANK_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
BLANK_WORDS_LOWER = BLANK_WORDS.copy()
BLANK_WORDS_LOWER[0x41:0x5B] = BLANK_WORDS[0x61:0x7B]
LETTER_WORDS_LOWER = np.zeros(256, dtype=np.uint16)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    LETTER_WORDS_LOWER[_a:_b] = np.arange(_a, _b) + 1
LETTER_WORDS_LOWER[0x41:0x5B] = LETTER_WORDS_LOWER[0x61:0x7B]

def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows behind one another, and where each row starts, with the end last. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, hashes, first``: byte spans and hashes of all words in order; ``first[i]`` is the first word of row i."""
    n = len(data)
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < n:
        hi = min(lo + BLOCK, n)
        while hi < n and not (row_start[hi] or lut[data[hi]] == 0):  # to the end of the word that is cut
            probe = data[hi : hi + 65536]
            stop = np.flatnonzero((lut[probe] == 0) | row_start[hi : hi + len(probe)])
            hi += int(stop[0]) if len(stop) else len(probe)
        value = lut[data[lo:hi]]
        inside = value != 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | row_start[lo + 1 : hi]
        closes[:-1] &= ~inside[1:] | row_start[lo + 1 : hi]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        parts.append((s + lo, e + lo, _word_hashes((value - 1).astype(np.uint8), s, e)))
        lo = hi
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts, ends, hashes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return starts, ends, hashes, np.searchsorted(starts, offsets, side="left")


def _word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that aren't empty."""
    size = ends - starts
    padded = np.zeros(len(folded) + 8, dtype=np.uint8)
    padded[: len(folded)] = folded
    eight = np.ndarray(shape=(len(folded) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64) * np.uint64(_ODD))
    some = np.flatnonzero(size <= LONG)
    at, left = starts[some], size[some]
    while len(some):
        block = eight[at]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[some] = mix((out[some] ^ block) * np.uint64(_ODD))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(folded[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (one for each start at which the run fits).

    Runs of 1, 2, 4, … words are put together from two halves; ``size`` is put together from these by its binary digits.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, half, width = None, 0, hashes, 1
    while True:
        if size & width:
            own = half[done : done + n]
            out, done = (mix(own) if out is None else mix(mix(out) + own)), done + width
        if done == size:
            return out
        half = mix(mix(half[:-width]) + half[width:])
        width *= 2
