"""Words and n-grams of Arrow text columns as numpy arrays, and their 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are turned into arrays together; one longer text is a piece of its own
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and its inverse, made where they are used."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grown = [np.full(max(n, PIECE + 1), base, np.uint64) for base in (BASE, _INVERSE)]
            for powers in grown:
                powers[0] = 1
            self.up, self.down = (np.multiply.accumulate(powers) for powers in grown)
        return self.up, self.down


_POWERS = _Powers()

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTES = np.arange(256)
#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] on lower-cased text: digits, letters, all beyond ASCII
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: Word bytes of the class [^\x20\x09-\x0D]
NOT_SPACE = (_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13))


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = True, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) in pieces; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = b"" if data is None else memoryview(data)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + piece, "right")) - 1)
        raw = bytes(data[offsets[low] : offsets[high]])
        if lower:
            raw = raw.translate(LOWER)
        yield low, high, np.frombuffer(raw, np.uint8), offsets[low : high + 1] - offsets[low]
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of the words, and the index of each text's first word."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    fresh[heads] = inside[heads]
    done = inside.copy()
    done[:-1] &= ~inside[1:] | fresh[1:]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(done) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the fingerprint of every byte span follows."""
    _, inverse = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=sums[1:])
    return sums


def span_prints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans: equal spans have equal ones wherever they stand."""
    power, _ = _POWERS.upto(len(sums))
    return mixed((sums[ends] - sums[starts]) * power[starts] + (ends - starts).astype(np.uint64))


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_prints(prefix_sums(data), starts, ends)


def gram_prints(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n consecutive words, one per position (n - 1 fewer than words)."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(3) + words[i : i + len(out)] + np.uint64(i + 1))
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text number of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
