"""64-bit hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_PIECE = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def lower_bytes() -> np.ndarray:
    """The byte values that make A-Z hash as a-z."""
    out = _BYTES.copy()
    out[65:91] = out[97:123]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and the offsets of each."""
    a = texts.cast(pa.large_binary())
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the number of words of each text.

    A word is a run of bytes other than 9-13 and 32 inside one text.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~_SEPARATOR[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = off[1:] > off[:-1]
    at = off[:-1][full]
    first[at] = word[at]
    at = off[1:][full] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """The hash of each span: a polynomial of its bytes' random values, mixed.

    Sums over prefixes make it one subtraction a span.
    """
    out = np.empty(len(starts), np.uint64)
    up = down = None
    k = 0
    while k < len(starts):
        base = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        size = int(ends[to - 1] - base)
        if up is None or len(up) < size + 1:
            most = max(size, min(_PIECE, len(data))) + 1
            up, down = _powers(_ODD, most), _powers(_ODD_INVERSE, most)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[k:to] - base, ends[k:to] - base
        out[k:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        k = to
    return out


def word_hashes(data: np.ndarray, off: np.ndarray, values: np.ndarray = _BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of words of each text."""
    starts, ends, counts = word_spans(data, off)
    return span_hashes(data, starts, ends, values), counts


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size, have, by, out, done = 1, h, _ODD, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = have, size
            else:  # have covers the words before out
                m = len(h) - done - size + 1
                out, done = have[:m] * np.uint64(pow(int(_ODD), done, 2**64)) + out[size : size + m], done + size
        if done == n:
            return mix(out)
        have = have[:-size] * by + have[size:]
        by = np.uint64(int(by) ** 2 % 2**64)
        size *= 2


def chunks(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text; one longer text stands alone."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
