"""Words of whole Arrow batches at once, and names of 128 bits for them and their sequences, in numpy.

A text is split at single bytes (every separator is ASCII), so UTF-8 needs no decoding. Windows of any length
are named by doubling, in as many steps as the length has bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Separators `[\x20\x09-\x0D]` of a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_BYTES = LOWER.tobytes()

def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over each other (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each of some things, of 128 bits in two parts.
Names = tuple[np.ndarray, np.ndarray]
#: Words up to so many bytes are their own names.
WHOLE = 15
_LOW, _HIGH = (np.array([(1 << 8 * min(max(n - k, 0), 8)) - 1 for n in range(WHOLE + 1)], np.uint64) for k in (0, 8))
_TOP = np.uint64(56)


def followed(a: Names, b: Names) -> Names:
    """Names of sequences whose first parts are named a and second parts b; no algebra relates them to their parts'."""
    x = mix(a[0] * np.uint64(0x9E3779B97F4A7C15) + b[0])
    y = mix((a[1] * np.uint64(0xD6E8FEB86659FD93) + b[1]) ^ x)
    return x, y


def windows(names: Names, width: int) -> Names:
    """Names of all runs of `width` neighbours, by runs of doubled length of which the last two may overlap."""
    have = 1
    while have < width:
        step = min(have, width - have)
        n = max(len(names[0]) - step, 0)
        names = followed((names[0][:n], names[1][:n]), (names[0][step:], names[1][step:]))
        have += step
    return names


class Words:
    """The words of a run of texts: byte spans in buf, and for text i the words first[i]:first[i + 1]."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        n = len(texts)
        offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.buf = LOWER[raw] if lower else raw
        inside = ~separators[self.buf]
        begins, stops = inside.copy(), inside.copy()
        if len(raw):
            cut = np.zeros(len(raw) + 1, bool)
            cut[self.offsets] = True
            begins[1:] &= ~inside[:-1] | cut[1:-1]
            stops[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def names(self) -> Names:
        """A word of up to WHOLE bytes is its own name, with its length; a longer one's is 120 bits of its BLAKE2b digest.

        Different short words never have one name. The names are spread by a bijection.
        """
        size = self.ends - self.starts
        padded = np.concatenate([self.buf, np.zeros(16, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, 16)[self.starts].view("<u8")
        short = np.minimum(size, WHOLE)
        low, high = rows[:, 0] & _LOW[short], rows[:, 1] & _HIGH[short] | short.astype(np.uint64) << _TOP
        for k in np.flatnonzero(size > WHOLE).tolist():
            got = blake2b(self.buf[self.starts[k] : self.ends[k]], digest_size=16).digest()
            low[k], high[k] = int.from_bytes(got[:8], "little"), int.from_bytes(got[8:15], "little") | 0xFF << 56
        x = mix(low ^ np.uint64(0xA0761D6478BD642F))
        y = mix(high + x)
        return mix(x + y), y


def give_back() -> None:
    """Returns this process's freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc's only
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back: it stays for other stages, whose own comes on top."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text, which bounds the memory of numpy's arrays."""
    texts = batch.column(column)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not batch.num_rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + batch.num_rows + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
