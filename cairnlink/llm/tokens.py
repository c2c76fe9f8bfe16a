"""Words, their hashes and their windows for whole Arrow columns of texts, vectorised with NumPy.

A word is a maximal run of bytes of one class; both classes used here break at ASCII bytes only, so they may be applied
to UTF-8 bytes. A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_SPACES = [0x20, *range(0x09, 0x0E)]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACES] = False
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.array([chr(i).isalnum() or i >= 128 for i in range(128)] + [True] * 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, eight zero bytes after them
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # for each text its first word; one more at the end
    base: np.ndarray  # for each text its first byte; one more at the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, padded by eight, and the n+1 offsets of its values."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.zeros(high - low + 8, np.uint8)
    if high > low:
        data[:-8] = np.frombuffer(raw, np.uint8)[low:high]
    return data, (offsets - low if len(texts) else np.zeros(1, np.int64))


def find_words(texts: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    data, base = column_bytes(texts)
    if lower:
        data = _LOWER[data]
        data[-8:] = 0
    is_word = kind[data[:-8]]
    before = np.empty_like(is_word)
    before[1:] = is_word[:-1]
    after = np.empty_like(is_word)
    after[:-1] = is_word[1:]
    if len(is_word):
        before[0] = after[-1] = False
        edges = base[1:-1]
        inner = edges[(edges > 0) & (edges < len(is_word))]
        before[inner] = False
        after[inner - 1] = False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, base), base)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges of up to eight bytes and equal length never collide."""
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data.data, strides=(1,))
    left = end - start
    out = mix(left.astype(np.uint64) * _M2)
    live, at = np.arange(len(start)), start
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (len - k + 1 of them), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width, done, step = None, k, 0, hashes
    power, size = _M2, 1
    while width:
        if width & 1:
            part = step[done : done + n]
            out = part.copy() if out is None else mix(out) + part
            done += size
        width >>= 1
        if width:
            step = step[: len(step) - size] * power + step[size:]
            power = np.uint64((int(power) * 0xD1342543DE82EF95 | 1) & (2**64 - 1))
            size *= 2
    return mix(out)


def give_back() -> None:
    """Hand what this process has freed back to the system, where the C library has a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker that goes on to other tasks keeps no memory that it does not use."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
