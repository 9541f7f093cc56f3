"""Vectorised access to the words of Arrow text columns.

Everything here works on whole texts. An Arrow batch is cut into slices of a few
megabytes so that numpy's temporaries stay bounded; a single text larger than the
slice size is taken alone, whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The ASCII white space of the word pattern ``[^\\x20\\x09-\\x0D]+``.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Strings up to so many bytes are hashed eight bytes at a time, longer ones all bytes at once.
SHORT = 1024

_MASK = (1 << 64) - 1


def _stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _stream(17, 256) | np.uint64(1)
_STEP = int(_stream(99, 1)[0]) | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """At a task's end its worker, which stays for later tasks, returns free memory to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``, a row at least."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and the n + 1 offsets into them; a null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def is_word(data: np.ndarray) -> np.ndarray:
    """The bytes that are not ASCII white space."""
    return (data != 32) & ((data - np.uint8(9)) >= 5)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


class Words:
    """The words of each text: ``start``/``end`` byte of each word, ``first[d]`` to
    ``first[d + 1]`` the words of text d, ``ids`` equal for equal words only,
    ``vocab`` the distinct words of this slice."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, offsets = raw(texts)
        if lower:
            data = lowered(data)
        self.data, self.offsets = data, offsets
        inside = is_word(data)
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        at = offsets[:-1][full]
        head[at] = inside[at]
        at = offsets[1:][full] - 1
        tail[at] = inside[at]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = len(self.start)

    @functools.cached_property
    def _coded(self) -> pa.DictionaryArray:
        ends = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        strings = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(ends), pa.py_buffer(self.data.compress(is_word(self.data))))
        return strings.dictionary_encode()

    @functools.cached_property
    def ids(self) -> np.ndarray:
        return self._coded.indices.to_numpy(zero_copy_only=False)

    @functools.cached_property
    def vocab(self) -> pa.Array:
        return self._coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @functools.cached_property
    def _hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end - self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        return self._hashes

    def runs(self, k: int) -> np.ndarray:
        """The positions at which k words of one text begin."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(self.n)
        return np.flatnonzero(room >= k)


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    data, offsets = raw(strings)
    return hash_spans(data, offsets[:-1], np.diff(offsets))


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start: short strings take in eight bytes a round,
    long ones are sums of a random value for each byte times the power of its place."""
    out = size.astype(np.uint64) * np.uint64(_STEP)
    long = np.flatnonzero(size > SHORT)
    for i in long.tolist():
        part = data[start[i] : start[i] + size[i]]
        out[i] += (_BYTE[part] * _powers(len(part))).sum(dtype=np.uint64)
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    at, left = start[live], size[live]
    while len(live):
        mask = ~np.uint64(0) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        h = (out[live] ^ (eights[at] & mask)) * np.uint64(_STEP)
        out[live] = h ^ (h >> np.uint64(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(out)


def roll(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k values from each position of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(_STEP) + hashes[at + j]
    return mix(out + np.uint64(k))


def starts_of_equal(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row of the sorted columns differs from the one before."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new
