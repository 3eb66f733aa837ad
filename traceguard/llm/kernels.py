"""Vectorised numpy kernels over the UTF-8 bytes of Arrow string columns.

Every kernel sees whole texts. Documents are handled in groups of at most ``GROUP_BYTES`` (a longer document
makes a group of its own), so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
#: A random odd-base polynomial hash over random byte codes, modulo 2**64.
BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 5
MULTIPLIERS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for other stages, and a driver for other queries."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


#: What an operator holds in a Python worker from one task to the next.
_held: dict[object, object] = {}


def hold(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once for the tasks of a worker; one such thing is held at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Free what another operator holds: the worker that its tasks ran in now serves this one."""
    if _held:
        _held.clear()
        give_back()


def own_thread() -> None:
    """Let matrix products of this worker run on the task's own thread: the tasks already keep all cores busy.

    The library that numpy multiplies with starts a thread for each core, and these wait for each other.
    """
    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line}
        for library in libraries:
            loaded = ctypes.CDLL(library)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(loaded, name):
                    getattr(loaded, name)(1)
    except OSError:  # another system, or numpy with another library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._run(BASE, n)
            self.down = self._run(pow(BASE, -1, 2**64), n)
        return self.up, self.down

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_powers = _Powers()


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one document."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a group of documents.

    ``start`` and ``end`` are byte positions in ``data``; words of document i are ``first[i]:first[i+1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        self.raw = data
        self.data = data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[cuts] |= inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        ends[before] |= inside[before]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.docs = len(offsets) - 1

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _powers.get(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def word_hash(word: bytes) -> int:
    """What ``Words.hashes`` gives for one word."""
    return int(Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes()[0])


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each document, the sorted distinct hashes of its k-word shingles.

    With fewer than k words, the whole sequence is the only shingle; without words the array is empty.
    """
    h, first = words.hashes(), words.first
    n = len(h) - k + 1
    if n > 0:
        runs = np.full(n, k, np.uint64)
        for i in range(k):
            runs += h[i : i + n] * MULTIPLIERS[i]
        runs = mix(runs)
    for d in range(words.docs):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            m = b - a
            yield mix((h[a:b] * MULTIPLIERS[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m))
        else:
            yield np.zeros(0, np.uint64)
