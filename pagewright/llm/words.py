"""Words of many texts at once, as numpy arrays of byte positions.

Texts are joined with line feeds, which separate words under either rule below, so one scan finds the words of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: True for the bytes of a word: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


@dataclass
class Words:
    """Words of a group of texts: ``data[starts[i]:ends[i]]`` is word i; text t has the words ``first[t]`` to ``first[t + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def groups(texts: list[bytes] | list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes or letters together; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def find(texts: list[bytes], kind: np.ndarray) -> Words:
    """Words of the whole texts (UTF-8), with A-Z in lower case."""
    data = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
    word = kind[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    text_at = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words(data, starts, ends, np.searchsorted(starts, text_at), text_at)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, alike on every machine."""
    global _POWERS
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    sizes = w.ends - w.starts
    longest = int(sizes.max())
    if longest > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(longest, 64), _MULTIPLIER, np.uint64))
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    inside = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    letters = w.data[inside + np.repeat(w.starts, sizes)].astype(np.uint64)
    letters += np.uint64(1)
    letters *= _POWERS[inside]
    return mix(np.add.reduceat(letters, at[:-1]))


def hash_of(word: str) -> int:
    """The same hash for one lower-case word."""
    raw = word.encode()
    return int(hashes(Words(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), np.array([0, 1]), np.array([0, len(raw)])))[0])


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out + np.uint64(k)) + h[k : k + n]
    return mix(out)


def cuts(column, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of an Arrow text column that hold about ``most`` bytes; a longer text ends its run."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    part = np.cumsum(sizes) // most
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    yield from zip(begin.tolist(), np.diff(np.append(begin, len(part))).tolist())


def slices(batches: Iterator, column: int) -> Iterator:
    """Arrow batches cut into parts of a few MB of text each, so that few texts at a time become Python objects."""
    for batch in batches:
        for first, n in cuts(batch.column(column)):
            yield batch.slice(first, n)
        give_back()


def give_back() -> None:
    """Return memory that this worker has freed to the machine, as executors run several workers."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def raw_texts(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
