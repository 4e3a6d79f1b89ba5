"""Runs of bytes cut out of many texts at once, and what is remembered about runs seen before."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from gridspark.llm.common import text_buffers

# Bytes of text taken apart at once, unless one text is longer, and bytes of runs remembered by a worker.
AT_ONCE, REMEMBERED = 2 << 20, 8 << 20


class Content:
    """A file's content, equal by digest, so that a worker builds what it needs from it once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.digest = hashlib.sha256(self.data).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest


def slices(texts: pa.Array, size: int = AT_ONCE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, texts as UTF-8 bytes) in slices of about ``size`` bytes; null is empty, no text is cut."""
    some, held, first = [], 0, 0
    for text in text_buffers(texts):
        some.append(text)
        held += len(text)
        if held > size:
            yield first, some
            some, held, first = [], 0, first + len(some)
    if some:
        yield first, some


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` up to each of ``ends``, without a copy."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def runs(texts: list[np.ndarray], inside: np.ndarray, value: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes marked in the table ``inside``, and the number of them in every text.

    ``value`` maps the bytes of the runs.
    """
    # A space after each text keeps its last run apart from the next text; 32 must not be marked.
    data = np.concatenate([x for t in texts for x in (t, _SPACE)]) if texts else _SPACE[:0]
    kept = inside[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    data = data[kept]
    array = binary_array(data if value is None else value[data], np.cumsum(ends - starts))
    borders = np.cumsum([len(t) + 1 for t in texts])
    return array, np.diff(np.concatenate([[0], np.searchsorted(starts, borders)]))


_SPACE = np.full(1, 32, np.uint8)


class Remembered:
    """Ids of byte runs; ``encode`` gives them for a list of distinct runs not seen before."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.row_of, self.bytes, self.rows, self.n = {}, 0, 0, 0
        self.first, self.count, self.ids = np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(4096, np.uint32)

    @staticmethod
    def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(array):
            array = np.concatenate([array[:at], np.empty(max(len(array), 2 * len(values)), array.dtype)])
        array[at:at + len(values)] = values
        return array

    def _add(self, new: list[bytes]) -> None:
        ids = self.encode(new)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        self.first = self._put(self.first, self.rows, self.n + np.cumsum(count) - count)
        self.count = self._put(self.count, self.rows, count)
        self.ids = self._put(self.ids, self.n, flat)
        self.row_of.update(zip(new, range(self.rows, self.rows + len(new)), strict=True))
        self.rows += len(new)
        self.n += len(flat)
        self.bytes += sum(map(len, new))

    def __call__(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the runs one after the other, and the number of ids of every run."""
        if self.bytes > REMEMBERED:
            self._clear()
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._add_missing(distinct)
        rows = np.fromiter(map(self.row_of.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        return self.ids[expand(self.first[rows], self.count[rows])], self.count[rows]

    def _add_missing(self, distinct: list[bytes]) -> None:
        new = [x for x in distinct if x not in self.row_of]
        if new:
            self._add(new)


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every run, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values; of an empty group 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
