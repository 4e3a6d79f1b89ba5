"""Neighbouring byte ranges of files, read together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

# Bytes between two ranges that are rather read than skipped, and the most that is read at once.
GAP, MOST = 64 << 10, 16 << 20


def runs(ranges: Sequence[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, int, int]]:
    """Runs of the sorted ``(path, offset, length)``: first and last range (exclusive), offset and length of the read.

    A range joins the run before it if it starts at most ``gap`` bytes after its end (they may overlap) and the
    run stays within ``most`` bytes; a single range may be longer.
    """
    first, start, end = 0, 0, 0
    for i, (path, offset, length) in enumerate(ranges):
        if i and path == ranges[first][0] and offset <= end + gap and max(end, offset + length) - start <= most:
            end = max(end, offset + length)
            continue
        if i:
            yield first, i, start, end - start
        first, start, end = i, offset, offset + length
    if ranges:
        yield first, len(ranges), start, end - start


class Files:
    """The file that is being read stays open until another one is asked for."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        from gridspark.sources.files import open_input

        if path != self.path:
            self.close()
            self.file, self.path = open_input(path), path
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{path} ends before {offset} + {length}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def read_ranges(files: Files, ranges: Sequence[tuple[str, int, int]], gap: int = GAP,
                most: int = MOST) -> Iterator[tuple[int, memoryview, int, int]]:
    """(number of the range, its bytes, offset and length of the read that brought it), in the given order, which is by path and offset."""
    for first, last, start, length in runs(ranges, gap, most):
        data = memoryview(files.read(ranges[first][0], start, length))
        for i in range(first, last):
            at = ranges[i][1] - start
            yield i, data[at:at + ranges[i][2]], start, length
