"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
# Bytes hashed at once; a longer text is cut between words.
PIECE = 2 << 20
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(64, 2 * n), _FACTOR)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def _hash_piece(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every run of non-zero values."""
    inside = values != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    data = values[inside].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(data)) - np.repeat(first, lengths)
    data *= power_table(int(lengths.max()))[place]
    return mixed(np.add.reduceat(data, first) + lengths.astype(np.uint64)) | np.uint64(1), starts


def word_hashes(texts: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
    """The hashes of every text's words, in order.

    ``table`` maps a byte to 0 if it separates words, else to the value that counts for it. Hashes
    are odd, so 0 is free to mean "no word".
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    held, owners, n = [], [], 0

    def flush():
        if not held:
            return
        # A zero after each text keeps its last word apart from the next text.
        joined = np.concatenate([x for t in held for x in (table[t], np.zeros(1, np.uint8))])
        hashes, starts = _hash_piece(joined)
        borders = np.cumsum([len(t) + 1 for t in held])
        for i, part in zip(owners, np.split(hashes, np.searchsorted(starts, borders[:-1])), strict=True):
            out[i] = part

    for i, text in enumerate(texts):
        if len(text) > PIECE:
            out[i] = _long(text, table)
            continue
        held.append(text)
        owners.append(i)
        n += len(text)
        if n > PIECE:
            flush()
            held, owners, n = [], [], 0
    flush()
    return out


def _long(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    found, start = [], 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        while stop < len(text):
            gaps = np.flatnonzero(table[text[start:stop]] == 0)
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
                break
            stop = min(len(text), stop + PIECE)  # one word longer than a piece
        found.append(_hash_piece(table[text[start:stop]])[0])
        start = stop
    return np.concatenate(found)
