"""Byte-level BPE with a hierarchical-bitmap rank queue.

Bytes of all pre-tokens at hand are the positions of one linked list, which is cut at the borders
of pre-tokens. A bucket per merge rank holds the positions where a pair of that rank starts; bitmaps
of 64-bit words, each bit of a level standing for one word of the level below, find the lowest
occupied rank by a find-first-set per level. All pairs of that rank are merged at once, their new
neighbours go to their buckets, and entries whose pair has changed meanwhile are skipped. A
pre-token of any length costs a few array operations per rank, and no pair is looked for twice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from gridspark.llm.common import text_buffers
from gridspark.llm.words import mixed, power_table

NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _MARK = np.zeros((3, 256), bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Parts and pre-tokens remembered by a worker, and the longest that are.
REMEMBERED, PARTS_REMEMBERED, LONGEST = 120_000, 800_000, 48
# A pattern's alternative that takes a space and letters as one pre-token.
WORD = r" ?\p{L}+"
# Bytes of text taken apart, of pre-tokens merged and of parts hashed at once, unless one is longer.
TEXT_BYTES, MERGE_BYTES, HASH_BYTES = 4 << 20, 1 << 20, 1 << 19
# Pairs looked up, and ids decoded, at once.
PAIRS, IDS = 1 << 17, 1 << 17


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """The content of a rank file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


class RankQueue:
    """Positions by rank, lowest rank first."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = [[0] * (ranks // 64 + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * (len(self.levels[-1]) // 64 + 1))

    def push(self, rank: int, positions: np.ndarray) -> None:
        if (held := self.buckets.get(rank)) is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, rank & 63
            before = level[word]
            level[word] = before | 1 << bit
            if before:
                return
            rank = word

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        found, at = self.buckets.pop(rank), rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return rank, found


class Merger:
    """The merges of a vocabulary given as ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(out, np.int32))

    def _build(self, left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
        """An open hash table from pairs to ranks, an eighth full at most."""
        self.bits = max(10, int(len(out) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left << 32 | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several keys for a slot, the last one gets it
            held = self.keys[slot[todo]] == keys[todo]
            done = todo[held]
            self.values[slot[done]] = out[done]
            todo = todo[~held]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; NONE if the pair makes no token or a side is missing (-1)."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        out[(left < 0) | (right < 0)] = NONE
        todo = np.flatnonzero((there != keys) & (there != -1) & (left >= 0) & (right >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            out[todo[there == keys[todo]]] = self.values[slot[todo[there == keys[todo]]]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every pre-token, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, count = self.merge_flat(np.frombuffer(b"".join(pieces), np.uint8), lengths)
        blob, cuts = ids.tobytes(), [0, *(np.cumsum(count) * 4).tolist()]
        return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def merge_flat(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens that lie end to end in ``data``, end to end as well, and how many each has."""
        n = len(data)
        if not n:
            return np.empty(0, "<u4"), np.zeros(len(lengths), np.int64)
        piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        # Position n stands for "nothing there".
        token = np.append(self.byte_ids[data], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        full = lengths > 0
        ends = np.cumsum(lengths)[full]
        after[ends - 1] = n
        before[ends - lengths[full]] = n
        after[n] = before[n] = n
        rank = np.full(n + 1, NONE, np.int32)
        for low in range(0, n, PAIRS):
            high = min(n, low + PAIRS)
            rank[low:high] = self.pair_ranks(token[low:high], token[after[low:high]])
        queue = RankQueue(self.size)
        at = np.flatnonzero(rank != NONE).astype(np.int32)
        self._push(queue, at, rank[at])
        while (found := queue.pop()) is not None:
            r, chunks = found
            pos = chunks[0] if len(chunks) == 1 else np.unique(np.concatenate(chunks))
            pos = pos[rank[pos] == r]
            if len(pos):
                self._merge_rank(queue, r, pos, token, after, before, rank, piece, n)
        alive = after[:n] != -1
        before_each = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], np.cumsum(lengths)])]
        return token[:n][alive].astype("<u4"), np.diff(before_each)

    @staticmethod
    def _push(queue: RankQueue, at: np.ndarray, ranks: np.ndarray) -> None:
        if len(at) < 2:
            if len(at):
                queue.push(int(ranks[0]), at)
            return
        order = np.lexsort((at, ranks))
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for low, high, r in zip(starts, [*starts[1:], len(at)], ranks[starts].tolist(), strict=True):
            queue.push(r, at[low:high])

    def _merge_rank(self, queue, r, pos, token, after, before, rank, piece, n) -> None:
        """Merge all pairs of rank ``r`` at the sorted positions ``pos``, left to right where they overlap."""
        right, every = after[pos], pos
        if len(pos) > 1 and (right[:-1] == pos[1:]).any():
            # In a run of pairs that overlap, every second one is left without its first half.
            joined = np.concatenate([[False], right[:-1] == pos[1:]])
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(pos))))
            pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            right = after[pos]
        while True:
            beyond, left = after[right], before[pos]
            adjacent = beyond[:-1] == pos[1:]
            if len(pos) > 1 and adjacent.any():
                left[1:][adjacent] = pos[:-1][adjacent]
            else:
                adjacent = None
            left_token = token[left]
            if adjacent is not None:
                left_token[1:][adjacent] = r
            same = np.full(len(pos), r, np.int32)
            ranks = self.pair_ranks(np.concatenate([left_token, same]), np.concatenate([same, token[beyond]]))
            left_rank, right_rank = ranks[:len(pos)], ranks[len(pos):]
            lower = (left_rank < r) | (right_rank < r)
            if not lower.any() or len(pos) == 1:
                break
            # A merge here makes a pair that comes before the next merge of this rank in the same
            # pre-token: merge only the first one there, all others wait in their bucket.
            own = piece[pos]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            wait = np.isin(own, own[lower]) & ~first
            if not wait.any():
                break
            queue.push(r, every[np.isin(piece[every], own[lower])])
            pos = pos[~wait]
            right = after[pos]
        token[pos] = r
        rank[right] = NONE
        after[right] = -1  # no longer in the list
        after[pos] = beyond
        before[beyond] = pos
        before[n] = n
        rank[pos] = right_rank
        rank[left] = left_rank
        rank[n] = NONE
        last = right_rank != NONE
        if adjacent is not None:
            last[:-1] &= ~adjacent
        some = (left_rank != NONE) & (left != n)
        at = np.concatenate([left[some], pos[last]])
        self._push(queue, at, np.concatenate([left_rank[some], right_rank[last]]))


def _cut(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the parts of texts that lie end to end in ``data`` start; ``firsts`` are the texts' own starts.

    Between any other character and white space there is always a border of pre-tokens, and so there is
    between a letter and a mark. A part ends there if the bytes show it at once: before ASCII white
    space, unless the character before may be white space beyond ASCII (all of which start with one of
    four bytes), and between an ASCII letter and an ASCII mark.
    """
    space = _SPACE[data]
    border = space.copy()
    border[1:] &= ~space[:-1]
    border[2:] &= data[:-2] != 0xC2
    for lead in (0xE1, 0xE2, 0xE3):
        border[3:] &= data[:-3] != lead
    border[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    border[firsts] = True
    return np.flatnonzero(border)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat(data * power_table(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))


def _plain(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which parts the bytes show to be letters, ASCII ones and those of U+00C0 to U+00FF, after a space or none."""
    fits = _LETTER[data] | (data == 0xC3)
    fits[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    fits[starts] |= (data[starts] == 32) & (lengths > 1)
    return np.logical_and.reduceat(fits, starts)


class Parts:
    """Parts of texts seen before: their bytes and their ids, found by hash and then compared."""

    def __init__(self):
        self.hashes = np.empty(0, np.uint64)
        self.bits = 12
        self.table = np.full(1 << self.bits, -1, np.int32)  # rows, by hash; half full at most
        self.data, self.first, self.length = np.empty(0, np.uint8), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids, self.first_id, self.count = np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, np.int32)
        self.own = 0, 0  # parts and bytes there from the start

    def copy(self) -> "Parts":
        other = Parts()
        other.__dict__.update(self.__dict__, table=self.table.copy(), own=(len(self.length), len(self.data)))
        return other

    def seen(self) -> tuple[int, int]:
        """How many parts were added since the copy was made, and their bytes."""
        return len(self.length) - self.own[0], len(self.data) - self.own[1]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        slot = self._slot(hashes)
        rows = self.table[slot]
        todo = np.flatnonzero((rows >= 0) & (self.hashes[rows] != hashes))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.table[slot]
            rows[todo] = there
            on = (there >= 0) & (self.hashes[there] != hashes[todo])
            todo, slot = todo[on], slot[on]
        return rows

    def add(self, hashes: np.ndarray, data: np.ndarray, length: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Parts with hashes that differ and are not there yet; bytes and ids lie end to end."""
        rows = np.arange(len(self.length), len(self.length) + len(length), dtype=np.int32)
        self.first = np.concatenate([self.first, (len(self.data) + np.cumsum(length) - length).astype(np.int32)])
        self.first_id = np.concatenate([self.first_id, (len(self.ids) + np.cumsum(count) - count).astype(np.int32)])
        self.length, self.count = np.concatenate([self.length, length.astype(np.int32)]), np.concatenate([self.count, count.astype(np.int32)])
        self.data, self.ids = np.concatenate([self.data, data]), np.concatenate([self.ids, ids])
        self.hashes = np.concatenate([self.hashes, hashes])
        if 2 * len(self.hashes) > len(self.table):
            self.bits = int(2 * len(self.hashes) - 1).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            rows = np.arange(len(self.hashes), dtype=np.int32)
        slot = self._slot(self.hashes[rows])
        while len(rows):
            free = self.table[slot] < 0
            self.table[slot[free]] = rows[free]  # of several rows for a slot, the last one gets it
            on = self.table[slot] != rows
            rows, slot = rows[on], (slot[on] + 1) & ((1 << self.bits) - 1)


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every run, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Encoder:
    """Encodes and decodes texts; parts and pre-tokens seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger, self.pattern = Merger(ranks), regex.compile(pattern)
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        # Letters after a space or none are one pre-token if all that the pattern tries before starts with an apostrophe.
        tried = pattern.split("|")
        self.words = WORD in tried and all(x.startswith("'") for x in tried[:tried.index(WORD)])
        self.vocabulary = self._vocabulary(ranks) if self.words else Parts()
        self.parts, self.tokens = self.vocabulary.copy(), {}

    def _vocabulary(self, ranks: dict[bytes, int]) -> Parts:
        """The tokens that may be a plain part: such a part is that token, whatever its merges give."""
        lengths = np.array([len(x) for x in ranks], np.int64)
        data, starts, ids = np.frombuffer(b"".join(ranks), np.uint8), np.cumsum(lengths) - lengths, np.array(list(ranks.values()), "<u4")
        hashes = _hashes(data, starts, lengths)
        plain = np.flatnonzero(_plain(data, starts, lengths))
        # Of tokens with one hash the others are found to differ, as all parts are compared.
        own = plain[np.unique(hashes[plain], return_index=True)[1]]
        known = Parts()
        known.add(hashes[own], data[_expand(starts[own], lengths[own])], lengths[own], ids[own], np.ones(len(own), np.int64))
        return known

    def _merged(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that lie end to end, about ``MERGE_BYTES`` merged at once; the more at once, the fewer steps per rank."""
        ends = np.cumsum(lengths)
        if len(data) <= MERGE_BYTES:
            return self.merger.merge_flat(data, lengths)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(MERGE_BYTES, len(data), MERGE_BYTES), "right"), len(lengths)])
        found = [self.merger.merge_flat(data[ends[low] - lengths[low]:ends[high - 1]], lengths[low:high])
                 for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _encode_parts(self, parts: list[bytes], data: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of distinct parts, cut by the pattern, and of the plain words in ``data``: all that is not known yet is merged together.

        A pre-token that is a token as a whole is that token; no plain word is one.
        """
        cut = [self.pattern.findall(part.decode()) for part in parts]
        if len(self.tokens) > REMEMBERED:
            self.tokens = {}
        known, new, texts, pieces = self.tokens, {}, [], []
        for text in set(chain.from_iterable(cut)) - known.keys():
            if (ids := self.whole.get(piece := text.encode())) is not None:
                new[text] = ids
            else:
                texts.append(text)
                pieces.append(piece)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, count = self._merged(np.concatenate([data, np.frombuffer(b"".join(pieces), np.uint8)]), np.concatenate([lengths, sizes]))
        own = int(count[:len(lengths)].sum())
        blob, cuts = ids[own:].tobytes(), [0, *(np.cumsum(count[len(lengths):]) * 4).tolist()]
        new.update((x, blob[a:b]) for x, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True))
        known.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        return [b"".join([new[x] if x in new else known[x] for x in own_cut]) for own_cut in cut], ids[:own], count[:len(lengths)]

    def _encode_new(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, none of them a plain token of the vocabulary: plain words need no pattern."""
        starts = np.cumsum(lengths) - lengths
        plain = _plain(data, starts, lengths) if self.words else np.zeros(len(lengths), bool)
        word, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        parts = [data[a:a + n].tobytes() for a, n in zip(starts[other].tolist(), lengths[other].tolist(), strict=True)]
        count = np.empty(len(lengths), np.int64)
        blobs, ids, count[word] = self._encode_parts(parts, data[_expand(starts[word], lengths[word])], lengths[word])
        count[other] = [len(x) // 4 for x in blobs]
        # Back to the order of the parts.
        order = np.concatenate([word, other])
        first = np.empty(len(lengths), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([ids, np.frombuffer(b"".join(blobs), "<u4")])[_expand(first, count)], count

    def encode(self, texts: list[np.ndarray]) -> list[bytes]:
        """Ids of every text, given as UTF-8 bytes, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return [b""] * len(texts)
        data = np.concatenate(texts)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        starts = _cut(data, firsts)
        lengths = np.diff(np.append(starts, len(data)))
        # A piece of the parts at a time: hashing takes some forty bytes per byte.
        hashes = np.concatenate([
            _hashes(data[starts[a]:starts[b - 1] + lengths[b - 1]], starts[a:b] - starts[a], lengths[a:b])
            for a, b in _pieces(starts, len(data))])
        rows = self.parts.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            if self.parts.seen()[0] > PARTS_REMEMBERED:
                self.parts = self.vocabulary.copy()
                rows = self.parts.find(hashes)
                missing = np.flatnonzero(rows < 0)
            fresh, at = np.unique(hashes[missing], return_index=True)
            own = missing[at]
            new = data[_expand(starts[own], lengths[own])]
            self.parts.add(fresh, new, lengths[own], *self._encode_new(new, lengths[own]))
            rows[missing] = self.parts.find(hashes[missing])
        known = self.parts
        ids, count = known.ids, known.count[rows].astype(np.int64)
        first = known.first_id[rows].astype(np.int64)
        odd = self._different(data, starts, lengths, rows)
        if len(odd):
            # Two parts with one hash: these are encoded by themselves.
            own, _, _ = self._encode_parts([data[a:a + n].tobytes() for a, n in zip(starts[odd].tolist(), lengths[odd].tolist(), strict=True)],
                                           data[:0], lengths[:0])
            count[odd] = [len(x) // 4 for x in own]
            first[odd] = len(ids) + np.cumsum(count[odd]) - count[odd]
            ids = np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])
        out = b"".join([ids[_expand(first[a:b], count[a:b])].tobytes() for a, b in _pieces(starts, len(data))])
        ends = np.concatenate([[0], np.cumsum(count)])
        # The parts of a text are those that start in it.
        text_ends = np.searchsorted(starts, np.cumsum(sizes))
        cuts = [0, *(ends[text_ends] * 4).tolist()]
        if known.seen()[1] > 16 * PARTS_REMEMBERED:
            self.parts = self.vocabulary.copy()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _different(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Parts whose bytes are not those of the part with the same hash."""
        known = self.parts
        bad = [np.flatnonzero(known.length[rows] != lengths)]
        for a, b in _pieces(starts, len(data)):
            fits = np.arange(a, b)[known.length[rows[a:b]] == lengths[a:b]]
            if len(fits):
                mine, theirs = _expand(starts[fits], lengths[fits]), _expand(known.first[rows[fits]], lengths[fits])
                wrong = np.flatnonzero(data[mine] != known.data[theirs])
                if len(wrong):
                    bad.append(fits[np.unique(np.searchsorted(np.cumsum(lengths[fits]), wrong, "right"))])
        return np.concatenate(bad)

    def decode(self, ids: bytes) -> bytes:
        table = self.merger.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


class Decoder:
    """The bytes of ids: all that a worker needs which only decodes."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        length = np.array([len(token) for token, _ in by_rank], np.int64)
        at = np.array([rank for _, rank in by_rank], np.int64)
        self.data = np.frombuffer(b"".join([token for token, _ in by_rank]), np.uint8)
        self.first, self.length = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.first[at], self.length[at] = np.cumsum(length) - length, length

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of every sequence of ids, given as little-endian unsigned 32-bit integers."""
        out, some, held = [], [], 0
        for x in ids:
            if some and held + len(x) > IDS * 4:
                out += self._decode(some)
                some, held = [], 0
            some.append(x)
            held += len(x)
        return out + self._decode(some)

    def _decode(self, ids: list[np.ndarray]) -> list[bytes]:
        if not ids:
            return []
        flat, ends, whole = np.concatenate(ids).view("<u4").astype(np.int64), np.zeros(1, np.int64), []
        # A long sequence by itself is still taken in pieces.
        for low in range(0, len(flat), IDS):
            x = flat[low:low + IDS]
            length = self.length[x]
            if (length < 0).any():
                raise KeyError(int(x[length < 0][0]))
            whole.append(self.data[_expand(self.first[x], length)].tobytes())
            ends = np.append(ends, ends[-1] + np.cumsum(length))
        blob, cuts = b"".join(whole), ends[np.cumsum([0, *[len(x) // 4 for x in ids]])].tolist()
        return [blob[a:b] for a, b in pairwise(cuts)]


def _pieces(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of parts of about ``HASH_BYTES`` together."""
    cuts = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(HASH_BYTES, size, HASH_BYTES)), [len(starts)]]))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


@lru_cache(4)
def _encoder(digest: str, pattern: str, blob: "Blob") -> Encoder:
    return Encoder(parse_ranks(blob.data), pattern)


@lru_cache(4)
def _decoder(digest: str, blob: "Blob") -> Decoder:
    return Decoder(parse_ranks(blob.data))


def _encoded(encoder: Encoder, texts: pa.Array) -> list[bytes]:
    """The ids of a batch of texts, taken in parts of about the same size: the largest decides how much memory a worker keeps."""
    size = sum(map(len, text_buffers(texts)))
    most = size // -(-size // TEXT_BYTES) if size else 0
    out, some, held = [], [], 0
    for text in text_buffers(texts):
        some.append(text)
        held += len(text)
        if held > most:
            out += encoder.encode(some)
            some, held = [], 0
    return out + encoder.encode(some)


class Blob:
    """File content, equal by digest, so that a worker builds an encoder once."""

    def __init__(self, data: bytes):
        self.data, self.digest = data, hashlib.sha256(data).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest


class Tokenizer:
    """Column functions for one vocabulary, given as the path of its rank file and the split pattern.

    The rank file (under 1 MB for 50,000 tokens) is read once, here, and goes to the workers with
    the function. Special tokens in a text are ordinary text. A null text encodes as an empty one,
    and an empty text as no ids.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.blob = Blob(f.read())
        self.pattern = pattern
        self.largest = max(parse_ranks(self.blob.data).values())

    def encode(self, text: Column | str) -> Column:
        """The ids of a text: binary, little-endian unsigned 32-bit integers."""
        blob, pattern = self.blob, self.pattern

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(blob.digest, pattern, blob)
            for texts in batches:
                yield pa.array(_encoded(encoder, texts), pa.binary())

        return encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that ids stand for; null for null."""
        blob = self.blob

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decoder = _decoder(blob.digest, blob)
            for batch in batches:
                yield pa.array(decoder.decode(list(text_buffers(batch))), pa.binary(), mask=batch.is_null().to_numpy(zero_copy_only=False))

        return decode(ids)

    def encode_and_decode(self, text: Column | str) -> Column:
        """struct(ids, decoded): the ids of a text and the bytes that these ids stand for.

        Both are done by one worker. Apart they take two workers per core, and as Spark gives a task any
        idle worker, each of these comes to keep an encoder with all that it remembers.
        """
        blob, pattern = self.blob, self.pattern

        @F.arrow_udf("struct<ids:binary,decoded:binary>")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder, decoder = _encoder(blob.digest, pattern, blob), _decoder(blob.digest, blob)
            for texts in batches:
                ids = pa.array(_encoded(encoder, texts), pa.binary())
                decoded = pa.array(decoder.decode(list(text_buffers(ids))), pa.binary())
                yield pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

        return both(text)


def id_array(ids: Column | str) -> Column:
    """Binary ids as an array of integers."""

    @F.arrow_udf("array<int>")
    def unpack(ids: pa.Array) -> pa.Array:
        return pa.array([None if (x := i.as_py()) is None else np.frombuffer(x, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))

    return unpack(ids)
