"""Benchmark passages in documents, by edit distance over words.

1. The CGK embedding turns edits into differing coordinates: a walk reads a word at every step, and a random
   bit of that word and step says whether it goes on to the next. Two walks that fell out of step at an edit
   often meet again after it, and then read the same words.
2. Bit sampling: each repetition has its own random bits and its own sampled coordinates of the walk; their
   words are hashed to a key. Walks start at every word of a document and at every word of an item, as one
   that starts behind an edit knows nothing of it; keys that meet place an item-sized window in the document.
3. Windows that hold too few of the item's words cannot be close enough and go; in the others, wider by the
   edits, the least edit distance is computed exactly.

Every step but the second loses nothing. ``REPEATS`` is chosen so that ``TARGET`` of the passages with all
the edits an item may have are found, at every item size (``tests/llm`` measure it against brute force).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import text_buffers, with_columns
from gridspark.llm.words import mixed, word_hashes

# An item and a passage match if the edits are at most this share of the item's words ...
EDITS = 0.25
# ... and none in an item shorter than this; an item without words matches nothing.
EXACT_BELOW = 8
# The share of close passages that must be found; steps of a walk, sampled coordinates and repetitions that reach it.
TARGET = 0.99
STEPS, SAMPLES, REPEATS = 8, 4, 16
# Keys of an item read so many different places at least; in long items a place more is as sure to be found.
PLACES, PLACES_LONG, LONG = 3, 4, 18
# Bounds of an index, and of what is looked up and compared at once.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 1 << 20
WORDS_AT_ONCE = 1 << 17
HITS_AT_ONCE = 1 << 15
# A byte counts for itself in a word if it is an ASCII letter or digit or belongs to a character beyond ASCII.
_TABLE = np.zeros(256, np.uint8)
for _c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _TABLE[_c] = _c + 32 if 65 <= _c <= 90 else _c


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from every word on, as far as there are so many."""
    n = max(0, len(words) - size + 1)
    key = np.full(n, size, np.uint64)
    for k in range(size):
        key = (key ^ words[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


_random = np.random.default_rng(20)
SEEDS = _random.integers(1 << 63, size=REPEATS, dtype=np.uint64)
# Each repetition reads the first coordinate, so that its walks start where their windows do.
COORDINATES = [{0, *(1 + _random.permutation(STEPS - 1)[:SAMPLES - 1]).tolist()} for _ in range(REPEATS)]


def walks(words: np.ndarray, repeat: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words, closed by zeros, and the places in them that walks from every word read at the sampled coordinates."""
    closed = np.concatenate([words, np.zeros(STEPS, np.uint64)])
    bits = mixed(closed ^ SEEDS[repeat])
    at, places = np.arange(len(words)), []
    for step in range(max(COORDINATES[repeat]) + 1):
        if step in COORDINATES[repeat]:
            places.append(at)
        at = at + (bits[at] >> np.uint64(step) & np.uint64(1)).astype(np.intp)
    return closed, places


def sampled(closed: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """The key of every walk: a hash of the words it reads."""
    key = np.full(len(places[0]), len(places), np.uint64)
    for at in places:
        key = (key ^ closed[at]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


class Pattern:
    """Exact search of an item: the least edits over all places of a text, by Myers' bit vectors."""

    def __init__(self, words: list[int]):
        self.size, self.words = len(words), words
        self.masks: dict[int, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.allowed = int(EDITS * self.size) if self.size >= EXACT_BELOW else 0

    def search(self, text: list[int]) -> tuple[int, int]:
        """(edits, end) of the best place, the first of several."""
        full, top = (1 << self.size) - 1, self.size - 1
        up, down, score, best = full, 0, self.size, (self.size, 0)
        for i, w in enumerate(text):
            x = self.masks.get(w, 0) | down
            d = ((up + (x & up)) ^ up) | x
            plus, minus = (down | ~(up | d)) & full, up & d
            if plus >> top & 1:
                score += 1
            elif minus >> top & 1:
                score -= 1
            x = plus << 1
            down, up = x & d & full, ((minus << 1) | ~(x | d)) & full
            if score < best[0]:
                best = (score, i + 1)
        return best

    def locate(self, text: list[int]) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place if it has few enough edits."""
        if sum(w in self.masks for w in text) < self.size - self.allowed:
            return None
        edits, end = self.search(text)
        if edits > self.allowed:
            return None
        # The same backwards from the end gives the start.
        back = Pattern(self.words[::-1]).search(text[:end][::-1])
        return edits, end - back[1], end


class Table:
    """Where keys are in items."""

    def __init__(self, key: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], item[order], offset[order]
        # One bit of sixteen is set, so that most foreign keys are known by a look.
        self.shift = np.uint64(64 - min(22, max(10, (16 * len(key)).bit_length())))
        self.marks = np.zeros(1 << (64 - int(self.shift)), bool)
        self.marks[self.key >> self.shift] = True

    def hits(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``key``, item, offset in it) of equal keys, about ``HITS_AT_ONCE`` at once."""
        at = np.flatnonzero(self.marks[key >> self.shift])
        low, high = np.searchsorted(self.key, key[at], "left"), np.searchsorted(self.key, key[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        ends = np.cumsum(n)
        for first in range(0, int(ends[-1]) if len(ends) else 0, HITS_AT_ONCE):
            hit = np.arange(first, min(first + HITS_AT_ONCE, int(ends[-1])))
            owner = np.searchsorted(ends, hit, "right")
            entry = hit - ends[owner] + n[owner] + low[owner]
            yield at[owner], self.item[entry], self.offset[entry]


class Items:
    """The index of a block of benchmark items, given as byte strings."""

    def __init__(self, texts: list[bytes]):
        words = word_hashes([np.frombuffer(t, np.uint8) for t in texts], _TABLE)
        self.patterns = [Pattern(w.tolist()) for w in words]
        self.sizes = np.array([p.size for p in self.patterns], np.int64)
        self.allowed = np.array([p.allowed for p in self.patterns], np.int64)
        owner = np.repeat(np.arange(len(words)), self.sizes)
        flat = np.concatenate([*words, np.empty(0, np.uint64)])
        self.members = np.unique(self._member(flat, owner))
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.exact, self.repeats = {}, []
        for size in range(1, EXACT_BELOW):
            same = np.flatnonzero(self.sizes == size)
            if len(same):
                self.exact[size] = Table(np.concatenate([windows(words[i], size) for i in same]), same, np.zeros(len(same), np.int64))
        if (self.sizes < EXACT_BELOW).all():
            return
        least = np.where(self.sizes < LONG, PLACES, PLACES_LONG)[owner]
        for repeat in range(REPEATS):
            closed, places = walks(flat, repeat)
            read = 1 + sum((b > a for a, b in zip(places[:-1], places[1:], strict=True)), np.zeros(len(flat), np.int64))
            inside = offset + places[-1] - np.arange(len(flat)) < self.sizes[owner]
            good = (read >= least) & inside & (self.sizes[owner] >= EXACT_BELOW)
            self.repeats.append(Table(sampled(closed, places)[good], owner[good], offset[good]))

    @staticmethod
    def _member(words: np.ndarray, items: np.ndarray) -> np.ndarray:
        return mixed(words ^ mixed(items.astype(np.uint64) + np.uint64(1)))

    def _enough(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Do the words from ``low`` to ``high`` hold as many of the item's as a close passage must?"""
        n = high - low
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        member = self._member(words[np.arange(ends[-1]) - (ends - n - low)[owner]], item[owner])
        near = np.minimum(np.searchsorted(self.members, member), len(self.members) - 1)
        held = np.bincount(owner, self.members[near] == member, len(n))
        return held >= self.sizes[item] - self.allowed[item]

    def candidates(self, words: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, start, stop) of the places to search; texts lie end to end in ``words``, each closed by a 0, which is in no item."""
        found = []

        def look(table: Table, key: np.ndarray) -> None:
            for place, item, offset in table.hits(key):
                text = np.searchsorted(firsts, place, "right") - 1
                some = np.unique(np.stack([text, item, place - firsts[text] - offset], axis=1), axis=0)
                text, item, start = some.T
                low = np.minimum(firsts[text] + np.maximum(0, start - self.allowed[item]), ends[text])
                high = np.clip(firsts[text] + start + self.sizes[item] + self.allowed[item], low, ends[text])
                # As many windows at once as have about ``WORDS_AT_ONCE`` words.
                borders = np.searchsorted(np.cumsum(high - low), np.arange(WORDS_AT_ONCE, (high - low).sum(), WORDS_AT_ONCE))
                for part in np.split(np.arange(len(some)), borders):
                    if len(part):
                        found.append(some[part][self._enough(words, item[part], low[part], high[part])])

        for size, table in self.exact.items():
            look(table, windows(words, size))
        for repeat, table in enumerate(self.repeats):
            look(table, sampled(*walks(words, repeat)))
        if not found:
            return []
        # Places of one text and item whose windows overlap are searched as one.
        text, item, start = np.unique(np.concatenate(found), axis=0).T
        if not len(text):
            return []
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.sizes[item[1:]])]))
        last = np.append(new[1:], len(text)) - 1
        wider = self.allowed[item[new]]
        low = np.maximum(0, start[new] - wider)
        high = np.maximum(low, start[last] + self.sizes[item[new]] + wider)
        return list(zip(text[new].tolist(), item[new].tolist(), low.tolist(), high.tolist(), strict=True))

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """Per text the (item, edits, first word, end word) of every item in it, its best place only."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        split = word_hashes(texts, _TABLE)
        low = 0
        while low < len(split):
            high, n = low, 0
            while high < len(split) and (n == 0 or n + len(split[high]) < WORDS_AT_ONCE):
                n += len(split[high]) + 1
                high += 1
            block = split[low:high]
            words = np.concatenate([x for w in block for x in (w, np.zeros(1, np.uint64))])
            ends = np.cumsum([len(w) + 1 for w in block]) - 1
            firsts = ends - [len(w) for w in block]
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for text, item, left, right in self.candidates(words, firsts, ends):
                place = self.patterns[item].locate(block[text][left:right].tolist())
                if place is not None:
                    place = (place[0], left + place[1], left + place[2])
                    best[text, item] = min(place, best.get((text, item), place))
            for (text, item), place in sorted(best.items()):
                out[low + text].append((item, *place))
            low = high
        return out


PASSAGES = "array<struct<item:int,edits:int,start:int,stop:int>>"


def passages(text: Column, benchmark: DataFrame) -> Column:
    """The benchmark items in a text: array of (item_id, edits, item_words, start, stop).

    Words are runs of letters and digits, in lower case. An item of n words is in a text if some
    passage of the text is at most ``EDITS * n`` word edits away (none below ``EXACT_BELOW`` words); the best
    passage is given, start and stop counting words. Null and empty texts hold none; null and empty
    items are in none; repeated items are found each. ``benchmark`` is a set of queries, not a table of
    the corpus: it is read in blocks of at most ``ITEMS_AT_ONCE`` items and, but for a single item longer than that,
    ``BYTES_AT_ONCE`` of text, each with an index of its own.
    """
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.lower("text")).orderBy("item_id").collect()
    none = F.array().cast("array<struct<item_id:bigint,edits:int,item_words:int,start:int,stop:int>>")
    parts = [none]
    ids, items, n = [], [], 0
    for item_id, item in rows:
        data = item.encode()
        if items and (len(items) == ITEMS_AT_ONCE or n + len(data) > BYTES_AT_ONCE):
            parts.append(_block(F.lower(text), ids, items))
            ids, items, n = [], [], 0
        ids.append(item_id)
        items.append(data)
        n += len(data)
    if items:
        parts.append(_block(F.lower(text), ids, items))
    return F.concat(*parts)


def _block(text: Column, ids: list[int | None], items: list[bytes]) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    @F.arrow_udf("array<struct<item_id:bigint,edits:int,item_words:int,start:int,stop:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Items(items)
        for texts in batches:
            found = index.find(list(text_buffers(texts)))
            yield pa.array([[{"item_id": ids[i], "edits": e, "item_words": index.patterns[i].size, "start": a, "stop": b} for i, e, a, b in row]
                            for row in found], kind)

    return find(text)


def with_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``passages``; a column of that name is replaced."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), passages(docs["text"], benchmark).alias("found"))
    return rows.select(*with_columns(docs, {"passages": F.col("found")}))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, edits, item_words, start, stop."""
    return with_passages(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with their columns as they are."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), passages(docs["text"], benchmark).alias("found"))
    return rows.where(F.size("found") == 0).select("row.*")
