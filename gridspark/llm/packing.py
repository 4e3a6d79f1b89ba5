"""Best-fit decreasing packing of token sequences with a segment tree over remaining capacities.

Pieces of one length are interchangeable, and so are open bins with the same room left. So the whole corpus is
packed as one: the lengths are counted (one row per length, whatever the number of documents), and the
driver packs those counts from the longest down. For every step a segment tree over the possible
capacities finds the tightest open bin that fits, in logarithmic time; where many documents in a row would be put the same way, into bins
that are alike, one step places them all. The outcome is a list of runs (length, number of the first piece, first
bin, pieces per bin, offset), from which every task computes the places of its own pieces. It is
what best-fit decreasing gives for all documents one by one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gridspark.llm.chunks import Content, Remembered, expand, runs, slices, sums
from gridspark.llm.common import stage

# Runs of other bytes than these are tokenised by themselves: the normaliser makes any white space one space and the splitter drops it.
_WORD = np.ones(256, bool)
_WORD[[9, 10, 13, 32]] = False


class WordTokenizer:
    """Ids of texts by a vocabulary file of the ``tokenizers`` library that drops white space, without added special tokens.

    With ``plain`` the strings of special tokens in a text are ordinary text; by default they are those tokens, as
    the library has it.
    """

    def __init__(self, path: str, plain: bool = False):
        self.content, self.plain = Content(path), plain

    def encoder(self) -> Remembered:
        return _word_encoder(self.content, self.plain)


@lru_cache(2)
def _word_encoder(content: Content, plain: bool) -> Remembered:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are busy with other tasks
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(content.data.decode())
    library.encode_special_tokens = plain
    return Remembered(lambda new: [e.ids for e in library.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)])


class Capacities:
    """A segment tree over the capacities 0 .. size: how many groups of open bins have each of them left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        at = self.leaves + capacity
        while at:
            self.tree[at] += change
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open bin that is not below ``length``."""
        at = self.leaves + length
        while not self.tree[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length: the runs, and the number of bins.

    A run is (length, first piece, first bin, pieces per bin, offset): piece number ``i`` of the length, from the
    run's first piece on, is in bin ``first bin + (i - first piece) // pieces per bin``. A length splits at most two groups of
    bins, and a group is met at most once per length, so there are at most about 3 * size * sqrt(2 * size) runs, for any corpus.
    """
    tree, groups, out, bins = Capacities(size), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            groups.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        done, count = 0, counts[length]
        while done < count:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, bins, -(-(count - done) // (size // length))
                bins += n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -1)
            # A bin that just took a piece is tighter than before, so it goes on taking pieces of this length while they fit.
            each = capacity // length
            for taken, pieces in ((min(n, (count - done) // each), each), (1, (count - done) % each)):
                pieces = min(pieces, count - done)
                if taken and pieces and n:
                    out.append((length, done, first, pieces, size - capacity))
                    put(capacity - pieces * length, first, taken)
                    done, first, n = done + taken * pieces, first + taken, n - taken
                if done == count or not n:
                    break
            put(capacity, first, n)
    return np.array(sorted(out), np.int64).reshape(-1, 5), bins


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, number bigint"


def pieces(docs: DataFrame, tokenizer: WordTokenizer, size: int, end: int, keep_ids: bool) -> DataFrame:
    """The pieces of every document (doc_id, text); ``part`` and ``number`` count those of one length in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = tokenizer.encoder(), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for row, texts in slices(batch.column("text")):
                found, words = runs(texts, _WORD)
                ids, per_word = encode(found)
                counts = sums(per_word, words)
                data = np.full(len(ids) + len(texts), end, "<u4")
                first = np.cumsum(counts + 1) - (counts + 1)
                data[expand(first, counts)] = ids
                n = counts // size + 1  # (counts + 1) tokens, rounded up
                owner = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, np.repeat(counts + 1, n) - start)
                at = np.repeat(first, n) + start
                blobs = [data[a:a + k].tobytes() for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                number = np.empty(len(length), np.int64)
                number[order] = seen[ranked] + np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                     pa.array(blobs if keep_ids else [None] * len(blobs), pa.binary()),
                     pa.array(np.full(len(length), part), pa.int32()), pa.array(number, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "number"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def packed(docs: DataFrame, tokenizer: WordTokenizer, size: int = 4096, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its ids and ``end``; only documents of more than ``size`` tokens are cut, into pieces of
    ``size`` and a rest. All pieces are packed together by best-fit decreasing. Null and empty texts are
    the end id only; rows are told apart, not doc_ids, which may repeat or be null. Other columns are not looked at.
    With ``keep_ids`` the piece's ids (binary, unsigned 32-bit little-endian) are returned as ``ids``; see ``sequences``.
    """
    cut = stage(pieces(docs, tokenizer, size, end, keep_ids), "pieces")
    counts = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = plan(total, size)
    keys = table[:, 0] << 44 | table[:, 1]

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        length, number = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        run = table[np.searchsorted(keys, length << 44 | number, "right") - 1]
        beyond = number - run[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(run[:, 2] + beyond // run[:, 3]), pa.array(run[:, 4] + beyond % run[:, 3] * length)], ["sequence_id", "offset"])

    # Pieces of one length are numbered through all tasks: a row per task and length, and one window per length.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = cut.join(bases, ["part", "length"]).withColumn("place", place("length", F.col("base") + F.col("number")))
    kept = ["ids"] if keep_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *kept)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``packed(keep_ids=True)``: sequence_id, length, and the ids of its pieces one after the other.

    A group is one sequence, so it is never larger than the packing's size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    blobs = F.transform(ordered, lambda x: F.hex(x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(blobs, "")).alias("ids"))
