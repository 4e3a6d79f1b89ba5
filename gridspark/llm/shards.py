"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

In a uniformly random arrangement of n rows, the number of rows that go from input partition p to
output block b is multivariate hypergeometric. So the matrix of these counts is drawn first: its
rows sum to the partitions' sizes and its columns to the blocks' sizes, exactly. Every partition
then permutes its rows and deals them out by its row of counts, the rows are exchanged, and every
block permutes what it got: together one uniform permutation, in a single shuffle.

No one holds the matrix. Partitions are the leaves of a binary tree; a node splits its counts
between its halves with a draw seeded by (seed, node), so a task gets its row of the matrix by
walking down from the root, and gets the same row again after any failure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridspark.llm.common import TAG_BITS, stage, tagged, with_columns

# Rows of a block, the unit that one task permutes; a shard is as many blocks as it takes.
BLOCK_ROWS = 1 << 16
LIMIT = 10**9


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def blocks_of(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of every block, in order."""
    return [(s, at, min(block_rows, size - at)) for s, size in enumerate(shard_sizes(rows, shards))
            for at in range(0, size, block_rows)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows out of ``good + bad`` are good; for counts that numpy does not take as well.

    Beyond numpy's limit the probabilities around the mode are listed from log-gammas, 12 standard
    deviations to either side, and one uniform number picks among them.
    """
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good + bad else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(max(1.0, drawn * (good / total) * (bad / total) * (total - drawn) / max(1, total - 1)))
    k = np.arange(max(low, mode - int(12 * spread) - 2), min(high, mode + int(12 * spread) + 2) + 1, dtype=np.float64)
    # Ratios of neighbours, summed as logarithms: no difference of huge numbers.
    step = np.log((good - k[:-1]) * (drawn - k[:-1])) - np.log((k[:-1] + 1) * (bad - drawn + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, np.searchsorted(mass, rng.random() * mass[-1], side="right"))])


def split_counts(rng: np.random.Generator, columns: np.ndarray, drawn: int) -> np.ndarray:
    """Of ``drawn`` rows taken at random out of columns of these sizes, how many are from each."""
    total = int(columns.sum())
    if total < LIMIT:
        return rng.multivariate_hypergeometric(columns, drawn, method="marginals")
    out, rest = np.zeros_like(columns), total
    for i, size in enumerate(columns.tolist()):
        rest -= size
        out[i] = hypergeometric(rng, size, rest, drawn)
        drawn -= int(out[i])
    return out


class Matrix:
    """Rows of the communication matrix, each drawn where it is needed."""

    def __init__(self, counts: list[int], sizes: list[int], seed: int):
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.sizes, self.seed, self.n = np.array(sizes, np.int64), seed, len(counts)
        self.row = lru_cache(8)(self._row)
        self.order = lru_cache(8)(self._order)
        self._node = lru_cache(64)(self._split)

    def _split(self, low: int, high: int) -> np.ndarray:
        """Counts per block of partitions [low, high)."""
        if (low, high) == (0, self.n):
            return self.sizes
        parent = self._parent(low, high)
        middle = (parent[0] + parent[1]) // 2
        whole = self._node(*parent)
        rng = np.random.default_rng([self.seed, 1, parent[0], parent[1]])
        left = split_counts(rng, whole, int(self.before[middle] - self.before[parent[0]]))
        return left if low == parent[0] else whole - left

    def _parent(self, low: int, high: int) -> tuple[int, int]:
        a, b = 0, self.n
        while True:
            middle = (a + b) // 2
            half = (a, middle) if low < middle else (middle, b)
            if half == (low, high):
                return a, b
            a, b = half

    def _row(self, partition: int) -> np.ndarray:
        """Running sums over the blocks of what the partition sends."""
        return np.cumsum(self._node(partition, partition + 1))

    def _order(self, partition: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, 2, partition])
        return rng.permutation(int(self.before[partition + 1] - self.before[partition]))

    def block(self, partition: int, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row(partition), self.order(partition)[positions], side="right")


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot``, a uniformly random arrangement.

    Shard sizes are at most one apart and slots of a shard run from 0 without a gap, whatever the
    rows hold: equal rows, nulls and hot keys play no part. The arrangement depends on ``seed`` and
    on the order and split of the input only; it is fixed once the input has been staged. A shard
    without rows has no rows. Columns named ``shard`` or ``slot`` are replaced.
    """
    staged = stage(tagged(rows), "rows")
    at = F.shiftright("tag", TAG_BITS)
    # One row per input partition.
    listed = sorted(staged.groupBy(at.alias("p")).count().collect())
    counts, known = [c for _, c in listed], [p for p, _ in listed]
    blocks = blocks_of(sum(counts), shards, block_rows)
    sizes = [n for _, _, n in blocks]

    @F.arrow_udf("int")
    def block_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matrix = Matrix(counts, sizes, seed)
        for tags in batches:
            tags = tags.to_numpy(zero_copy_only=False)
            part, position = np.searchsorted(known, tags >> TAG_BITS), tags & ((1 << TAG_BITS) - 1)
            out = np.empty(len(tags), np.int32)
            for p in np.unique(part):
                mine = part == p
                out[mine] = matrix.block(int(p), position[mine])
            yield pa.array(out)

    starts = staged.sparkSession.createDataFrame(
        [(i, s, a) for i, (s, a, _) in enumerate(blocks)], "block int, shard int, start bigint")
    # A block has at most ``block_rows`` rows; its order is by a hash, an even permutation of them.
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "tag"), "tag")
    return (staged.withColumn("block", block_of("tag"))
            .withColumn("place", F.row_number().over(order).cast("long") - 1)
            .join(F.broadcast(starts), "block")
            .select(*with_columns(rows, {"shard": F.col("shard"), "slot": F.col("start") + F.col("place")})))
