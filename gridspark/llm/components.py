"""Connected components of a graph given as edges between numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.common import stage


# Edges of a partition that one task makes into stars before the rounds begin.
EDGES = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent if root(x) != x]
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Alternating stars: in turn, every node hands its larger neighbours, then its smaller ones, to the
    smallest neighbour it knows. The graph keeps its components and becomes a forest of stars, after
    about as many rounds as the logarithm of the longest path; that tasks make stars of ``EDGES`` edges
    each first shortens the paths. A round takes a minimum per node, which
    is combined before the shuffle, and a join that splits the edges of a hub; nothing is gathered. Every
    round is staged. ``edges`` is counted first, so it should be a written table.
    """
    # A round has no more edges than the one before: each of the larger neighbours is handed on once.
    size = 2 * edges.count()
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", size)
    count = links.count()
    if count:
        links = stage(links.repartition(-(-count // EDGES)).mapInArrow(_stars, "a bigint, b bigint").distinct(), "links", size)
    before = _state(links)
    for _ in range(rounds):
        if not before[0]:
            break
        # To the smallest of all neighbours and the node itself.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large", size)
        # The smaller neighbours of a node, and the node, to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links", size)
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no forest of stars after {rounds} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
