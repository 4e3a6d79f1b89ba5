from collections import Counter

import numpy as np
import pytest

from gridspark.llm import shards
from gridspark.llm.shards import Matrix, blocks_of, hypergeometric, shard_sizes


@pytest.mark.parametrize("counts", [[5], [3, 0, 9, 1], [100] * 17, [1] * 33, [0, 0, 7]])
def test_matrix_has_the_given_sums(counts):
    sizes = [n for _, _, n in blocks_of(sum(counts), 4, 8)]
    matrix = Matrix(counts, sizes, 1)
    rows = np.array([np.diff(np.concatenate([[0], matrix.row(p)])) for p in range(len(counts))])
    assert rows.sum(axis=1).tolist() == counts and rows.sum(axis=0).tolist() == sizes and (rows >= 0).all()
    again = Matrix(counts, sizes, 1)
    assert all((again.row(p) == matrix.row(p)).all() for p in reversed(range(len(counts))))


def test_sizes_differ_by_one_at_most():
    assert shard_sizes(10, 4) == [3, 3, 2, 2] and shard_sizes(2, 4) == [1, 1, 0, 0]
    assert blocks_of(10, 2, 3) == [(0, 0, 3), (0, 3, 2), (1, 0, 3), (1, 3, 2)]


def test_large_counts_are_drawn_like_small_ones(monkeypatch):
    """The draw for counts beyond numpy's limit, at small counts where numpy can be compared."""
    monkeypatch.setattr(shards, "LIMIT", 0)
    mine = [hypergeometric(np.random.default_rng(s), 60, 40, 30) for s in range(4000)]
    theirs = np.random.default_rng(0).hypergeometric(60, 40, 30, 4000)
    assert abs(np.mean(mine) - np.mean(theirs)) < 0.15 and abs(np.std(mine) - np.std(theirs)) < 0.15
    assert 0 < hypergeometric(np.random.default_rng(1), 3 * 10**10, 10**10, 10**9) < 10**9


def test_every_row_gets_one_slot(documents):
    docs = documents([(i, f"t{i % 7}") for i in range(1000)] + [(None, None)] * 5).repartition(13)
    got = [(r.shard, r.slot) for r in shards.shuffle_into_shards(docs, 8, block_rows=32).collect()]
    assert sorted(got) == [(s, k) for s, n in enumerate(shard_sizes(1005, 8)) for k in range(n)]


def test_the_arrangement_is_uniform(spark):
    """Where a row comes out says nothing about where it was: chi-squared over shards, and no order left."""
    n, runs = 400, 40
    seen = Counter()
    for seed in range(runs):
        rows = spark.range(n, numPartitions=5)
        for r in shards.shuffle_into_shards(rows, 4, seed=seed, block_rows=16).where("id < 40").collect():
            seen[r.shard] += 1
    expected = 40 * runs / 4
    assert sum((seen[s] - expected) ** 2 / expected for s in range(4)) < 16.3  # 99.9 % of chi-squared with 3 degrees
    one = sorted((r.shard, r.slot, r.id) for r in shards.shuffle_into_shards(spark.range(2000, numPartitions=5), 2, block_rows=64).collect())
    ids = np.array([i for _, _, i in one])
    assert abs(np.corrcoef(np.arange(2000), ids)[0, 1]) < 0.1


def test_clashing_columns_empty_table_and_more_shards_than_rows(documents):
    got = shards.shuffle_into_shards(documents([(1, "a", "x", 9)], "shard string, place int"), 8)
    assert [(r.doc_id, r.shard, r.slot, r.place) for r in got.collect()] == [(1, 0, 0, 9)]
    assert shards.shuffle_into_shards(documents([]), 8).count() == 0
