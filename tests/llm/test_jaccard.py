import random
import re

import numpy as np

from gridspark.llm import common, jaccard
from gridspark.llm.components import components
from gridspark.llm.jaccard import bitmap, folded, may_be_alike, prefix_size, shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (n_shingles, component_id), by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed, groups=12, size=8):
    """Groups of texts at all distances around the border, shared passages, chains and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 30, 90, 200]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 12)):
                p = rng.randrange(len(text))
                text[p:p + rng.choice([0, 1])] = [word()]
            if rng.random() < 0.3:
                text += passage
            if rng.random() < 0.3:
                base = text  # the next one starts from here: a chain
            out.append(rng.choice([" ", "\n", "  "]).join(text))
    out += ["", None, " \t", "one", "ONE", "a b c", "A  b c", "a b c d", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(documents):
    rows = corpus(1, groups=20)
    assert of(jaccard.near_duplicates(documents(rows).repartition(5))) == brute(rows)


def test_second_round_and_many_tiles(documents, monkeypatch):
    """Tiles of a few sets, and every shingle crowded or none: nothing changes."""
    rows = corpus(3, groups=6, size=14)
    want = brute(rows)
    monkeypatch.setattr(jaccard, "TILE", 3)
    assert of(jaccard.near_duplicates(documents(rows))) == want
    monkeypatch.setattr(jaccard, "_levels", lambda rows: np.ones(1 << jaccard.BUCKET_BITS, np.uint8))
    assert of(jaccard.near_duplicates(documents(rows))) == want


def test_links_that_only_the_second_round_finds(documents):
    """Sets x < y < z of one shingle: y and z are alike, x is not like either."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    rows = [(100, " ".join(common + [f"x{i}" for i in range(60)]))]
    body = [f"y{i}" for i in range(90)]
    rows += [(i, " ".join(common + body[:rng.randrange(86, 90)])) for i in range(20)]
    assert of(jaccard.near_duplicates(documents(rows))) == brute(rows)


def test_prefix_and_bitmap_bounds():
    rng = np.random.default_rng(2)
    for n in range(1, 400):
        size = prefix_size(n)
        least = -(-75 * n // 100)  # overlap that any set that is alike has with it
        assert size == n - least + 1 and 1 <= size <= n
    for _ in range(300):
        n, extra = rng.integers(1, 300), rng.integers(0, 200)
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = base[rng.random(len(base)) < rng.random()]
        other = np.unique(np.concatenate([keep, rng.integers(0, 2**63, extra).astype(np.uint64)]))
        if not len(other):
            continue
        a, b = (np.frombuffer(bitmap(s), np.uint8)[None] for s in (base, other))
        size = min(a.shape[1], b.shape[1])
        differing = np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()
        overlap = len(np.intersect1d(base, other))
        assert differing <= len(base) + len(other) - 2 * overlap
        if 100 * overlap >= 75 * (len(base) + len(other) - overlap):
            assert may_be_alike(np.array([differing]), np.array([len(base)]), np.array([len(other)]))[0]


def test_sets_of_short_and_odd_texts():
    sizes = [len(s) for s in shingle_sets([np.frombuffer(t.encode(), np.uint8) for t in ("", " \n", "a", "a b", "a b c d e", "a b c d e f", "x " * 500, "a\x00b c")])]
    assert sizes == [0, 0, 1, 1, 1, 2, 1, 1]


def test_repeated_and_null_ids_clashing_columns_and_empty_table(documents):
    text = "a b c d e f g h"
    docs = documents([(2, text, "q", 1), (2, text, "r", 2), (None, text, "s", 3), (None, "other words in this text here", "t", 4), (None, None, "u", 5), (7, None, "v", 6)], "component_id string, id int")
    rows = jaccard.near_duplicates(docs).collect()
    assert sorted((r.id, r.component_id) for r in rows) == [(1, 2), (2, 2), (3, 2), (4, None), (5, None), (6, 7)]
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id is None for r in kept.collect()) == [False, False, True, True]
    assert jaccard.near_duplicates(documents([])).count() == 0


def test_a_group_of_near_copies_with_a_third_of_all_rows(documents):
    """Its members are compared with one of them, not with each other."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"v{i}"]) if i % 3 == 0 else " ".join(f"u{i}x{k}" for k in range(40))) for i in range(1800)]
    got = of(jaccard.near_duplicates(documents(rows).repartition(8)))
    assert all(got[i][1] == (0 if i % 3 == 0 else i) for i in range(1800))


def test_components(spark, monkeypatch):
    monkeypatch.setattr("gridspark.llm.components.EDGES", 90)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(5000, 5000 + k) for k in range(300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_narrow_tables_take_few_files(spark, monkeypatch, tmp_path):
    """However many partitions a session has, as each file costs a local file system several processes."""
    made = iter(range(1000))
    monkeypatch.setattr(common, "new_dir", lambda spark, label: f"{tmp_path}/{label}-{next(made)}")
    own = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in own}
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 900) if i % 9], "a bigint, b bigint").repartition(8)
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in components(edges).collect()}
        files = [len(list(d.glob("part-*"))) for d in tmp_path.iterdir()]
        assert got == {i: (i - 1) // 9 * 9 + 1 for i in range(1, 901)}
        few = 2 * spark.sparkContext.defaultParallelism
        assert len(files) > 3 and 0 < max(files) <= few
        # More rows take more files.
        monkeypatch.setattr(common, "FILE_ROWS", 10)
        assert len(common.stage(spark.range(400).repartition(100, "id"), "many", 400).inputFiles()) > few
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
