import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_bins(lengths, size):
    """Best-fit decreasing, one piece after the other: the room left in every bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            at = min(fits, key=lambda i: bins[i])
            bins[at] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def placed(table, counts, size):
    bins = defaultdict(list)
    for length, n in counts.items():
        runs = table[table[:, 0] == length]
        for i in range(n):
            _, first, start, each, offset = runs[np.searchsorted(runs[:, 1], i, "right") - 1].tolist()
            bins[start + (i - first) // each].append((offset + (i - first) % each * length, length))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = Counter(lengths)
    table, n = packing.plan(counts, 24)
    bins = placed(table, counts, 24)
    assert sorted(bins) == list(range(n))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))] and sum(k for _, k in own) <= 24
    assert sorted(24 - sum(k for _, k in own) for own in bins.values()) == brute_bins(lengths, 24)


def test_plan_of_a_huge_corpus_is_small():
    rng = np.random.default_rng(3)
    counts = {n: int(rng.integers(1, 10**9)) for n in range(1, 4097)}
    table, n = packing.plan(counts, 4096)
    assert len(table) < 60_000 and n >= sum(k * c for k, c in counts.items()) / 4096


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 41)), max_size=60))
def test_tightest_capacity(steps):
    tree, held = packing.Capacities(40), Counter()
    for capacity, asked in steps:
        tree.add(capacity, 1)
        held[capacity] += 1
        if asked <= 40:
            assert tree.tightest(asked) == min((c for c in held if c >= asked), default=None)


TEXTS = ["", None, "Hello,  WORLD's\tbest\r\nday", "émigré ÉCOLE  naïve é", "a\xa0b c  d", "x" * 30_000, "don't 12345 ...", "<|endoftext|> end",
         "word " * 6000, "tok " * 4095, "ΑΣ σ ΑΣ", "a\x0bb\x0cc\x1cd", "😀😀 ok", "\n\n\n"]


@pytest.mark.parametrize("plain", [False, True])
def test_packing(spark, plain):
    """Ids against the library on whole texts; the places; sequences put together."""
    texts = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS + ["same text here"] * 40)] + [(7, "twice")]
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = plain
    want = Counter()
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 512):
            want[i, k // 512, k, len(ids[k:k + 512]), zlib.crc32(ids[k:k + 512].tobytes())] += 1
    docs = spark.createDataFrame([(*r, 1, 2) for r in texts], "doc_id bigint, text string, offset int, part int").repartition(4)
    found = packing.packed(docs, packing.WordTokenizer(PATH, plain), 512, keep_ids=True).cache()
    rows = found.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for own in bins.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(k for _, k, _ in own[:i]) for i in range(len(own))] and sum(k for _, k, _ in own) <= 512
    lengths = [r.length for r in rows]
    assert len(bins) == len(brute_bins(lengths, 512))
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(found).collect()}
    assert whole == {s: (sum(k for _, k, _ in own), b"".join(x for *_, x in own)) for s, own in bins.items()}
    found.unpersist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.packed(docs, packing.WordTokenizer(PATH)).collect() == []
