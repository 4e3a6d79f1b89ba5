import hashlib
import random
import re

import numpy as np
import pytest

from gridspark.llm import dedup
from gridspark.llm.dedup import CHUNK, Fingerprints


def brute(rows):
    groups = {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def of(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 5, CHUNK - 1, CHUNK, CHUNK + 1, 7 * CHUNK, 300 * CHUNK + 17])
def test_fingerprint_is_the_polynomial(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    engine = Fingerprints()
    for k, (m, g) in enumerate(zip(engine.moduli, engine.bases, strict=True)):
        want, power = 0, 1
        for b in data.tolist():
            want, power = (want + b * power) % m, power * g % m
        assert int(engine.of(data)[k]) == want


def test_parts_combine_to_the_whole():
    rng = np.random.default_rng(1)
    engine = Fingerprints()
    data = rng.integers(0, 256, 3 * CHUNK + 99, dtype=np.uint8)
    for cut in (0, 1, 100, CHUNK, 2 * CHUNK + 5, len(data)):
        joined = engine.combine(engine.of(data[:cut]), cut, engine.of(data[cut:]))
        assert joined.tolist() == engine.of(data).tolist()


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "a b "), (2, None), (8, ""), (4, "é" * 70_000), (7, "é" * 70_000), (6, "x" * 300_000 + "\n\ny"),
        (10, "x" * 300_000 + " y"), (11, "x" * 300_000 + " z"), (12, " "), (13, "\x0b\x0c"), (14, " ")]


def test_against_brute_force(documents):
    got = dedup.exact_groups(documents(ROWS))
    assert of(got) == brute(ROWS)
    assert {r.doc_id for r in got.where("kept").collect()} == {keep for _, keep, _, _ in brute(ROWS)}


def test_unequal_texts_with_equal_fingerprints_are_told_apart(documents):
    """Moduli so small that nearly all fingerprints of a length collide."""
    random.seed(2)
    rows = [(i, "".join(random.choice("ab") for _ in range(5))) for i in range(200)] + [(500 + i, f"{'q' * 70_000}{i % 3}") for i in range(9)]
    assert of(dedup.exact_groups(documents(rows), moduli=(2, 3))) == brute(rows)


def test_repeated_and_null_ids_keep_one_row(documents):
    rows = [(1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "u")]
    got = dedup.exact_groups(documents(rows))
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got.where("text = 't'").collect()) == [
        (False, 1, 3, False), (False, 1, 3, True), (True, 1, 3, False)]
    assert got.where("text = 'u' AND kept").count() == 1
    assert dedup.exact_dedup(documents(rows)).count() == 2


def test_clashing_columns_and_empty_table(documents):
    docs = documents([(2, "a", "mine", 5, True), (1, "a", "yours", 6, False)], "kept string, tag int, h1 boolean")
    got = dedup.exact_groups(docs)
    assert [(r.doc_id, r.tag, r.h1, r.kept) for r in got.orderBy("doc_id").collect()] == [(1, 6, False, True), (2, 5, True, False)]
    kept = dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.first().kept == "yours"
    assert dedup.exact_groups(documents([])).count() == 0


def test_a_group_with_a_third_of_all_rows(documents):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = dedup.exact_groups(documents(rows).repartition(16))
    assert got.where("group_size = 1000").count() == 1000 and got.where("kept").count() == 2001
