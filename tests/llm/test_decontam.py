import random

import numpy as np
import pytest

from gridspark.llm import decontam
from gridspark.llm.decontam import Items, Pattern
from gridspark.llm.words import word_hashes


def edits(a, b):
    """Least word edits between ``a`` and any passage of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_exact_search_against_dynamic_programming():
    random.seed(5)
    for _ in range(300):
        a = [random.randrange(4) for _ in range(random.randrange(1, 90))]
        b = [random.randrange(4) for _ in range(random.randrange(0, 60))]
        least, end = Pattern(a).search(b)
        assert least == edits(a, b) and least == min([len(a)] + [edits(a, b[:end])])
        place = Pattern(a).locate(b)
        if place:
            assert place[0] == edits(a, b[place[1]:place[2]]) and place[0] <= int(decontam.EDITS * len(a))


@pytest.fixture(scope="module")
def vocabulary():
    random.seed(6)
    return ["".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 8))) for _ in range(2000)]


def view(words):
    return np.frombuffer(" ".join(words).encode(), np.uint8)


@pytest.mark.parametrize(("rate", "recall"), [(0.0, 1.0), (0.1, 0.99), (0.2, 0.97)])
def test_recall_at_distance(vocabulary, rate, recall):
    """Items with edits, anywhere in a document, are found; brute force says which are close enough."""
    random.seed(7)
    items = [random.choices(vocabulary, k=random.choice([4, 8, 11, 14, 20, 40, 80])) for _ in range(300)]
    index = Items([" ".join(i).encode() for i in items])
    texts = []
    for item in items:
        words = list(item)
        for _ in range(int(rate * len(words)) if len(words) >= decontam.EXACT_BELOW else 0):
            p = random.randrange(len(words))
            words[p:p + random.choice([0, 1, 1])] = random.choices(vocabulary, k=random.choice([0, 1]))
        texts.append(random.choices(vocabulary, k=random.randrange(40)) + words + random.choices(vocabulary, k=random.randrange(40)))
    found = index.find([view(t) for t in texts])
    close = [k for k, (i, t) in enumerate(zip(items, texts, strict=True)) if edits(i, t) <= Pattern(i).allowed]
    hit = [k for k in close if any(m[0] == k for m in found[k])]
    assert len(close) > 250 and len(hit) >= recall * len(close)
    for k, row in enumerate(found):
        for item, e, a, b in row:
            assert edits(items[item], texts[k][a:b]) == e <= Pattern(items[item]).allowed


def test_clean_text_is_left_alone(vocabulary):
    random.seed(8)
    items = [random.choices(vocabulary, k=20) for _ in range(100)]
    index = Items([" ".join(i).encode() for i in items])
    assert not any(index.find([view(random.choices(vocabulary, k=400)) for _ in range(100)]))


def test_odd_texts_and_tables(spark, documents, vocabulary):
    item = " ".join(vocabulary[:20])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "!!"), (None, "one two"), (5, "Only Word")], "item_id bigint, text string")
    docs = documents([(1, f"x, {item.upper()}!! y"), (2, None), (3, ""), (None, item), (4, "say ONE-two now"), (5, "word only"), (6, (" ".join(vocabulary) + " ") * 60 + item),
                      (4, "say ONE-two now")])
    got = sorted((r.doc_id or 0, r.item_id or 0, r.edits, r.item_words) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 1, 0, 20)] * 2 + [(1, 1, 0, 20)] * 2 + [(4, 0, 0, 2)] * 2 + [(6, 1, 0, 20)] * 2
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, bench).collect()) == [2, 3, 5]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.decontaminated(documents([]), bench).count() == 0
    clash = documents([(1, item, "mine")], "passages string")
    assert decontam.with_passages(clash, bench).first().passages[0].item_id == 1 and decontam.decontaminated(clash, bench).columns == clash.columns


def test_items_in_blocks(spark, documents, vocabulary, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 7)
    items = [" ".join(vocabulary[k * 20:k * 20 + 20]) for k in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontam.contaminated(documents([(i, f"a {t} b") for i, t in enumerate(items)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(30)]


def test_word_hashes_do_not_depend_on_the_batch(monkeypatch, vocabulary):
    texts = [view(vocabulary[:k]) for k in (0, 1, 50, 900)] + [np.frombuffer(b"x" * 5000, np.uint8), np.frombuffer(b"  ", np.uint8)]
    whole = [w.tolist() for w in word_hashes(texts, decontam._TABLE)]
    assert [len(w) for w in whole] == [0, 1, 50, 900, 1, 0] and len({h for w in whole for h in w}) == len(set(vocabulary[:900])) + 1
    monkeypatch.setattr("gridspark.llm.words.PIECE", 64)
    assert [w.tolist() for w in word_hashes(texts, decontam._TABLE)] == whole


@pytest.mark.parametrize("size", [8, 11, 14, 15, 16, 17, 18, 20, 24, 40])
def test_all_are_found_at_the_full_distance(vocabulary, size):
    """With as many edits as allowed no close passage is missed, whatever the size of the item."""
    random.seed(size)
    items = [random.choices(vocabulary, k=size) for _ in range(100)]
    index = Items([" ".join(i).encode() for i in items])
    texts = []
    for item in items:
        words = list(item)
        for _ in range(int(decontam.EDITS * size)):
            p = random.randrange(len(words))
            words[p:p + random.choice([0, 1, 1])] = random.choices(vocabulary, k=random.choice([0, 1]))
        texts.append(random.choices(vocabulary, k=random.randrange(40)) + words + random.choices(vocabulary, k=random.randrange(40)))
    found = index.find([view(t) for t in texts])
    close = [k for k, (i, t) in enumerate(zip(items, texts, strict=True)) if edits(i, t) <= Pattern(i).allowed]
    assert len(close) > 80
    for k in close:
        assert [e for i, e, _, _ in found[k] if i == k] == [edits(items[k], texts[k])]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7])
def test_short_items_are_found_exactly(vocabulary, size):
    random.seed(size)
    items = [random.choices(vocabulary, k=size) for _ in range(100)]
    index = Items([" ".join(i).encode() for i in items])
    texts = [random.choices(vocabulary, k=random.randrange(40)) + i + random.choices(vocabulary, k=random.randrange(40)) for i in items]
    assert all(any(i == k and e == 0 for i, e, _, _ in row) for k, row in enumerate(index.find([view(t) for t in texts])))


@pytest.mark.parametrize("size", [8, 9, 10, 11, 13, 15, 16, 17, 18, 19, 22, 28, 40, 64])
def test_recall_reaches_the_target(vocabulary, size):
    """Items with all the edits they may have, each at another word: at least ``TARGET`` of those that are close are found."""
    random.seed(100 + size)
    items = [random.choices(vocabulary, k=size) for _ in range(400)]
    texts = []
    for item in items:
        spoiled = set(random.sample(range(size), Pattern(item).allowed))
        words = []
        for p, word in enumerate(item):
            kind = random.choice("replaced inserted deleted".split()) if p in spoiled else ""
            words += [random.choice(vocabulary)] * (kind != "" and kind != "deleted") + [word] * (kind in ("", "inserted"))
        texts.append(random.choices(vocabulary, k=30) + words + random.choices(vocabulary, k=30))
    found = Items([" ".join(i).encode() for i in items]).find([view(t) for t in texts])
    close = [k for k, (i, t) in enumerate(zip(items, texts, strict=True)) if edits(i, t) <= Pattern(i).allowed]
    hit = [k for k in close if any(i == k for i, _, _, _ in found[k])]
    assert len(close) == 400 and len(hit) >= decontam.TARGET * len(close)


def test_items_in_step_share_keys_and_foreign_ones_do_not(vocabulary):
    """A walk is a function of the words it reads, wherever they stand."""
    words = word_hashes([view(vocabulary[:50])], decontam._TABLE)[0]
    for repeat in range(decontam.REPEATS):
        whole = decontam.sampled(*decontam.walks(words, repeat))
        later = decontam.sampled(*decontam.walks(words[20:], repeat))
        assert (whole[20:] == later).all() and len(set(whole.tolist())) == 50
        # Step by step, as the embedding is defined.
        for start in range(40):
            at, read = start, []
            for step in range(decontam.STEPS):
                if step in decontam.COORDINATES[repeat]:
                    read.append(at)
                at += int(decontam.mixed(words[at:at + 1] ^ decontam.SEEDS[repeat])[0]) >> step & 1
            assert [p[start] for p in decontam.walks(words, repeat)[1]] == read


def test_many_items_alike_in_a_repeated_text(vocabulary, monkeypatch):
    """Hits are looked at in parts; items that share words are told apart by the exact distance alone."""
    common = vocabulary[:20]
    items = [common + vocabulary[100 + k:104 + k] for k in range(0, 200, 4)]
    text = (common + vocabulary[900:905]) * 50 + items[7] + common * 30
    want = sorted(i for i, item in enumerate(items) if edits(item, text) <= Pattern(item).allowed)
    index = Items([" ".join(i).encode() for i in items])
    whole = index.find([view(text)])
    assert sorted(i for i, _, _, _ in whole[0]) == want and (7, 0) in {(i, e) for i, e, _, _ in whole[0]}
    monkeypatch.setattr(decontam, "HITS_AT_ONCE", 10)
    monkeypatch.setattr(decontam, "WORDS_AT_ONCE", 100)
    assert index.find([view(text)]) == whole


def test_items_in_blocks_of_bytes(spark, documents, vocabulary, monkeypatch):
    monkeypatch.setattr(decontam, "BYTES_AT_ONCE", 300)
    items = [" ".join(vocabulary[k * 20:k * 20 + 20]) for k in range(12)]
    bench = spark.createDataFrame([(k % 3, t) for k, t in enumerate(items)], "item_id bigint, text string")
    got = decontam.contaminated(documents([(i, f"a {t} b") for i, t in enumerate(items)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i % 3) for i in range(12)]
