import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridspark.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "Hello, world's best  day\n", "naïve café 😀 ok", "a  b\n c\tx  ", " ", "   ", "x", "ﬁ é ①\xa0 z", "a▁b", "<|endoftext|> <s> <0x0A>",
         "日本語のテキスト 中文", "　 wide", "tab\t \x1c x", "long " * 3000, "zq" * 2000, "same text", "same text", "é  y", "<unk>"]


def byte_table():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in printable}, 0
    for b in range(256):
        if b not in printable:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def brute():
    """Whole texts by the libraries, groups by plain loops over ends, counts over all documents."""
    a, b, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    a.encode_special_tokens = True
    entries = {i: bytes(table[c] for c in e) if all(c in table for c in e) else e.encode() for e, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [entries[i] for i in ids_a], [piece(i) for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], []
        ends = lambda parts: [sum(map(len, parts[:i + 1])) for i in range(len(parts))] if len(parts) < 200 else list(__import__("itertools").accumulate(map(len, parts)))
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        shared, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in shared:
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        return ids_a, ids_b, groups

    def all_of(docs):
        found = [(i, *one(t)) for i, t in docs]
        links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for *_, groups in found]
        count = Counter(p for own in links for p in own)
        highest = defaultdict(int)
        for (x, _), n in count.items():
            highest[x] = max(highest[x], n)
        out = []
        for (i, ids_a, ids_b, groups), own in zip(found, links, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((i, len(ids_a), len(ids_b), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == highest[p[0]]),
                        sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return out

    return all_of


def run(docs):
    found = align.alignment(docs, align.ByteTokens(A), align.PieceTokens(B))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent, at_once", [(align.FREQUENT, align.LINKS_AT_ONCE), (5, 7)])
def test_against_brute_force(spark, brute, monkeypatch, frequent, at_once):
    """Also with few frequent pairs, so that most are looked up by a shuffle."""
    monkeypatch.setattr(align, "FREQUENT", frequent)
    rows = [(None if i == 4 else i % 15, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, n_a int, tag int").repartition(3)
    assert sorted(map(repr, map(tuple, run(docs).collect()))) == sorted(map(repr, brute(rows)))


def test_documents(spark, brute):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, run(docs).collect())) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_wide_groups_are_joined_in_slices(monkeypatch):
    """Groups with many ids on both sides, whatever the number of pairs joined at once."""
    import numpy as np

    rng = np.random.default_rng(4)
    sides = []
    for _ in range(2):
        group = np.sort(np.concatenate([np.arange(9), rng.integers(0, 9, 300)]))
        sides.append((group, rng.integers(0, 40, len(group))))
    doc_of = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    (ga, a), (gb, b) = sides
    want = Counter((int(doc_of[g]), int(x) << 32 | int(y)) for g, x in zip(ga, a, strict=True) for h, y in zip(gb, b, strict=True) if g == h)
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(align, "LINKS_AT_ONCE", at_once)
        found = align._links(ga, a, gb, b, doc_of)
        assert {(r["doc"], r["key"]): r["n_sum"] for r in found.to_pylist()} == want


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
