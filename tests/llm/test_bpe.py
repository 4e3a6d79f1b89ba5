import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from gridspark.llm import bpe, queries
from gridspark.llm.bpe import Encoder, RankQueue, Tokenizer, id_array, parse_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = parse_ranks(f.read())
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(RANKS, public_tokenizers.PATTERN)


def encoded(encoder, texts):
    return encoder.encode([np.frombuffer(t.encode(), np.uint8) for t in texts])


def check(encoder, texts):
    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text), text[:80]
        assert encoder.decode(ids) == text.encode()


def test_edge_cases(encoder):
    check(encoder, ["", " ", "a", "aaaa" * 1000 + "b", "abab" * 333, "  two  spaces\n\n\tand tabs  ", "foo \n bar", "don't we'll I'M", "x 　 y",
                    "=-" * 500, "😀😃" * 50, "\x1c\x1f a\x85b", "0" * 999, "<|endoftext|>", "naïve café", "​﻿", "a\x00b"])


def test_long_pre_tokens(encoder):
    random.seed(1)
    check(encoder, ["".join(random.choice("abcdehinorst") for _ in range(n)) for n in (5_000, 60_000)] + ["ab" * 50_000, "a" * 65_537])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aab b\n\t 's,.0é😀中"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_as_the_library_does(encoder, texts):
    check(encoder, texts)


def test_every_character_class(encoder):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    check(encoder, [f"a{c}{c} b{c}1" for c in points])


def test_a_small_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "PARTS_REMEMBERED", 20)
    encoder = Encoder(RANKS, public_tokenizers.PATTERN)
    random.seed(4)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 9))) for _ in range(200)]
    for _ in range(10):
        check(encoder, [" ".join(random.choices(words, k=50)) for _ in range(5)])


def test_equal_hashes_are_told_apart(monkeypatch):
    """Parts are compared byte by byte: a hash of two bits does not change the result."""
    whole = bpe._hashes
    monkeypatch.setattr(bpe, "_hashes", lambda *a: whole(*a) & np.uint64(3))
    encoder = Encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(3):
        check(encoder, ["the cat sat on the mat", "another text with  words", "", "cat the on sat"])


def test_other_ranks_than_trained_ones():
    """Any ranks will do, also where a merge makes a pair of lower rank."""
    random.seed(9)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = list({bytes(random.choice(b"abc") for _ in range(random.randrange(2, 6))) for _ in range(40)})
        ranks |= {t: 256 + i for i, t in enumerate(random.sample(tokens, len(tokens)))}
        theirs = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        mine = Encoder(ranks, r"\S+|\s+")
        texts = ["".join(random.choice("abc") for _ in range(random.randrange(200))) for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoded(mine, texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_plain_words_are_merged_where_they_lie(monkeypatch):
    """Words of letters go to the merger without the pattern, each once, and a token as a whole stays that token."""
    encoder, cut = Encoder(RANKS, public_tokenizers.PATTERN), []
    parts = encoder._encode_parts
    monkeypatch.setattr(encoder, "_encode_parts", lambda some, *words: cut.extend(some) or parts(some, *words))
    monkeypatch.setattr(bpe, "MERGE_BYTES", 50)
    random.seed(6)
    words = ["".join(random.choice("abcéüß") for _ in range(random.randrange(1, 9))) for _ in range(300)]
    check(encoder, [" ".join(words), "\u00d7a b\u00d7 c\u00f7d \u00aa \u00b5x \u00c3\u00d7", "I'll d'un ' s 's", " the The  the", "\u00ff\u00c0 \u0100 x1 \u4e2d"])
    assert not {w.encode() for w in words} & {p.strip() for p in cut}
    for _ in range(20):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = list({bytes(random.choice(b" abc") for _ in range(random.randrange(2, 6))) for _ in range(60)})
        ranks |= {t: 256 + i for i, t in enumerate(random.sample(tokens, len(tokens)))}
        theirs = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(random.choice("aabbcc ") for _ in range(random.randrange(200))) for _ in range(10)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoded(Encoder(ranks, public_tokenizers.PATTERN), texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_queue_gives_the_lowest_rank():
    random.seed(3)
    queue, held = RankQueue(300_000), []
    for _ in range(3000):
        if held and random.random() < 0.5:
            rank, _ = queue.pop()
            assert rank == min(held)
            held = [r for r in held if r != rank]
        else:
            rank = random.choice([random.randrange(300_000), random.randrange(100)])
            queue.push(rank, np.array([1]))
            held.append(rank)


def test_columns(spark, documents):
    tokenizer = Tokenizer(PATH, public_tokenizers.PATTERN)
    docs = documents([(1, "hello world"), (2, None), (3, ""), (None, "x" * 200_000), (1, "hello world")])
    rows = docs.select("doc_id", "text", tokenizer.encode("text").alias("ids")).withColumn("back", tokenizer.decode("ids")).withColumn("list", id_array("ids"))
    for r in rows.collect():
        assert r.list == REFERENCE.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert documents([]).select(tokenizer.encode("text")).count() == 0


def task(monkeypatch, name):
    """The function that tasks run for a column function of ``Tokenizer``."""
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda kind: lambda f: lambda column: f)
    return getattr(Tokenizer(PATH, public_tokenizers.PATTERN), name)(None)


def test_decoding_needs_no_encoder(monkeypatch, encoder):
    """A worker that decodes holds the bytes of the ids only, and takes many rows, or a part of a long one, at once."""
    def never(*_):
        raise AssertionError("an encoder was built to decode")

    texts = ["", "naïve café 中", "a" * 70, " two  words ", "😀" * 9, "the cat " * 50]
    ids = [*encoded(encoder, texts), None, b""]
    monkeypatch.setattr(bpe, "_encoder", never)
    monkeypatch.setattr(bpe, "Encoder", never)
    for at_once in (3, 20, 1 << 17):
        monkeypatch.setattr(bpe, "IDS", at_once)
        got = list(task(monkeypatch, "decode")(iter([pa.array(ids, pa.binary()), pa.array([], pa.binary()), pa.array([None], pa.binary())])))
        assert [x.to_pylist() for x in got] == [[*[t.encode() for t in texts], None, b""], [], [None]]
    for wrong in (len(RANKS), 2**32 - 1):
        with pytest.raises((KeyError, IndexError)):
            list(task(monkeypatch, "decode")(iter([pa.array([np.array([wrong], "<u4").tobytes()])])))


def test_a_batch_is_taken_in_equal_parts(monkeypatch):
    """No call of the encoder gets much more than its share: the largest decides how much memory a worker keeps."""
    sizes, whole = [], Encoder.encode
    monkeypatch.setattr(bpe, "TEXT_BYTES", 1000)
    monkeypatch.setattr(Encoder, "encode", lambda self, texts: sizes.append(sum(map(len, texts))) or whole(self, texts))
    texts = [f"some text {i:02}" for i in range(100)]  # 1,200 bytes
    out = next(task(monkeypatch, "encode")(iter([pa.array(texts)])))
    assert max(sizes) < 650 and sum(sizes) == 1200
    assert [np.frombuffer(x, "<u4").tolist() for x in out.to_pylist()] == [REFERENCE.encode_ordinary(t) for t in texts]
    assert [x.to_pylist() for x in task(monkeypatch, "encode")(iter([pa.array(["", None]), pa.array([], pa.string())]))] == [[b"", b""], []]


def test_digests_take_one_worker(documents):
    """Encoding and decoding for the digests are one step, so that a core has one worker that holds an encoder."""
    texts = ["the cat", None, "", "naïve café 中", "a" * 300]
    table = documents(list(enumerate(texts)))
    got = queries.token_digests(table)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for row in got.collect():
        text = (texts[row.doc_id] or "").encode()
        ids = np.array(REFERENCE.encode_ordinary(text.decode()), "<u4")
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
    bpe = queries.tokenizer()
    apart = table.select("doc_id", bpe.encode("text").alias("ids")).withColumn("decoded", bpe.decode("ids"))
    assert table.select("doc_id", bpe.encode_and_decode("text").alias("b")).select("doc_id", "b.*").exceptAll(apart).isEmpty()
