"""Every registered query against its SQL twin or against a brute-force version, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
import public_tokenizers

import corpus_pipeline
from gridspark.llm import queries
from gridspark.llm.bpe import parse_ranks
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_decontam import edits
from tools.check import connect, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_twin(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = connect(FOLDER).sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert normal(tuple(r) for r in df.collect()) == normal(want)


def test_shards(spark, rows):
    got = queries.QUERIES["op3_shards"](spark, FOLDER).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {
        i: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()), "rows", None) for i, r in rows.items()}
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_tokens(spark, rows):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    ids = {i: library.encode_ordinary(r.text) for i, r in rows.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = queries.QUERIES["op5_byte_bpe"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {
        i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(rows[i].text.encode())) for i, x in ids.items()}
    order = queries.QUERIES["op4_training_order"](spark, FOLDER).collect()
    want = sorted((i, k, sha(np.array((x + [50256])[a:a + 512], "<u2").tobytes())) for i, x in ids.items() for k, a in enumerate(range(0, len(x) + 1, 512)))
    assert sorted((r.doc_id, r.seq_no, r.ids_sha256) for r in order) == want
    assert sorted(r.slot for r in order) == list(range(len(want)))


def test_near_duplicates(spark, rows):
    got = queries.QUERIES["op7_jaccard_join"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute([(i, r.text) for i, r in rows.items()])


def test_benchmark_passages(spark, rows):
    """All whole items that are somewhere in a text, whatever stands between their words."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = set()
    for i, r in rows.items():
        text = words(r.text)
        for k, item in items.items():
            # Enough of its words must be there for a close passage to be possible.
            if len(set(item) & set(text)) >= 0.75 * len(set(item)) - 1 and edits(item, text) <= int(0.25 * len(item)):
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, FOLDER).collect()}
    assert got == want


def test_pipeline(spark, rows):
    """Each stage against what it must do to its own input."""
    from gridspark.llm import decontam, dedup, jaccard
    from tests.llm.test_dedup import brute as dedup_brute

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    scored = {r.doc_id: r.predicted for r in queries.QUERIES["op10_toxicity"](spark, FOLDER).collect()}
    ids = [i for i in rows if scored[i] == 0]
    pairs = [(i, rows[i].text) for i in ids]
    ids = sorted({keep for _, keep, _, _ in dedup_brute(pairs)})
    pairs = [(i, rows[i].text) for i in ids]
    ids = sorted({c for _, c in jaccard_brute(pairs).values()})
    bad = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    ids = [i for i in ids if i not in bad]
    tokens = {r.doc_id: tuple(r) for r in queries.QUERIES["op5_byte_bpe"](spark, FOLDER).collect()}
    out = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert out == {i: tokens[i] for i in ids}
    step = stages["toxicity"](spark, docs, FOLDER)
    assert step.columns == docs.columns and step.count() == sum(p == 0 for p in scored.values())
    assert dedup.exact_dedup(docs).columns == jaccard.one_per_group(docs).columns == docs.columns


def test_learning_queries_have_the_contracts_columns(spark, rows):
    one = queries.QUERIES["op1_language"](spark, FOLDER).collect()
    assert {r.doc_id: r.held_out for r in one} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in rows}
    ten = queries.QUERIES["op10_toxicity"](spark, FOLDER).collect()
    assert {r.doc_id: r.held_out for r in ten} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in ten)
