import numpy as np
import public_tokenizers
import pytest

from gridspark.llm.bpe import Tokenizer
from gridspark.llm.order import Feistel, materialise_order
from gridspark.runtime import new_dir

TOKENIZER = Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    feistel = Feistel(n, 7)
    image = feistel.forward(np.arange(n))
    assert sorted(image.tolist()) == list(range(n))
    assert feistel.backward(image).tolist() == list(range(n))


def test_keys_differ_and_order_is_gone():
    a, b = (Feistel(10_000, k).forward(np.arange(10_000)) for k in (1, 2))
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(a, np.arange(10_000))[0, 1]) < 0.05


def test_files_hold_every_sequence_once(spark, documents, tmp_path):
    docs = documents([(i, f"word{i} " * (i * 7)) for i in range(60)] + [(-5, None), (None, "no id"), (3, "again"), (2**62, "")]).repartition(5)
    order = materialise_order(docs, TOKENIZER, new_dir(spark, "order"), length=32, per_shard=10)
    rows = order.records(spark).collect()
    assert sorted(r.slot for r in rows) == list(range(order.n))
    assert all((r.shard, r.offset) == order.place(r.slot) for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.seq_no)):
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert len(ids) == r.n_tokens <= 32
        if r.doc_id != 3:
            got.setdefault(r.doc_id, []).extend(ids)
    want = {d.doc_id: np.frombuffer(bytes(d.ids), "<u4").tolist() + [50256]
            for d in docs.where("doc_id <> 3 OR doc_id IS NULL").select("doc_id", TOKENIZER.encode("text").alias("ids")).collect()}
    assert got == want
    part = order.records(spark, 7, 23).collect()
    assert sorted(r.slot for r in part) == list(range(7, 23))
    # Shards are equally long files of records, with no byte more.
    sizes = {r.shard: r.length for r in spark.read.format("binaryFile").load(order.path).select("shard", "length").collect()}
    assert sizes == {s: order.stride * min(10, order.n - 10 * s) for s in range(order.shards)}


def test_same_key_same_order_and_empty_table(spark, documents):
    docs = documents([(i, f"t {i}") for i in range(50)]).coalesce(2)
    first, second, third = (
        [(r.slot, r.doc_id) for r in materialise_order(docs, TOKENIZER, new_dir(spark, "order"), length=16, key=k).records(spark).orderBy("slot").collect()]
        for k in (1, 1, 2))
    assert first == second != third
    assert materialise_order(documents([]), TOKENIZER, new_dir(spark, "order")).records(spark).count() == 0
