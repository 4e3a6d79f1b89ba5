"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride shards.

Every sequence has a dense index. A keyed Feistel network permutes the smallest power of four that
covers all indexes; an image outside of the table is put through it again until it falls inside
(cycle-walking), which leaves a permutation of exactly the table's indexes. The image is the
sequence's global slot, so the training order needs no sort by random numbers, and any part of it
can be computed again from the key. A range of slots is a shard: a file of records of one length,
in which slot s of the shard starts at byte s * stride. A reader that stopped at slot k goes on
with a seek.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm.bpe import Tokenizer
from gridspark.llm.common import TAG_BITS, stage

# Record: 1 byte "doc_id is known", 8 bytes doc_id, 4 bytes number of the sequence in its document,
# 4 bytes tokens used (all big-endian), the ids (little-endian, padded), and a closing newline.
HEADER = 17
# The shards are written in so many turns: no more than that part of all tokens is being shuffled at a time.
TURNS = 4
ROUNDS = 6
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & self.mask)
        return right << np.uint64(self.half) | left  # the halves change places once more

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(x.astype(np.uint64), keys)
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def forward(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def backward(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def sequences(ids: DataFrame, length: int, end: int, width: int) -> DataFrame:
    """(doc_id, seq_no, n_tokens, data) from (doc_id, ids): every document's ids and the end id,
    cut into runs of ``length``; ``data`` holds them in ``width`` bytes each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, used, data = [], [], [], []
            for i, blob in enumerate(batch.column("ids")):
                row = np.append(np.frombuffer(blob.as_py() or b"", "<u4"), np.uint32(end)).astype(f"<u{width}")
                for k, start in enumerate(range(0, len(row), length)):
                    part = row[start:start + length]
                    owner.append(i)
                    number.append(k)
                    used.append(len(part))
                    data.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                 pa.array(used, pa.int32()), pa.array(data, pa.binary())], ["doc_id", "seq_no", "n_tokens", "data"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        cut, "doc_id bigint, seq_no int, n_tokens int, data binary")


def _big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def _number(data: Column, at: int, size: int) -> Column:
    """A big-endian number at a byte position that starts at 1; 8 bytes are a signed long."""
    # A negative base asks for a signed result.
    return F.conv(F.hex(F.substring(data, at, size)), 16, -10).cast("long")


class TrainingOrder:
    """Shards of token sequences below ``path`` (a folder that all executors see)."""

    def __init__(self, path: str, n: int, length: int, width: int, per_shard: int, key: int):
        self.path, self.n, self.length, self.width, self.per_shard, self.key = path, n, length, width, per_shard, key
        self.stride = HEADER + length * width + 1
        self.shards = -(-n // per_shard)

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset of a slot."""
        return slot // self.per_shard, slot % self.per_shard * self.stride

    def records(self, spark: SparkSession, start: int = 0, stop: int | None = None) -> DataFrame:
        """Records of the slots from ``start`` to ``stop`` in the files: slot, shard, offset, doc_id, seq_no,
        n_tokens and ids (binary, little-endian, ``width`` bytes each, without padding)."""
        stop = self.n if stop is None else min(stop, self.n)
        if not self.n:
            return spark.createDataFrame([], "slot bigint, shard int, offset bigint, doc_id bigint, seq_no int, n_tokens int, ids binary")
        first, last = start // self.per_shard, max(start, stop - 1) // self.per_shard
        files = spark.read.format("binaryFile").load(self.path).where(F.col("shard").between(first, last))
        slots = F.sequence(F.lit(0), (F.col("length") / self.stride).cast("long") - 1)
        record = F.substring("content", F.col("at") * self.stride + 1, F.lit(self.stride))
        rows = (files.where("length > 0").select("shard", "content", F.explode(slots).alias("at"))
                .select("shard", (F.col("shard").cast("long") * self.per_shard + F.col("at")).alias("slot"),
                        (F.col("at") * self.stride).alias("offset"), record.alias("record"))
                .where(F.col("slot").between(start, stop - 1)))
        used = _number(F.col("record"), 14, 4)
        return rows.select("slot", "shard", "offset",
                           F.when(F.substring("record", 1, 1) == F.lit(b"\x01"), _number(F.col("record"), 2, 8)).alias("doc_id"),
                           _number(F.col("record"), 10, 4).cast("int").alias("seq_no"), used.cast("int").alias("n_tokens"),
                           F.substring("record", HEADER + 1, (used * self.width).cast("int")).alias("ids"))


def materialise_order(docs: DataFrame, tokenizer: Tokenizer, path: str, length: int = 512, end: int = 50_256,
                      key: int = 42, per_shard: int = 8192) -> TrainingOrder:
    """Tokenise ``docs`` (doc_id, text), give every sequence its slot and write the shards to ``path``.

    A null or empty text is one sequence that holds the end id only; a null doc_id stays null. Ids
    take two bytes if the vocabulary and ``end`` allow it, else four. Texts are tokenised once: the
    sequences are staged, numbered by input partition (one count each) and position, and moved once,
    straight to their shard, in ``TURNS`` turns. Shards are of equal size whatever the documents hold,
    and one task sorts and writes one shard, of about ``per_shard * length * width`` bytes (8 MB).
    """
    width = 2 if max(end, tokenizer.largest) < 2**16 else 4
    ids = docs.select("doc_id", tokenizer.encode(F.col("text")).alias("ids"))
    staged = stage(sequences(ids, length, end, width).withColumn("tag", F.monotonically_increasing_id()), "sequences")
    # One row per input partition.
    counts = sorted(staged.groupBy(F.shiftright("tag", TAG_BITS).alias("p")).count().collect())
    known = np.array([p for p, _ in counts], np.int64)
    before = np.concatenate([[0], np.cumsum([c for _, c in counts], dtype=np.int64)])
    n = int(before[-1])
    order = TrainingOrder(path, n, length, width, per_shard, key)

    @F.arrow_udf("bigint")
    def slot(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        feistel = Feistel(n, key)
        for tags in batches:
            tags = tags.to_numpy(zero_copy_only=False)
            index = before[np.searchsorted(known, tags >> TAG_BITS)] + (tags & ((1 << TAG_BITS) - 1))
            yield pa.array(feistel.forward(index))

    padding = F.lit((end).to_bytes(width, "little"))
    record = F.concat(F.when(F.col("doc_id").isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01")),
                      _big_endian(F.coalesce("doc_id", F.lit(0)), 8), _big_endian(F.col("seq_no"), 4), _big_endian(F.col("n_tokens"), 4),
                      F.rpad("data", length * width, padding))
    # The text writer puts out the bytes of a string as they are, and a newline after each: with
    # Spark's own commit protocol, a lost or repeated task leaves no half-written shard.
    numbered = staged.withColumn("slot", slot("tag")).withColumn("shard", (F.col("slot") / per_shard).cast("int"))
    each = max(1, -(-order.shards // TURNS))
    for first in range(0, order.shards, each):
        (numbered.where(F.col("shard").between(first, first + each - 1))
         .repartitionById(each, F.col("shard") - first).sortWithinPartitions("shard", "slot")
         .select(record.cast("string").alias("value"), "shard")
         .write.mode("append").option("lineSep", "\n").partitionBy("shard").text(path))
    return order
