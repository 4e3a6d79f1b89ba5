"""Exact deduplication by composable polynomial fingerprints.

A fingerprint of a byte string b is (sum of b[i] * g^i mod m) for two primes m. Of two strings
a and b laid end to end it is h(a) + g^len(a) * h(b): chunks are hashed side by side, in one
matrix product, and a tree of such shifted sums joins them, whatever the text's length.

Equal fingerprints only propose groups. Every chunk of a proposed group's texts is then compared
with the same chunk of the others; where one differs, the group is split by whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import small, stage, tagged, text_buffers, with_columns

WHITE = "[\\x20\\x09-\\x0D]+"
MODULI = (2**31 - 1, 2**31 - 19)
BASES = (1_226_959_387, 1_804_289_383)
CHUNK = 4096
# Bytes compared at once where fingerprints are equal.
PIECE = 1 << 16
KEYS = ["h1", "h2", "n_bytes"]


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class Fingerprints:
    """Fingerprints of byte strings for given moduli below 2^31."""

    def __init__(self, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES):
        self.m = np.array(moduli, np.uint64)
        powers = np.ones((CHUNK, 2))
        for column, (m, g) in enumerate(zip(moduli, bases, strict=True)):
            x = 1
            for i in range(CHUNK):
                powers[i, column] = x
                x = x * g % m
        # A byte times a power is below 2^39, a chunk's sum below 2^51: exact in a double.
        self.powers = powers
        self.moduli, self.bases = moduli, bases

    def shift(self, length: int) -> np.ndarray:
        return np.array([pow(g, length, m) for m, g in zip(self.moduli, self.bases, strict=True)], np.uint64)

    def combine(self, left: np.ndarray, left_length: int, right: np.ndarray) -> np.ndarray:
        """The fingerprint of two strings laid end to end."""
        return (left + self.shift(left_length) * right) % self.m

    def chunk_hashes(self, data: np.ndarray) -> np.ndarray:
        """One row per chunk; a short last chunk needs no padding in meaning, as zeros add nothing."""
        n = len(data)
        if n <= CHUNK:
            return (data.astype(np.float64) @ self.powers[:n])[None, :].astype(np.uint64) % self.m
        whole = n // CHUNK
        parts = [(data[i * CHUNK:(i + 256) * CHUNK][:(min(i + 256, whole) - i) * CHUNK].reshape(-1, CHUNK)
                  .astype(np.float64) @ self.powers).astype(np.uint64) for i in range(0, whole, 256)]
        rest = data[whole * CHUNK:]
        parts.append((rest.astype(np.float64) @ self.powers[:len(rest)])[None, :].astype(np.uint64))
        return np.concatenate(parts) % self.m

    def of(self, data: np.ndarray) -> np.ndarray:
        """Join the chunk hashes pairwise: every round halves them and doubles the shift."""
        h, length = self.chunk_hashes(data), CHUNK
        while len(h) > 1:
            if len(h) % 2:
                h = np.concatenate([h, np.zeros((1, 2), np.uint64)])
            h = (h[0::2] + self.shift(length) * h[1::2] % self.m) % self.m
            length *= 2
        return h[0]


def _fingerprinted(rows: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """``tag, row`` with the fingerprint and length of the normalised text."""

    @F.arrow_udf("struct<h1:bigint,h2:bigint,n_bytes:bigint>")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = Fingerprints(moduli)
        for texts in batches:
            found = [(engine.of(b), len(b)) for b in text_buffers(texts)]
            h = np.array([f for f, _ in found], np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([n for _, n in found], pa.int64())],
                ["h1", "h2", "n_bytes"])

    norm = normalised(F.col("row.text"))
    return (rows.withColumn("norm", norm).withColumn("fp", fingerprint("norm"))
            .select("tag", "row", "fp.*", F.sha2("norm", 256).alias("text_sha256")))


def _pieces(texts: DataFrame) -> DataFrame:
    """(h1, h2, n_bytes, piece, data) of every text, cut one piece at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_bytes", pa.int64()), ("piece", pa.int64()),
                            ("data", pa.binary())])
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in KEYS]
            out, held = [], 0
            for h1, h2, n, data in zip(*keys, text_buffers(batch.column("norm")), strict=True):
                for k in range(max(1, -(-len(data) // PIECE))):
                    out.append((h1, h2, n, k, data[k * PIECE:(k + 1) * PIECE].tobytes()))
                    held += len(out[-1][4])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return texts.select(*KEYS, "norm").mapInArrow(cut, "h1 bigint, h2 bigint, n_bytes bigint, piece bigint, data binary")


def _first(group: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the row that stays (smallest doc_id, nulls last, then input order) and the size; only groups of two or more."""
    return (group.groupBy(*keys)
            .agg(F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("tag").alias("at"))).alias("first"),
                 F.count("*").alias("size"))
            .where("size > 1").select(*keys, F.col("first.id").alias("first_id"), F.col("first.at").alias("first_tag"), "size"))


def classes(docs: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Every row (``tag, row``) with keep_id, group_size, kept and text_sha256 of its group of equal texts.

    Texts are equal if they are after ``normalised``; null counts as empty, and empty texts are a
    group like any other. The row with the smallest doc_id stays, a null doc_id being larger than
    all; of rows with the same doc_id the first in input order stays. Whatever the size of a group,
    its rows are only counted and looked up: counts and minima are combined before they are
    shuffled, and the table of groups is broadcast if a count shows that it is small, else joined
    with skew splitting.
    """
    rows = stage(_fingerprinted(tagged(docs), moduli), "fingerprints")
    narrow = rows.select("tag", F.col("row.doc_id").alias("doc_id"), *KEYS)
    groups = stage(_first(narrow, KEYS), "groups", rows.count())
    lookup = small(groups)
    texts = rows.join(lookup.select(*KEYS), KEYS, "left_semi").select(*KEYS, "tag", F.col("row.doc_id").alias("doc_id"),
                                                            normalised(F.col("row.text")).alias("norm"))
    # Minimum and maximum per piece are combined before the shuffle, so a group of any size
    # sends one pair per task; the group is one text if the two are equal for every piece.
    differing = stage(_pieces(texts).groupBy(*KEYS, "piece").agg(F.min("data").alias("lo"), F.max("data").alias("hi"))
                      .where("lo <> hi").select(*KEYS).distinct(), "differing")
    result = [F.coalesce("first_id", F.col("row.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"),
              F.coalesce(F.col("first_tag") == F.col("tag"), F.lit(True)).alias("kept")]
    if differing.isEmpty():
        return rows.join(lookup, KEYS, "left").select("tag", "row", "text_sha256", *result)
    odd = rows.join(small(differing), KEYS, "left_semi").withColumn("norm", normalised(F.col("row.text")))
    split = stage(_first(odd.select("tag", F.col("row.doc_id").alias("doc_id"), *KEYS, "norm"), [*KEYS, "norm"]), "split")
    plain = rows.join(small(differing), KEYS, "left_anti").join(lookup, KEYS, "left")
    return (plain.select("tag", "row", "text_sha256", *result)
            .unionByName(odd.join(split, [*KEYS, "norm"], "left").select("tag", "row", "text_sha256", *result)))


def exact_groups(docs: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256 (see ``classes``).

    Columns of ``docs`` with one of these names are replaced. An empty table gives an empty one.
    """
    return classes(docs, moduli).select(*with_columns(docs, {c: F.col(c) for c in ("keep_id", "group_size", "kept", "text_sha256")}))


def exact_dedup(docs: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    return classes(docs, moduli).where("kept").select("row.*")
