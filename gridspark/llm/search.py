"""Ranked lexical search, term at a time with a limit on accumulators.

Documents are cut into segments; a task holds one segment's inverted lists at a time. An item's terms are
taken from the rarest to the most frequent of the corpus. While a document that no earlier term has met could
still come among the best, a term's documents get accumulators; as soon as the largest scores that the terms
left can give are together below the k-th best partial score, no accumulator is made any more and the
remaining terms only update those that are there, exactly. A task carries each item's best documents from
segment to segment, so their k-th score also stops accumulators of later segments (and skips items).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gridspark.llm.chunks import runs, slices
from gridspark.llm.common import stage

# Fixed values of the score.
FACTOR, TF_FACTOR, M_FACTOR, SHARE = 1_000_000_000, 1000, 8, 75
# Bytes of item texts that are searched for at once (one item may be longer), and postings and documents of a segment.
BLOCK_BYTES, POSTINGS, SEGMENT = 4 << 20, 2 << 20, 1 << 14
# Results of tasks are cut to the best k in so many groups first.
GROUPS = 256

# Terms are runs of ASCII letters, digits and of everything beyond ASCII; only A-Z are lower-cased.
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (UTF-8 bytes), one after the other, and the number of them in every text."""
    return runs(texts, _TERM, _LOWER)


@dataclass
class Block:
    """Some items: their tags, and for each the codes of its terms and how often it holds them."""

    tags: list[int]
    codes: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: list[bytes]

    @classmethod
    def of(cls, rows: list) -> Block:
        code_of: dict[bytes, int] = {}
        block = cls([], [], [], [])
        for tag, text in rows:
            found = Counter(terms([np.frombuffer((text or "").encode(), np.uint8)])[0].to_pylist())
            if found:
                block.tags.append(tag)
                block.codes.append(np.array([code_of.setdefault(t, len(code_of)) for t in found], np.int64))
                block.repeats.append(np.array(list(found.values()), np.int64))
        block.vocabulary = list(code_of)
        return block


POSTING_ROWS = "doc_id bigint, n bigint, codes binary, tfs binary"


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """One row per document with a term: its number of terms, and codes and frequencies of the block's terms."""
    vocabulary, size = block.vocabulary, max(1, len(block.vocabulary))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in slices(batch.column("text")):
                found, counts = terms(texts)
                code = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(texts)), counts)
                hit = code >= 0
                keys, tf = np.unique(owner[hit] * size + code[hit], return_counts=True)
                ends = np.searchsorted(keys, np.arange(1, len(texts) + 1) * size)
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32))
                packed = [pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(np.ascontiguousarray(x, np.int32))])
                          for x in (keys % size, tf)]
                out = pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(counts, pa.int64()), *packed],
                                                 ["doc_id", "n", "codes", "tfs"])
                yield out.filter(pa.array(counts > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, POSTING_ROWS)


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the block's terms is; ``size`` terms, so ``size`` rows at most are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column("codes"):
                df[np.frombuffer(blob.as_py(), np.int32)] += 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(df[there], pa.int64())], ["code", "df"])

    df = np.zeros(size, np.int64)
    for code, n in held.select("codes").mapInArrow(count, "code bigint, df bigint").groupBy("code").agg(F.sum("df")).collect():
        df[code] = n
    return df


class Best:
    """The k best (score, doc_id) of an item so far: highest score first, equal ones by doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A document with a lower score cannot come in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Segment:
    """Inverted lists of some documents; ``impact`` is what one occurrence of weight 1 adds to a score."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, m: np.ndarray, codes: np.ndarray, tfs: np.ndarray, counts: np.ndarray, size: int):
        self.doc, self.null = doc, null
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), counts)
        impact = (FACTOR * tfs) // (TF_FACTOR * tfs + M_FACTOR * m[owner])
        order = np.argsort(codes, kind="stable")
        self.owner, self.impact = owner[order], impact[order]
        self.ends = np.cumsum(np.bincount(codes, minlength=size))
        self.highest = np.zeros(size, np.int64)
        np.maximum.at(self.highest, codes, impact)

    def list(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[code - 1] if code else 0, self.ends[code])
        return self.owner[part], self.impact[part]

    def search(self, codes: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Bring the documents of this segment into ``best``; ``codes`` from the rarest term to the most frequent."""
        bounds = weights * self.highest[codes]
        codes, weights, bounds = codes[bounds > 0], weights[bounds > 0], bounds[bounds > 0]
        # left[i]: the most that the terms from i on can give to one document.
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        threshold = best.least
        if left[0] < threshold:
            return
        score, survivors, highest = np.zeros(len(self.doc), np.int64), None, 0
        for i, (code, weight) in enumerate(zip(codes.tolist(), weights.tolist(), strict=True)):
            at, impact = self.list(code)
            if survivors is None and left[i] < threshold:
                survivors = np.flatnonzero(score)
            if survivors is None:
                score[at] += weight * impact
                highest = max(highest, int(score[at].max()))
                # The k-th best is not above the best: look for it only where it can stop anything.
                if left[i + 1] < highest and len(score) > best.k:
                    threshold = max(threshold, int(np.partition(score, -best.k)[-best.k]))
            elif len(survivors):
                place = np.minimum(np.searchsorted(at, survivors), len(at) - 1)
                met = at[place] == survivors
                score[survivors[met]] += weight * impact[place[met]]
        found = np.flatnonzero(score >= max(best.least, 1))
        if len(found):
            best.add(score[found], self.doc[found], self.null[found])


def _segments(batches: Iterator[pa.RecordBatch], size: int, n_docs: int, n_terms: int) -> Iterator[Segment]:
    held, n = [], 0

    def build() -> Segment:
        table = pa.Table.from_batches(held)
        blobs = [b"".join(table.column(c).to_pylist()) for c in ("codes", "tfs")]
        codes, tfs = (np.frombuffer(b, np.int32).astype(np.int64) for b in blobs)
        counts = pc.divide(pc.binary_length(table.column("codes")), 4).to_numpy()
        ids = table.column("doc_id")
        m = 100 - SHARE + (SHARE * table.column("n").to_numpy() * n_docs) // n_terms
        return Segment(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(), m, codes, tfs, counts, size)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows + batch.column("codes").nbytes // 4
        if n > POSTINGS or sum(b.num_rows for b in held) >= SEGMENT:
            yield build()
            held, n = [], 0
    if held:
        yield build()


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    size = len(block.vocabulary)
    held = stage(postings(docs, block), "postings")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(held, size)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    plans = []
    for codes, repeats in zip(block.codes, block.repeats, strict=True):
        order = np.lexsort((codes, df[codes]))
        plans.append((codes[order], (weight[codes] * repeats)[order]))
    tags = block.tags

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in plans]
        for segment in _segments(batches, size, n_docs, n_terms):
            for (codes, weights), own in zip(plans, best, strict=True):
                segment.search(codes, weights, own)
        for tag, own in zip(tags, best, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own.score), tag), pa.int64()), pa.array(own.doc, pa.int64(), mask=own.null), pa.array(own.score, pa.int64())],
                ["tag", "doc_id", "score"])

    found = held.mapInArrow(search, "tag bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Two levels: no window sees more than the results of a part of the tasks, however many there are.
    some = Window.partitionBy("tag", "part").orderBy(*order)
    return (found.withColumn("part", F.spark_partition_id() % GROUPS)
            .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("part")
            .withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(*order))).where(F.col("rank") <= k))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each row of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id and score; equal scores are ranked by doc_id, a null doc_id last. All
    documents are searched for all items. Rows are told apart, not ids: a document that is there twice can be ranked
    twice, an item that is there twice is answered twice. Null and empty texts have no terms; such an item has no
    rows. Other columns are not looked at.

    Items go to the tasks in blocks of ``BLOCK_BYTES`` of text, one search of all documents each; so
    the terms, frequencies and items that the driver and a task hold have a fixed bound (and one item's size).
    """
    rows = stage(items.select(F.monotonically_increasing_id().alias("tag"), "item_id", "text"), "items")
    length = F.octet_length(F.coalesce("text", F.lit("")))
    total, largest = rows.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.max(length), F.lit(0))).first()
    blocks = total // BLOCK_BYTES + 1
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("tag"), F.lit(blocks)))
        fullest = dealt.groupBy("block").agg(F.sum(length).alias("b")).agg(F.coalesce(F.max("b"), F.lit(0))).first()[0]
        if fullest <= BLOCK_BYTES + largest:
            break
        blocks *= 2
    found = []
    for b in range(blocks):
        block = Block.of([(r.tag, r.text) for r in dealt.where(F.col("block") == b).select("tag", "text").collect()])
        if block.tags:
            found.append(_search_block(docs, block, k))
    if not found:
        found = [rows.where(F.lit(False)).select("tag", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))]
    answers = reduce(DataFrame.union, [f.select("tag", "rank", "doc_id", "score") for f in found])
    return answers.join(rows.select("tag", "item_id"), "tag").select("item_id", "rank", "doc_id", "score")
