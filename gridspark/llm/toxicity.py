"""Toxicity by the nearest labelled examples.

Terms are the words of the text (runs of letters, digits and bytes beyond ASCII, in ASCII lower case); a run of more than
``LONG`` bytes, as in scripts that set no spaces, gives its runs of ``RUN`` bytes instead. The labelled sample, one example
per distinct text, gives the vocabulary: all its terms. A term's weight is its squared IDF (so that a word of one example is not
drowned by many common ones) times its evidence: how little of the difference between its documents' labels chance explains
(Chernoff's bound), as a share of what rules chance out over all terms tried. Examples are unit vectors of weighted term counts, and a text's neighbours are those with the largest cosine.

They are found by a block-max inverted index: examples with the same heaviest term stand together in blocks, and each term
has the largest weight in every block beside its postings. The largest weights bound what any example of a block can
reach; those with the highest bounds are scored first, and of the others those whose bound is below the k-th cosine so far are skipped. Nothing that could be
among the nearest is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import stage, text_buffers, with_columns
from gridspark.llm.words import mixed, power_table

# Longer runs of word bytes give their runs of so many bytes.
LONG, RUN = 24, 7
# The sample: texts per label and their size at most. The chance that any term has full weight by accident.
TEXTS, TEXT_BYTES = 1500, 16_384
ACCIDENT = 1e-3
NEIGHBOURS, BLOCK = 15, 32
# The share of toxic labels counts as much as a neighbour of this squared cosine.
PRIOR_WEIGHT = 0.5
SEED = 11
# Blocks scored first, at least, and as a share of all: one round more costs as much as a few blocks. Cosines this close are equal.
FIRST_BLOCKS, FIRST_SHARE, CLOSE = 4, 4, 1e-9
AT_ONCE, POSTINGS_AT_ONCE = 4 << 20, 4 << 20
# Bytes of short texts taken apart together.
TOGETHER = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A byte as words see it, 0 between words.
_WORD = np.zeros(256, np.uint8)
for _c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _WORD[_c] = _c + 32 if 65 <= _c <= 90 else _c


def _terms(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``values``: odd ones of whole words, even ones of the pieces of long runs."""
    size = ends - starts
    n = size[~long]
    place = ranges(np.zeros(len(n), np.int64), n)
    data = values[ranges(starts[~long], n)].astype(np.uint64) * power_table(LONG)[place]
    words = np.add.reduceat(data, np.cumsum(n) - n) + n.astype(np.uint64) if len(n) else np.empty(0, np.uint64)
    at = ranges(starts[long], np.maximum(0, size[long] - RUN + 1))
    pieces = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        pieces = pieces << np.uint64(8) | values[at + k]
    return np.concatenate([mixed(words) | np.uint64(1), mixed(pieces) & ~np.uint64(1)])


def terms_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of several texts, and the text that each is in."""
    # A zero after each text keeps its last word apart from the next text.
    values = np.concatenate([x for t in texts for x in (_WORD.take(t), _WORD[:1])])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], values != 0]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    long = size > LONG
    own = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))))
    return _terms(values, starts, ends, long), np.concatenate([own[~long], np.repeat(own[long], size[long] - RUN + 1)])


def blocks_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """The terms of a whole text, a block of bytes at a time; each block takes up the word at the end of the one before."""
    tail, within = np.empty(0, np.uint8), False
    for start in range(0, max(1, len(data)), AT_ONCE):
        values = np.concatenate([tail, _WORD[data[start:start + AT_ONCE]]])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], values != 0, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts > LONG
        if within:
            # The tail is the end of a long run whose pieces are known.
            long[0] = True
        tail, within = tail[:0], False
        if start + AT_ONCE < len(data) and len(ends) and ends[-1] == len(values):
            if long[-1]:
                tail, within = values[1 - RUN:], True
            else:
                tail, starts, ends, long = values[starts[-1]:], starts[:-1], ends[:-1], long[:-1]
        yield _terms(values, starts, ends, long)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``first`` and have so many numbers, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def _weights(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A unit vector of a text's terms from their counts and the terms' own weights."""
    w = (1 + np.log(counts)) * own
    return w / max(1e-12, np.sqrt((w * w).sum()))


@dataclass
class Index:
    terms: np.ndarray  # hashes, in order
    own: np.ndarray  # weight of each term
    starts: np.ndarray  # the examples with term i are places[starts[i]:starts[i + 1]], in index order
    places: np.ndarray
    values: np.ndarray  # and its weights in their unit vectors
    ids: np.ndarray  # doc_id of each example, in index order
    toxic: np.ndarray
    share: float  # of toxic labels among all labelled texts
    vote: np.ndarray  # weight of an example's vote: the sample has as many of either label as it can
    line: tuple[float, float]  # calibration

    def __post_init__(self):
        """The block maxima: an entry per term and block of ``BLOCK`` examples in which it is."""
        block = self.places // BLOCK
        new = np.concatenate([[True], block[1:] != block[:-1]])[:len(block)]
        new[self.starts[:-1]] = True
        first = np.flatnonzero(new)
        self.blocks = -(-len(self.ids) // BLOCK)
        self.entry_block = block[first].astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.values, first) if len(first) else self.values
        self.entry_first = np.append(first, len(block))
        self.entries = np.searchsorted(first, self.starts)
        # Where the terms of each value of the upper bits start, for some four values a term.
        self.bits = len(self.terms).bit_length() + 2
        self.upper = np.searchsorted(self.terms, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def __getstate__(self):
        return {f: self.__dict__[f] for f in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def weights(self) -> np.ndarray:
        """All weights as (block, term, place in block), for small indexes."""
        out = np.zeros((self.blocks * BLOCK, len(self.terms)), np.float32)
        out[self.places, np.repeat(np.arange(len(self.terms)), np.diff(self.starts))] = self.values
        return out.reshape(-1, BLOCK, len(self.terms)).transpose(0, 2, 1)

    def _places(self, x: np.ndarray) -> np.ndarray:
        """The place of every hash among the terms; -1 if it is none."""
        at = self.upper[x >> np.uint64(64 - self.bits)].astype(np.int64)
        todo = np.flatnonzero(at < len(self.terms))
        at[at == len(self.terms)] = -1
        while len(todo):
            there = self.terms[at[todo]]
            at[todo[there > x[todo]]] = -1
            todo = todo[there < x[todo]]
            at[todo] += 1
            at[todo[at[todo] == len(self.terms)]] = -1
            todo = todo[at[todo] >= 0]
        return at

    def vector(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a byte string that the index has, and their weights in a unit vector; the text is read a block at a time."""
        found, counts = np.empty(0, np.int64), np.empty(0)
        for x in blocks_of(data):
            x, n = _counted(x)
            at = self._places(x)
            own, n = at[at >= 0], n[at >= 0]
            if len(found):
                own, at = np.unique(np.concatenate([found, own]), return_inverse=True)
                n = np.bincount(at, np.concatenate([counts, n]), len(own))
            found, counts = own, n
        return found, _weights(counts, self.own[found])

    def vectors(self, texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``vector`` of every text; short ones are taken apart together."""
        some, held = [], 0
        for text in texts:
            if some and held + len(text) > TOGETHER:
                yield from self._vectors(some)
                some, held = [], 0
            some.append(text)
            held += len(text)
        yield from self._vectors(some)

    def _vectors(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(texts) < 2:
            yield from map(self.vector, texts)
            return
        x, own = terms_of(texts)
        at = self._places(x)
        there = at >= 0
        found, counts = _counted(own[there] * len(self.terms) + at[there])
        cuts = np.searchsorted(found, np.arange(len(texts) + 1) * len(self.terms)).tolist()
        found -= np.repeat(np.arange(len(texts)) * len(self.terms), np.diff(cuts))
        for low, high in pairwise(cuts):
            yield found[low:high], _weights(counts[low:high], self.own[found[low:high]])

    def nearest(self, found: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest positive cosine, ties by index order, and their cosines; ``without`` is left out."""
        sims, _ = self.cosines(found, w, k, without)
        maybe = np.flatnonzero(sims > 0)
        if len(maybe) > k:
            maybe = maybe[sims[maybe] >= np.partition(sims[maybe], -k)[-k] - CLOSE]
        order = np.lexsort((maybe, -np.round(sims[maybe], 9)))[:k]
        return maybe[order], sims[maybe[order]]

    def cosines(self, found: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, int]:
        """The cosines of all examples that may be among the ``k`` nearest, 0 in the blocks skipped; and how many blocks were scored."""
        n, scored = len(self.ids), 0
        sims = np.zeros(n)
        first = self.entries.take(found)
        size = self.entries.take(found + 1) - first
        entry, weight = ranges(first, size), np.repeat(w, size)
        block = self.entry_block.take(entry)
        bound = np.bincount(block, self.entry_max.take(entry) * weight, self.blocks)
        order = np.argsort(-bound, kind="stable")
        least, split = 0.0, max(FIRST_BLOCKS, self.blocks // FIRST_SHARE)
        for blocks in (order[:split], order[split:]):
            now = blocks[(bound[blocks] > 0) & (bound[blocks] * (1 + CLOSE) + 2 * CLOSE >= least)]
            if not len(now):
                break
            scored += len(now)
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            mine = np.flatnonzero(chosen.take(block))
            own = entry.take(mine)
            first = self.entry_first.take(own)
            size = self.entry_first.take(own + 1) - first
            at = ranges(first, size)
            sims += np.bincount(self.places.take(at), self.values.take(at) * np.repeat(weight.take(mine), size), n)
            if without >= 0:
                sims[without] = 0
            if n > k and scored == split:
                least = np.partition(sims, n - k)[n - k]
        return sims, scored

    def raw(self, best: np.ndarray, sims: np.ndarray) -> float:
        """The share of toxic votes, weighted by squared cosine, with the prior as one more vote."""
        votes = sims * sims * self.vote[best]
        return float((votes[self.toxic[best] == 1].sum() + PRIOR_WEIGHT * self.share) / (votes.sum() + PRIOR_WEIGHT))

    def score(self, raw: float) -> float:
        a, b = self.line
        return float(1 / (1 + np.exp(-(a * _logit(raw) + b))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrated(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on the raw score's logit, held near (1, 0); Newton's method, each step halved until it helps."""
    x, start = np.stack([_logit(raw), np.ones(len(raw))], axis=1), np.array([1.0, 0.0])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + ((beta - start) ** 2).sum() / 2)

    beta = start
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + beta - start
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
        while np.abs(step).max() > 1e-6 and loss(beta - step) > loss(beta):
            step = step / 2
        beta = beta - step
    return float(beta[0]), float(beta[1])


def _postings(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, documents of each, places, counts) of all terms in order, in parts by the upper bits of the term; a part has a few million places."""
    kind = np.uint16 if len(texts) < 1 << 16 else np.int32
    bits = max(0, (sum(len(t) for t in texts) // POSTINGS_AT_ONCE).bit_length())
    for part in range(1 << bits):
        found = []
        for t in texts:
            own = [x if not bits else x[x >> np.uint64(64 - bits) == part] for x in blocks_of(t)]
            found.append(_counted(np.concatenate(own)))
        place = np.repeat(np.arange(len(texts), dtype=kind), [len(x) for x, _ in found])
        x, counts = np.concatenate([x for x, _ in found]), np.concatenate([c.astype(np.int32) for _, c in found])
        del found
        order = np.argsort(x, kind="stable")
        x = x[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
        yield x[first], np.diff(np.append(first, len(x))), place[order], counts[order]


def _spans(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of terms with about a million postings each."""
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + (1 << 20))))
        high = min(high, len(starts) - 1)
        yield low, high
        low = high


def build(ids: list[int], texts: list[np.ndarray], toxic: np.ndarray, totals: tuple[int, int]) -> Index:
    """The index of labelled examples, whose texts differ; ``totals`` counts all labelled texts by label.

    Index order, by which ties between neighbours go, is by label, then heaviest term, then the order given.
    """
    ids, n, n1 = np.array(ids), len(texts), toxic.sum()
    base = min(max(n1 / n, 1e-6), 1 - 1e-6)
    parts = list(_postings(texts))
    tried = sum(len(place) for _, _, place, _ in parts)
    weighted = []
    for terms, df, place, counts in parts:
        hits = np.bincount(np.repeat(np.arange(len(df)), df), toxic[place], len(df))
        # The chance to meet such a share of toxic documents among df is at most exp(-df * divergence).
        share = hits / df
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = df * (np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base))))
        weighted.append((np.log((1 + n) / (1 + df)) + 1) ** 2 * np.minimum(1, np.maximum(0, evidence) / np.log(max(1, tried) / ACCIDENT)))
    terms, df, place, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    own = np.concatenate(weighted)
    del parts, weighted
    starts = np.concatenate([[0], np.cumsum(df)])
    # Postings are weighed, and then moved, a part at a time, as the driver is small.
    values, squares = np.empty(len(place), np.float32), np.zeros(n)
    heaviest, most = np.full(n, -1), np.zeros(n, np.float32)
    for low, high in _spans(starts):
        here, size = slice(starts[low], starts[high]), df[low:high]
        w = (1 + np.log(counts[here])) * np.repeat(own[low:high], size)
        values[here] = w
        squares += np.bincount(place[here], w * w, n)
        # Of terms that several examples have, the last one written stays: the heaviest of each example.
        shared = np.flatnonzero(np.repeat(size > 1, size))
        term, owner, weight = np.repeat(np.arange(low, high), size)[shared], place[here][shared], values[here][shared]
        order = np.lexsort((term, weight))
        top, best = np.full(n, -1), np.zeros(n, np.float32)
        top[owner[order]], best[owner[order]] = term[order], weight[order]
        heaviest, most = np.where(best > most, top, heaviest), np.maximum(best, most)
    del counts
    order = np.lexsort((np.arange(n), heaviest, toxic))
    rank = np.empty(n, place.dtype)
    rank[order] = np.arange(n)
    ids, toxic = ids[order], toxic[order]
    length = np.maximum(1e-12, np.sqrt(squares))
    for low, high in _spans(starts):
        here = slice(starts[low], starts[high])
        to = rank[place[here]]
        sort = np.lexsort((to, np.repeat(np.arange(low, high), df[low:high])))
        values[here] = (values[here] / length[place[here]])[sort]
        place[here] = to[sort]
    share = totals[1] / max(1, sum(totals))
    per = np.array([totals[0] / max(1, n - n1), totals[1] / max(1, n1)])
    index = Index(terms, own, starts, place, values, ids, toxic, share, (per / per.max())[toxic], (1.0, 0.0))
    # Each example against all others, by the terms that these have as well.
    raw = []
    common = np.flatnonzero(np.repeat(df > 1, df))
    common = common[np.argsort(place[common], kind="stable")]
    ends = np.searchsorted(place[common], np.arange(1, n))
    for i, own_postings in enumerate(np.split(common, ends)):
        w = values[own_postings].astype(float)
        found = np.searchsorted(starts, own_postings, "right") - 1
        raw.append(index.raw(*index.nearest(found, w / max(1e-12, np.sqrt((w * w).sum())), NEIGHBOURS, i)))
    raw = np.array(raw)
    index.line = _calibrated(raw, index.toxic, per[index.toxic] / max(1e-9, per[index.toxic].mean()))
    return index


def fit(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, seed: int = SEED) -> Index | None:
    """An index from the texts of ``docs`` that ``labels`` (doc_id, toxic) marks; None without a labelled text.

    Texts that have the same terms (equal but for ASCII case and the amount of white space) are one
    example. Of either label the ``texts`` examples of up to ``TEXT_BYTES`` with the smallest hashes are
    taken: at most 2 * texts * TEXT_BYTES bytes reach the driver. A text with both labels counts as
    toxic; null labels and doc_ids are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.encode(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x09-\x0D ]+", " ")), "UTF-8"))
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    distinct = stage(docs.select("doc_id", key.alias("key"), F.octet_length(text).alias("size")).join(marked, "doc_id")
                     .groupBy("key").agg(F.max("toxic").alias("toxic"), F.min(F.struct("size", "doc_id")).alias("first"))
                     .select("key", "toxic", "first.*"), "toxicity", labels.count())
    found = dict(distinct.groupBy("toxic").count().collect())
    totals = (found.get(0, 0), found.get(1, 0))
    short = distinct.where(F.col("size") <= TEXT_BYTES).select("doc_id", "toxic", "key")
    chosen = [short.where(F.col("toxic") == label).orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(texts).collect() for label in (0, 1)]
    if not any(chosen):
        return None
    picked = spark.createDataFrame([tuple(r) for rows in chosen for r in rows], "doc_id bigint, toxic int, wanted string")
    sample = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where((F.octet_length(text) <= TEXT_BYTES) & (key == F.col("wanted")))
              .select("doc_id", "toxic", "wanted", F.encode(text, "UTF-8").alias("data")).dropDuplicates(["wanted"]).toArrow().sort_by([("doc_id", "ascending"), ("wanted", "ascending")]))
    return build(sample["doc_id"].to_pylist(), list(text_buffers(sample["data"])), sample["toxic"].to_numpy().astype(np.int64), totals)


FOUND = "struct<score:double,neighbours:array<struct<doc_id:bigint,toxic:int,cosine:double>>>"


def assess(text: Column, index: Index | None) -> Column:
    """struct(score, neighbours): the calibrated score of the whole text, and the examples it rests on.

    A text without any term of the index (null and empty ones too) has no neighbours and the score that
    the share of toxic labels gives. Without an index the score is 0.
    """
    if index is None:
        return F.struct(F.lit(0.0).alias("score"), F.array().cast("array<struct<doc_id:bigint,toxic:int,cosine:double>>").alias("neighbours"))

    @F.arrow_udf(FOUND)
    def assessed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores, sizes, examples, cosines = [], [0], [], []
            for vector in index.vectors(text_buffers(texts)):
                best, sims = index.nearest(*vector, NEIGHBOURS)
                scores.append(index.score(index.raw(best, sims)))
                sizes.append(len(best))
                examples.append(best)
                cosines.append(sims)
            at = np.concatenate([*examples, np.empty(0, np.int64)]).astype(np.int64)
            near = pa.StructArray.from_arrays([pa.array(index.ids[at], pa.int64()), pa.array(index.toxic[at].astype(np.int32)),
                                               pa.array(np.concatenate([*cosines, np.empty(0)]))], ["doc_id", "toxic", "cosine"])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), near)],
                                             ["score", "neighbours"])

    return assessed(text)


def with_toxicity(docs: DataFrame, index: Index | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score, predicted (1 from ``threshold`` on) and neighbours; columns with these names are replaced."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), assess(docs["text"], index).alias("found"))
    return rows.select(*with_columns(docs, {
        "score": F.col("found.score"), "predicted": (F.col("found.score") >= threshold).cast("int"), "neighbours": F.col("found.neighbours")}))


def not_toxic(docs: DataFrame, index: Index | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns as they are."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), assess(docs["text"], index).alias("found"))
    return rows.where(F.col("found.score") < threshold).select("row.*")
