"""Alignment of two tokenizers' tokens by shared byte ends, in Arrow.

A batch of texts becomes two list arrays of ids. Flattened, with the parent index of every token, the bytes of the
tokens are added up per document (a running sum less what it was at the document's first token): every
token's end. A hash join of both sides on (document, end) finds the ends that they share, which cut the tokens into
groups; a running count of them numbers the groups of either side. Tokens of a group are counted per
id before the sides are joined on the group, so a group with many repeats of few ids makes few rows, and
wide groups are joined a bounded number of pairs at a time.

How many documents hold a pair of ids is counted by ``Table.group_by`` in every task and summed by Spark. The
pairs are then looked up: the frequent ones, a bounded number, by broadcast, all others by a shuffle, in which
none of them can be hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.chunks import Content, binary_array, expand, slices, sums
from gridspark.llm.common import stage, tagged

# Stands for a chunk whose ids do not spell its bytes.
WRONG = -1
# Links of distinct ids joined at once, distinct pairs counted before they leave a task, and pairs sent to all tasks.
LINKS_AT_ONCE, PAIRS_HELD, FREQUENT = 1 << 21, 1 << 20, 200_000
# Bytes of text aligned at once, unless one text is longer, of distinct chunks encoded at once, and of chunks remembered by a worker.
TEXTS, JOINED, KNOWN_BYTES = 1 << 20, 1 << 16, 8 << 20


class ByteTokens:
    """A byte-level vocabulary of the ``tokenizers`` library, applied to space + text; special tokens are ordinary text."""

    def __init__(self, path: str):
        self.content = Content(path)

    def build(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.content.data.decode())
        library.encode_special_tokens = True
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        table: dict[int, bytes] = {}
        for entry, i in library.get_vocab(with_added_tokens=True).items():
            table[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        return table, lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A ``sentencepiece`` model, applied to the text, to which it adds the space."""

    def __init__(self, path: str):
        self.content = Content(path)

    def build(self):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=self.content.data)
        table, inner = {}, False
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            table[i] = bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode()
            inner |= " " in table[i].decode(errors="replace").lstrip(" ")
        if inner:
            raise ValueError("a piece goes on after a white space: texts cannot be cut there")
        space = library.piece_to_id("▁")

        def encode(texts: list[str]) -> list[list[int]]:
            # A text starts with the space that the model adds; of a lone space it would see nothing.
            found = library.encode([t[1:] for t in texts], num_threads=1)
            return [ids if len(t) > 1 else [space] for t, ids in zip(texts, found, strict=True)]

        return table, encode


def _may_end_in_space(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the last character before each of ``ends`` may be white space or a control character.

    White space beyond ASCII starts with one of four bytes.
    """
    out = data[ends - 1] <= 32
    for back, leads in ((2, (0xC2,)), (3, (0xE1, 0xE2, 0xE3))):
        at = np.maximum(ends - back, 0)
        out |= np.isin(data[at], leads) & (ends >= back)
    return out


class Side:
    """One tokenizer in a worker: ids of chunks, whose bytes they must spell, and byte lengths of ids."""

    def __init__(self, tokens: ByteTokens | PieceTokens):
        self.table, self.encode = tokens.build()
        entries = [self.table.get(i, b"") for i in range(max(self.table) + 1)]
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.data, self.first = np.frombuffer(b"".join(entries), np.uint8), np.cumsum(self.lengths) - self.lengths

    def __call__(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks one after the other, and their number in every chunk."""
        if not len(distinct):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        starts, ends = offsets[:-1], offsets[1:]
        # Chunks are encoded many at once, end to end, but for those whose end could run into the next one.
        alone = _may_end_in_space(data, ends)
        counts = np.zeros(len(distinct), np.int64)
        plain = np.flatnonzero(~alone)
        sizes = np.cumsum((ends - starts)[plain])
        cuts = np.unique(np.searchsorted(sizes, np.arange(JOINED, (int(sizes[-1]) if len(plain) else 0) + JOINED, JOINED), "right"))
        flat, order, single = [], [], [np.flatnonzero(alone)]
        for group in np.split(plain, cuts):
            if not len(group):
                continue
            joined = data[expand(starts[group], (ends - starts)[group])]
            found = np.array(self.encode([joined.tobytes().decode()])[0], np.int64)
            token_ends, borders = np.cumsum(self.lengths[found]), np.cumsum((ends - starts)[group])
            at = np.searchsorted(token_ends, borders)
            if (len(token_ends) and token_ends[-1] == len(joined) and (token_ends[at] == borders).all()
                    and (self.data[expand(self.first[found], self.lengths[found])] == joined).all()):
                flat.append(found)
                order.append(group)
                counts[group] = np.diff(np.concatenate([[0], at + 1]))
            else:  # some chunk is not spelled by its ids
                single.append(group)
        rest = np.concatenate(single)
        if len(rest):
            texts = [data[starts[i]:ends[i]].tobytes() for i in rest.tolist()]
            found = [x if b"".join([self.table[i] for i in x]) == t else [WRONG] for t, x in zip(texts, self.encode([t.decode() for t in texts]), strict=True)]
            counts[rest] = [len(x) for x in found]
            flat.append(np.array([i for x in found for i in x], np.int64))
            order.append(rest)
        order = np.concatenate(order)
        first = np.empty(len(distinct), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(flat)[expand(first, counts)].astype(np.int32), counts


class Sides:
    """Both tokenizers in a worker, and the ids of chunks seen before."""

    def __init__(self, *tokens: ByteTokens | PieceTokens):
        self.sides = [Side(t) for t in tokens]
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids = [np.empty(0, np.int32) for _ in self.sides]
        self.counts = [np.empty(0, np.int64) for _ in self.sides]

    def __call__(self, chunks: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side all ids of the chunks one after the other, and their number in every chunk."""
        if self.known.nbytes > KNOWN_BYTES:
            self._clear()
        coded = chunks.dictionary_encode()
        rows = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(rows.is_null())
        rows = pc.fill_null(rows, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows[rows < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        rows, out = rows[coded.indices.to_numpy()], []
        for k, side in enumerate(self.sides):
            ids, counts = side(new)
            self.ids[k], self.counts[k] = np.concatenate([self.ids[k], ids]), np.concatenate([self.counts[k], counts])
            first = np.cumsum(self.counts[k]) - self.counts[k]
            out.append((self.ids[k][expand(first[rows], self.counts[k][rows])], self.counts[k][rows]))
        return out


@lru_cache(1)
def _sides(kinds: tuple[type, type], contents: tuple[Content, Content]) -> Sides:
    tokens = [k.__new__(k) for k in kinds]
    for t, c in zip(tokens, contents, strict=True):
        t.content = c
    return Sides(*tokens)


def _chunks(texts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Space + text, cut before spaces, and the number of chunks of every text (none of an empty one).

    No token of either side goes over such a cut: the byte-level splitter ends a pre-token wherever white space
    follows something else, and no piece holds a space after another character. A space after a control
    character or after what may be white space beyond ASCII is left alone.
    """
    space = np.full(1, 32, np.uint8)
    sizes = np.array([len(t) + 1 if len(t) else 0 for t in texts], np.int64)
    if not sizes.sum():
        return pa.array([], pa.large_binary()), sizes
    data = np.concatenate([x for t in texts if len(t) for x in (space, t)])
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    spaces = np.flatnonzero(data == 32)[1:]  # the first byte is one
    cut = np.zeros(len(data), bool)
    cut[spaces[~_may_end_in_space(data, spaces)]] = True
    cut[firsts] = True
    starts = np.flatnonzero(cut)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return binary_array(data, np.append(starts[1:], len(data))), counts


def _list_array(ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> pa.Array:
    kept = ids[np.repeat(good, counts)].astype(np.int64)
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(good, counts, 0))]), pa.array(kept))


# A document's number is above these bits of a key, a byte's place in it (or an id) below.
PLACE_BITS = 40


def _ends(lists: pa.Array, lengths: np.ndarray) -> pa.Table:
    """(key, at, id) of every token: its document and the byte where it ends in it, as one key, its place in the batch, its id."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(pa.array(lengths), ids))
    before = pa.array(np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()[:-1]])
    key = pc.add(pc.shift_left(doc, pa.scalar(PLACE_BITS, pa.int64())), pc.subtract(total, pc.take(before, doc)))
    return pa.table({"key": key, "at": pa.array(np.arange(len(ids))), "id": ids})


def _joined(ids: pa.Array, separators: np.ndarray) -> pa.Array:
    text = pc.binary_join_element_wise(pc.cast(ids, pa.large_string()), pa.array(["", ",", "|", ";"], pa.large_string()).take(pa.array(separators)),
                                       pa.scalar("", pa.large_string()))
    return text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text


def _digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
    """The sha256 of every document's groups as text, '' of a document without tokens."""
    all_groups = int(n_groups.sum())
    size_a, size_b = np.bincount(group_a, minlength=all_groups), np.bincount(group_b, minlength=all_groups)
    first = np.cumsum(size_a + size_b) - (size_a + size_b)
    ids = np.empty(len(a) + len(b), np.int64)
    at_a = first[group_a] + np.arange(len(a)) - (np.cumsum(size_a) - size_a)[group_a]
    at_b = (first + size_a)[group_b] + np.arange(len(b)) - (np.cumsum(size_b) - size_b)[group_b]
    ids[at_a], ids[at_b] = a, b
    separators = np.ones(len(ids), np.int8)
    separators[first + size_a - 1] = 2
    separators[first + size_a + size_b - 1] = 3
    # Nothing follows the last group of a document.
    ends = np.concatenate([first, [len(ids)]])[np.cumsum(n_groups)]
    separators[ends[n_groups > 0] - 1] = 0
    text = _joined(pa.array(ids), separators)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data, starts = text.buffers()[2], np.concatenate([[0], ends[:-1]])
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[offsets[s]:offsets[e]]).hexdigest() if k else ""
            for s, e, k in zip(starts.tolist(), ends.tolist(), n_groups.tolist(), strict=True)]


def _counted(group: np.ndarray, ids: np.ndarray) -> pa.Table:
    """How often each id is in each group, by group."""
    keys, n = np.unique(group << PLACE_BITS | ids, return_counts=True)
    return pa.table({"group": keys >> PLACE_BITS, "id": keys & ((1 << PLACE_BITS) - 1), "count_all": n})


def _links(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc_of: np.ndarray) -> pa.Table:
    """(doc, key, n): how many links of each pair of ids every document has; key is A's id * 2^32 + B's."""
    single = (np.bincount(group_a, minlength=len(doc_of)) == 1) & (np.bincount(group_b, minlength=len(doc_of)) == 1)
    in_a, in_b = single[group_a], single[group_b]
    # One token on either side: nothing to join.
    one = pa.table({"doc": doc_of[single], "key": a[in_a] << 32 | b[in_b], "n": np.ones(int(single.sum()), np.int64)})
    rest = _pairs(_counted(group_a[~in_a], a[~in_a]), _counted(group_b[~in_b], b[~in_b]), doc_of)
    found = pa.concat_tables([one, *rest]).group_by(["doc", "key"], use_threads=False).aggregate([("n", "sum")])
    return found.select(["doc", "key", "n_sum"]).sort_by("doc")


def _pairs(a: pa.Table, b: pa.Table, doc_of: np.ndarray) -> Iterator[pa.Table]:
    """The links of all groups, joined a bounded number of pairs of distinct ids at a time."""
    group_a, group_b = (t.column("group").to_numpy() for t in (a, b))
    work = np.cumsum(np.bincount(group_b, minlength=len(doc_of))[group_a])
    cuts = np.searchsorted(work, np.arange(LINKS_AT_ONCE, (int(work[-1]) if len(work) else 0) + LINKS_AT_ONCE, LINKS_AT_ONCE)) + 1
    start = 0
    for stop in [*np.unique(cuts).tolist(), a.num_rows]:
        part = a.slice(start, max(0, min(stop, a.num_rows) - start))
        if not part.num_rows:
            continue
        low, high = np.searchsorted(group_b, [group_a[start], group_a[start + part.num_rows - 1] + 1])
        start += part.num_rows
        linked = part.join(b.slice(low, high - low).rename_columns(["group", "id_b", "n_b"]), "group", join_type="inner", use_threads=False)
        table = pa.table({
            "doc": doc_of[linked.column("group").to_numpy()],
            "key": pc.add(pc.multiply(linked.column("id"), pa.scalar(1 << 32, pa.int64())), linked.column("id_b")),
            "n": pc.multiply(linked.column("count_all"), linked.column("n_b"))})
        yield table.group_by(["doc", "key"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["doc", "key", "n"])


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys array<bigint>, times array<bigint>"


def align_texts(texts: list[np.ndarray], both: Sides) -> pa.RecordBatch:
    """The columns ``ALIGNED`` of some texts, given as UTF-8 bytes."""
    chunks, counts = _chunks(texts)
    (ids_a, per_a), (ids_b, per_b) = both(chunks)
    count_a, count_b = sums(per_a, counts), sums(per_b, counts)
    good = (sums(ids_a == WRONG, count_a) == 0) & (sums(ids_b == WRONG, count_b) == 0) & (counts > 0)
    a, b = (_ends(_list_array(i, c, good), s.lengths) for i, c, s in zip((ids_a, ids_b), (count_a, count_b), both.sides, strict=True))
    shared = a.select(["key", "at"]).join(b.select(["key", "at"]), "key", join_type="inner", right_suffix="_b", use_threads=False)
    # The number of a token's group: how many shared ends come before its own end, in the whole batch.
    groups = []
    for side, at in ((a, "at"), (b, "at_b")):
        last = np.zeros(side.num_rows, np.int64)
        last[shared.column(at).to_numpy()] = 1
        groups.append(np.cumsum(last) - last)
    n_groups = np.bincount(shared.column("key").to_numpy() >> PLACE_BITS, minlength=len(texts))
    doc_of = np.repeat(np.arange(len(texts)), n_groups)
    size_a, size_b = (np.bincount(g, minlength=len(doc_of)) for g in groups)
    flat_a, flat_b = (t.column("id").to_numpy() for t in (a, b))
    pairs = _links(groups[0], flat_a, groups[1], flat_b, doc_of)
    cuts = pa.array(np.searchsorted(pairs.column("doc").to_numpy(), np.arange(len(texts) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pairs.column(c).combine_chunks()) for c in ("key", "n_sum")]
    digests = _digests(flat_a, flat_b, *groups, n_groups)
    number = lambda x: pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays(
        [number(np.where(good, count_a, 0)), number(np.where(good, count_b, 0)), number(n_groups), number(sums(size_a * size_b, n_groups)),
         pa.array(digests, pa.string()), *lists], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])


def aligned(docs: DataFrame, a: ByteTokens, b: PieceTokens) -> DataFrame:
    """``docs`` (tag, doc_id, text) with the columns ``ALIGNED`` instead of the text."""
    kinds, contents = (type(a), type(b)), (a.content, b.content)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _sides(kinds, contents)
        for batch in batches:
            for first, texts in slices(batch.column("text"), TEXTS):
                out = align_texts(texts, both)
                own = [batch.column(c).slice(first, len(texts)) for c in ("tag", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, *out.columns], ["tag", "doc_id", *out.schema.names])

    return docs.select("tag", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, f"tag bigint, doc_id bigint, {ALIGNED}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(key, documents, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            keys = pc.list_flatten(batch.column("keys"))
            held = pa.concat_tables([held, pa.table({"key": keys, "n": pa.array(np.ones(len(keys), np.int64))})])
            if held.num_rows > PAIRS_HELD:
                held = _summed(held)
                if held.num_rows > PAIRS_HELD // 2:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from _summed(held).to_batches()

    counts = rows.select("keys").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("documents"))
    counts = stage(counts, "pairs")
    # A's vocabulary bounds the number of its ids.
    highest = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("documents").alias("highest"))
    return (counts.withColumn("a", F.shiftright("key", 32)).join(F.broadcast(highest), "a")
            .select("key", "documents", (F.col("documents") == F.col("highest")).alias("best")))


def _summed(table: pa.Table) -> pa.Table:
    return table.group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["key", "n"])


def _frequent_from(pairs: DataFrame) -> int:
    """The least number of documents such that at most ``FREQUENT`` pairs are in as many."""
    # Eight steps per doubling: some hundreds of rows for any corpus.
    step = F.floor(8 * F.log2("documents"))
    held, least = 0, 2**62
    for _, n, low in sorted(pairs.groupBy(step).agg(F.count("*"), F.min("documents")).collect(), reverse=True):
        held += n
        if held > FREQUENT:
            break
        least = low
    return least


def alignment(docs: DataFrame, a: ByteTokens, b: PieceTokens) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) with how its tokens under ``a`` and under ``b`` are linked.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, and the pairs themselves: ``keys`` (A's id
    * 2^32 + B's id, distinct) and ``times`` (links of each). A null or empty text, and one whose tokens do not spell
    space + text on either side, has no tokens: zeros, an empty digest and empty arrays. Rows are told apart, not
    doc_ids: each counts as a document, and doc_ids may repeat or be null. Other columns are not looked at.
    """
    rows = stage(aligned(tagged(docs).select("tag", "row.doc_id", "row.text"), a, b), "aligned")
    pairs = stage(pair_counts(rows), "pair-counts")
    least = _frequent_from(pairs)
    frequent = pairs.where(F.col("documents") >= least)
    links = rows.select("tag", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("tag", "x.keys", "x.times").withColumnRenamed("keys", "key")
    value = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")]
    # At most FREQUENT rows of three numbers.
    known = links.join(F.broadcast(frequent), "key").groupBy("tag").agg(*value)
    rest = (links.join(F.broadcast(frequent.select("key")), "key", "left_anti")
            .join(pairs.where(F.col("documents") < least), "key").groupBy("tag").agg(*value))
    found = known.union(rest).groupBy("tag").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, "tag", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"),
                                                  "groups_sha256", "keys", "times")
