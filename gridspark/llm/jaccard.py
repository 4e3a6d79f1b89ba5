"""Documents whose sets of word shingles are alike, exactly: a Jaccard join in size-banded tiles.

1. Equal sets are one set from the start. Shingles have a global order: those of crowded hash buckets
   come last (bucket counts over all documents are taken on the way), else by hash.
2. Two sets that are alike share one of their first shingles in that order (the prefix filter). The
   entries (shingle, set) are exchanged packed in blocks; shingles of a single set are dropped.
3. First round: of each shingle's sets the smallest is compared with the others. That is one pair per
   entry, however large the group, and joins large groups of near copies into one component.
4. Second round: only shingles whose sets are still in several components are left. A few other sets
   of each are tried as pivots in the same way. Then sets are brought together by the smallest component
   that their shingles reach, once each, and cut into tiles by size band (alike sets are in the same band
   or in neighbouring ones) and, where a band is crowded, by hash into squares of bounded size.
5. In a tile, bitmaps of hashed shingles bound the overlap from above: every bit in which two differ
   stands for a shingle that one set lacks. Sets that this leaves in doubt meet again in their tile with
   bitmaps of more bits, and then with their sorted shingles, which are intersected; of the links found there only those that join two
   components leave it, so no tile gives out more links than it has sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import small, stage, stage_made, tagged, text_buffers, with_columns
from gridspark.llm.components import components
from gridspark.llm.words import mixed, word_hashes

WORDS = 5
# Alike: 100 * overlap >= PERCENT * union.
PERCENT = 75
BUCKET_BITS = 18
# Entries of a partition of the exchange, and sets of a tile's side.
ENTRIES, TILE = 500_000, 512
# Shingles of a tile's side, about.
TILE_SHINGLES = 2_000_000
# Further pivots that are tried before all pairs of components are.
PIVOTS = 3
MIN_BITS, MAX_BITS = 64, 1 << 15
# Bitmaps of sets in doubt have so many bits for each shingle.
FINE, MAX_FINE_BITS = 8, 1 << 22
# Shingles of a pair's sets that take as much room as a narrow row.
ROW_SHINGLES = 5
AT_ONCE = 2 << 20
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[32, 9, 10, 11, 12, 13]] = 0
_TABLE[0] = 255  # the byte 0 belongs to words; 255 is in no UTF-8 text
_TIMES = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer words than ``WORDS`` are one shingle, none is empty."""
    out = []
    for w in word_hashes(texts, _TABLE):
        n = max(min(len(w), 1), len(w) - WORDS + 1)
        total = np.full(n, min(len(w), WORDS), np.uint64)
        for k in range(min(WORDS, len(w))):
            total += w[k:k + n] * _TIMES[k]
        out.append(np.unique(mixed(total)))
    return out


def set_id(shingles: np.ndarray) -> int:
    """A hash of the whole set, as a signed number."""
    if not len(shingles):
        return 0
    return int(np.int64(np.bitwise_xor.reduce(mixed(shingles + np.uint64(len(shingles)))).view(np.int64)))


def prefix_size(n: np.ndarray | int):
    """How many first shingles of a set of n one must look at: all but the least overlap with a set that is alike, and one more."""
    return n - (PERCENT * n + 99) // 100 + 1


def bitmap(shingles: np.ndarray, per_shingle: int = 1, most: int = MAX_BITS) -> bytes:
    bits = min(most, max(MIN_BITS, 1 << int(per_shingle * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(shingles >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) brought to ``size`` bytes: the halves laid over each other."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted arrays without repeats share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def may_be_alike(differing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Can sets of n and m shingles be alike if their bitmaps differ in so many bits?"""
    overlap = np.minimum((n + m - differing) // 2, np.minimum(n, m))
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def _batched(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The shingle sets of an array of texts, some at a time, with the place of the first."""
    held, first, n = [], 0, 0
    for i, data in enumerate(text_buffers(texts)):
        held.append(data)
        n += len(data)
        if n > AT_ONCE:
            yield first, shingle_sets(held)
            held, first, n = [], i + 1, 0
    yield first, shingle_sets(held)


def _described(rows: DataFrame) -> DataFrame:
    """``rows`` with the set's id, size and bitmap. The first row of a batch also has the counts of the batch's
    shingles by hash bucket, so that they cost no pass of their own."""

    @F.arrow_udf("struct<id:bigint,n:bigint,bits:binary,counts:binary>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids, sizes, maps, counts = [], [], [], np.zeros(1 << BUCKET_BITS, np.int64)
            for _, sets in _batched(texts):
                ids += [set_id(s) for s in sets]
                sizes += [len(s) for s in sets]
                maps += [bitmap(s) for s in sets]
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            blobs = [counts.astype("<i4").tobytes()] + [None] * (len(ids) - 1) if ids else []
            yield pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(blobs, pa.binary())],
                                             ["id", "n", "bits", "counts"])

    return rows.withColumn("set", describe(F.col("row.text"))).select("tag", "row", "set.*")


def _levels(rows: DataFrame) -> np.ndarray:
    """The level of every hash bucket: 0 up to twice the mean count, then one more per doubling.

    The counts of the batches (1 MB each) are added up where they are read and then in a few tasks; eight sums reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(1 << BUCKET_BITS), False
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(blob.as_py(), "<i4")
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes()])], ["counts"])

    counts = rows.where("counts IS NOT NULL").select("counts").mapInArrow(add, "counts binary").repartition(8).mapInArrow(add, "counts binary").collect()
    total = sum((np.frombuffer(c[0], "<i4").astype(np.float64) for c in counts), np.zeros(1 << BUCKET_BITS))
    return np.maximum(0, np.floor(np.log2(np.maximum(1, total / max(1.0, total.mean()))))).astype(np.uint8)


ENTRY = "key bigint, id bigint, n bigint, pivot bigint, pivot_n bigint, sets bigint"


def _entries(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """The prefix entries (key, id, n) whose shingle is in several sets, with the smallest of these sets
    (pivot, pivot_n) and their number, staged; the pivot has no entry of its own.

    Crowded shingles, whose entries do not meet, have all their entries and no pivot yet.
    """
    weight = F.sum(prefix_size_column(F.col("n")))
    total = rows.where("n > 0").agg(weight).first()[0] or 0
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session, -(-int(total) // ENTRIES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, sets in _batched(batch.column("text")):
                keys, owners = [], []
                for i, shingles in enumerate(sets, first):
                    # Of equal sets in a task, one is enough.
                    if ids[i] in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(ids[i])
                    size = prefix_size(len(shingles))
                    level = levels[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    rare = shingles[level == 0]
                    if len(rare) < size:
                        # Sorted by level; inside a level the order by hash stays.
                        rare = shingles[np.argsort(level, kind="stable")]
                    keys.append(rare[:size])
                    owners.append((ids[i], len(shingles)))
                if not keys:
                    continue
                lengths = [len(k) for k in keys]
                key = np.concatenate(keys)
                own = np.repeat(np.array(owners, np.int64), lengths, axis=0)
                crowded = levels[(key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] > 0
                # A crowded shingle is in many sets for certain: its entries need not meet, they are spread.
                part = np.where(crowded, mixed(own[:, 0].view(np.uint64)), mixed(key)) % np.uint64(parts)
                order = np.lexsort((key, part))
                part, key, own, crowded = part[order], key[order], own[order], crowded[order]
                cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
                blobs = [b"".join((key[a:b].tobytes(), own[a:b, 0].tobytes(), own[a:b, 1].astype(np.int32).tobytes(), crowded[a:b].tobytes()))
                         for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b.as_py() for batch in batches for b in batch.column("blob")]
        if not blobs:
            return
        fields = [[], [], [], []]
        for blob in blobs:
            k = len(blob) // 21
            for into, (kind, at) in zip(fields, (("<u8", 0), ("<i8", 8 * k), ("<i4", 16 * k), (np.bool_, 20 * k)), strict=True):
                into.append(np.frombuffer(blob, kind, k, at))
        key, own, n, crowded = (np.concatenate(f) for f in fields)
        order = np.lexsort((own, n, key))
        key, own, n, crowded = key[order], own[order], n[order], crowded[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        key, own, n, crowded = key[fresh], own[fresh], n[fresh], crowded[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        pivot, sets = np.repeat(first, sizes), np.repeat(sizes, sizes)
        n = n.astype(np.int64)
        # Two sets alone that differ too much in size have nothing to find here.
        hopeless = (sets == 2) & (n[pivot] * 100 < n * PERCENT)
        chosen = np.flatnonzero(crowded | ((pivot != np.arange(len(key))) & ~hopeless))
        for low in range(0, len(chosen), 1 << 16):
            at = chosen[low:low + (1 << 16)]
            known = [pa.array(x, mask=crowded[at]) for x in (own[pivot[at]], n[pivot[at]], sets[at])]
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(own[at]), pa.array(n[at]), *known],
                                             ["key", "id", "n", "pivot", "pivot_n", "sets"])

    packed = rows.where("n > 0").select("id", F.col("row.text").alias("text")).mapInArrow(emit, "part int, blob binary")
    return stage_made(packed.repartitionById(parts, "part").select("blob"), meet, ENTRY, "entries")


def prefix_size_column(n: Column) -> Column:
    return n - F.floor((n * PERCENT + 99) / 100) + 1


def _sizes_fit(n: str, m: str) -> Column:
    return (F.col(n) * 100 >= F.col(m) * PERCENT) & (F.col(m) * 100 >= F.col(n) * PERCENT)


def _bound(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n_a, n_b) that may be alike by their bitmaps."""
    for batch in pairs:
        differing = np.empty(len(batch), np.int64)
        for i, (x, y) in enumerate(zip(text_buffers(batch["bits_a"]), text_buffers(batch["bits_b"]), strict=True)):
            size = min(len(x), len(y))
            differing[i] = np.bitwise_count(folded(x[None], size) ^ folded(y[None], size)).sum()
        maybe = may_be_alike(differing, batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(maybe))


def _alike(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that are alike by their shingles."""
    for batch in pairs:
        sides = zip(text_buffers(batch["shingles_a"]), text_buffers(batch["shingles_b"]), strict=True)
        overlap = np.array([common(np.frombuffer(x.tobytes(), "<u8"), np.frombuffer(y.tobytes(), "<u8")) for x, y in sides], np.int64)
        alike = (100 + PERCENT) * overlap >= PERCENT * (batch["n_a"].to_numpy() + batch["n_b"].to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(alike))


def _array(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").tobytes()


def _fine(shingles: np.ndarray) -> bytes:
    return bitmap(shingles, FINE, MAX_FINE_BITS)


def _shingles(rows: DataFrame, sets: DataFrame, wanted: DataFrame, name: str = "shingles", form: Callable[[np.ndarray], bytes] = _array) -> DataFrame:
    """(id, ``name``) of the sets of these ids, from one text of each, staged: the shingles in this form."""

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in _batched(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(first, len(some)), pa.array([form(s) for s in some], pa.binary())], ["id", name])

    chosen = stage(sets.join(small(wanted), "id", "left_semi").select("tag"), "chosen", sets.count())
    texts = rows.select("tag", "id", F.col("row.text").alias("text")).join(small(chosen), "tag", "left_semi")
    return stage_made(texts.select("id", "text"), formed, f"id bigint, {name} binary", name)


def _links(pairs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (staged, a < b) that are alike, staged: bitmaps first, then arrays."""
    side = lambda x, table, *columns: table.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    known = pairs.join(side("a", sets, "n", "bits"), "a").join(side("b", sets, "n", "bits"), "b")
    maybe = stage_made(known, _bound, "a bigint, b bigint, n_a bigint, n_b bigint", "maybe", pairs.count() + sets.count())
    count, shingles = maybe.agg(F.count("*"), F.sum(F.col("n_a") + F.col("n_b"))).first()
    wanted = stage(maybe.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted", 2 * count)
    arrays = _shingles(rows, sets, wanted)
    whole = maybe.join(side("a", arrays, "shingles"), "a").join(side("b", arrays, "shingles"), "b")
    return stage_made(whole, _alike, "a bigint, b bigint", "links", count + (shingles or 0) // ROW_SHINGLES)


def _band(n: Column) -> Column:
    """Sets that are alike have bands at most one apart."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")


PLACE = ["lead", "kind", "band", "i", "j"]
MEMBER = "lead bigint, kind int, band int, i int, j int, upper boolean, id bigint, n bigint, component bigint"


def _tiles(entries: DataFrame, size: int) -> DataFrame:
    """The sets of every tile (``MEMBER``), from ``entries`` (lead, id, n, component), ``size`` rows at most.

    Sets that are nearly alike meet in many shingles. ``lead``, the smallest component of a shingle, is
    much the same for these, so sets meet by it and not by the shingle, once each. Tile (i, j) of kind 0 is
    square i against square j of a band, of kind 1 against square j of the band above (whose sets are ``upper``).
    """
    rows = stage(entries.distinct().withColumn("band", _band(F.col("n"))), "banded", size)
    # Squares per band: as many as keep a side at ``TILE`` sets and ``TILE_SHINGLES`` shingles on average.
    k = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    own = rows.join(rows.groupBy("lead", "band").agg(k.alias("k")), ["lead", "band"])
    own = stage(own.select("lead", "band", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("i"), "id", "n", "component"), "own", size)
    squares = stage(own.groupBy("lead", "band", "i").agg(F.min("component").alias("lo"), F.max("component").alias("hi")), "squares", size)
    lower = squares.select("lead", "band", "i", F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))

    def pairs(kind: int) -> DataFrame:
        other = squares.select("lead", (F.col("band") - kind).alias("band"), F.col("i").alias("j"), "lo", "hi")
        found = lower.join(other, ["lead", "band"])
        return (found if kind else found.where("i <= j")).withColumn("kind", F.lit(kind))

    # A tile whose sets are all of one component has nothing to compare.
    tiles = pairs(0).unionByName(pairs(1)).where(F.least("lo", "lo_i") != F.greatest("hi", "hi_i"))
    tiles = tiles.select(*PLACE)
    tiles = stage_made(tiles, None, tiles.schema, "tiles")
    left = tiles.join(own, ["lead", "band", "i"]).withColumn("upper", F.lit(False))
    right = (tiles.where("kind = 1 OR i < j").withColumn("at", F.col("band") + F.col("kind"))
             .join(own.withColumnsRenamed({"band": "at", "i": "j"}), ["lead", "at", "j"]).withColumn("upper", F.lit(True)))
    columns = [*PLACE, "upper", "id", "n", "component"]
    return left.select(*columns).unionByName(right.select(*columns))


def _tile_links(entries: DataFrame, rows: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """Links (a, b) that join the components of ``entries`` (lead, id, n, component) as far as sets in them are alike."""
    doubtful = _each_tile(_tiles(entries, size).join(sets.select("id", "bits"), "id"), _in_doubt, MEMBER, "doubtful")
    wanted = lambda: stage(doubtful.select("id").distinct(), "wanted", doubtful.count())
    doubtful = _each_tile(doubtful.join(_shingles(rows, sets, wanted(), "bits", _fine), "id"), _in_doubt, MEMBER, "doubtful")
    return _each_tile(doubtful.join(_shingles(rows, sets, wanted()), "id"), _joining, "a bigint, b bigint", "joining").distinct()


def _each_tile(members: DataFrame, judge: Callable[[pa.Table], pa.Table], schema: str, label: str) -> DataFrame:
    """``judge`` applied to the rows of each tile, staged."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table[c].to_numpy() for c in PLACE], axis=1)
            borders = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for low, high in zip(borders[:-1], borders[1:], strict=True):
                part = table.slice(low, high - low)
                if held and any(held[0][c][0] != part[c][0] for c in PLACE):
                    yield from judge(pa.concat_tables(held)).to_batches()
                    held = []
                held.append(part)
        if held:
            yield from judge(pa.concat_tables(held)).to_batches()

    return stage_made(members.repartition(*[F.col(c) for c in PLACE]).sortWithinPartitions(*PLACE, "id"), judged, schema, label)


def _sides(tile: pa.Table, maps: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a tile that may be alike by their sizes and bitmaps; ``label`` is looked at as it is by then."""
    n, upper = tile["n"].to_numpy(), tile["upper"].to_numpy()
    within = tile["kind"][0].as_py() == 0 and tile["i"][0].as_py() == tile["j"][0].as_py()
    left, right = (np.arange(len(n)),) * 2 if within else (np.flatnonzero(~upper), np.flatnonzero(upper))
    for x in left.tolist():
        others = right[right > x] if within else right
        others = others[label[others] != label[x]]
        others = others[(n[others] * 100 >= n[x] * PERCENT) & (n[x] * 100 >= n[others] * PERCENT)]
        if len(others):
            differing = np.bitwise_count(maps[others] ^ maps[x]).sum(axis=1).astype(np.int64)
            others = others[may_be_alike(differing, n[others], np.full(len(others), n[x]))]
            if len(others):
                yield x, others


def _in_doubt(tile: pa.Table) -> pa.Table:
    """The sets of a tile that may be like one of another component."""
    buffers = list(text_buffers(tile["bits"]))
    size = min(map(len, buffers))
    maps = np.concatenate([folded(b[None], size) for b in buffers]).view(np.uint64)
    doubt = np.zeros(len(buffers), bool)
    for x, others in _sides(tile, maps, tile["component"].to_numpy()):
        doubt[x] = True
        doubt[others] = True
    return tile.filter(pa.array(doubt)).select([*PLACE, "upper", "id", "n", "component"])


def _joining(tile: pa.Table) -> pa.Table:
    """Links (a, b) of a tile, each between two components that the links before have not joined."""
    sets = [np.frombuffer(b.tobytes(), "<u8") for b in text_buffers(tile["shingles"])]
    ids, n = tile["id"].to_numpy(), tile["n"].to_numpy()
    label = tile["component"].to_numpy().copy()
    buffers = [np.frombuffer(_fine(shingles), np.uint8) for shingles in sets]
    size = min(map(len, buffers))
    maps = np.concatenate([folded(b[None], size) for b in buffers])
    links = []
    for x, others in _sides(tile, maps.view(np.uint64), label):
        for y in others.tolist():
            if label[x] != label[y] and (100 + PERCENT) * common(sets[x], sets[y]) >= PERCENT * int(n[x] + n[y]):
                label[label == label[y]] = label[x]
                links.append(sorted((int(ids[x]), int(ids[y]))))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _still_split(entries: DataFrame, known: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, n, component) of the entries, ``size`` at most, and (key, lead) of the shingles with several components."""
    placed = entries.select("key", "id", "n").join(small(known), F.col("id") == F.col("node"), "left")
    placed = placed.select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    groups = placed.groupBy("key").agg(F.min("component").alias("lead"), F.max("component").alias("hi"))
    split = stage(groups.where("lead <> hi").select("key", "lead"), "split", size)
    # Shingles of one component are done with.
    return stage(placed.join(small(split.select("key")), "key", "left_semi"), "placed", size), split


def _set_components(rows: DataFrame) -> DataFrame:
    """(id, component): the sets that are linked with another set, and the smallest id they reach."""
    entries = _entries(rows, _levels(rows))
    # One row per set; equal sets have equal columns, and the first text stands for all. A set's bitmap has two bits for each shingle at most.
    count, shingles = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    sets = stage(rows.where("n > 0").groupBy("id").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("tag").alias("tag")),
                 "sets", count + (shingles or 0) // (32 * ROW_SHINGLES))
    # First round: the smallest set of a shingle against the others.
    size = entries.count() + sets.count()
    crowded = entries.where("pivot IS NULL").select("key", "id", "n")
    pivots = (crowded.groupBy("key").agg(F.min(F.struct("n", "id")).alias("p"), F.count("*").alias("sets")).where("sets > 1")
              .select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), "sets"))
    met = crowded.join(small(stage(pivots, "pivots", size)), "key").where("id <> pivot")
    entries = entries.where("pivot IS NOT NULL").unionByName(stage(met, "crowded", size))
    first = entries.where(_sizes_fit("n", "pivot_n")).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    tested = stage(first.distinct(), "first", size)
    links = _links(tested, rows, sets)
    known = stage(components(links), "known", size)
    # Second round: what is still in several components. All pairs with the pivot have been compared.
    # Other pivots come first, so that a group whose members are not all like its smallest one falls
    # together before pairs are made.
    placed, split = _still_split(entries.where("sets > 2"), known, size)
    for again in range(PIVOTS):
        if split.isEmpty():
            break
        key = F.struct(F.xxhash64(F.lit(again), "id").alias("h"), "id", "n", "component")
        other = (placed.join(small(split.select("key")), "key", "left_semi").groupBy("key").agg(F.min(key).alias("p"))
                 .select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.component").alias("pivot_component")))
        tries = placed.join(small(stage(other, "pivots", size)), "key").where((F.col("component") != F.col("pivot_component")) & _sizes_fit("n", "pivot_n"))
        pairs = stage(tries.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
                      .join(tested, ["a", "b"], "left_anti"), "again", size)
        found = _links(pairs, rows, sets)
        if found.isEmpty():
            break
        links, tested = links.unionByName(found), tested.unionByName(pairs)
        known = stage(components(links), "known", size)
        placed, split = _still_split(placed, known, size)
    if not split.isEmpty():
        more = stage(_tile_links(placed.join(small(split), "key").select("lead", "id", "n", "component"), rows, sets, size), "links", size)
        if not more.isEmpty():
            known = stage(components(links.unionByName(more)), "known", size)
    return known.select(F.col("node").alias("id"), "component")


def classes(docs: DataFrame) -> DataFrame:
    """Every row (``tag, row``) with n_shingles, component_id and kept (see ``near_duplicates``)."""
    rows = stage(_described(tagged(docs)), "described")
    linked, size = _set_components(rows), rows.count()
    # Per set its smallest doc_id, then per component, then back to the sets of groups of several rows.
    order = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("doc"), F.col("tag").alias("at"))
    own = (rows.where("n > 0").select("id", "tag", F.col("row.doc_id").alias("doc_id")).groupBy("id")
           .agg(F.min(order).alias("first"), F.count("*").alias("rows")))
    named = stage(own.join(linked, "id", "left").where("component IS NOT NULL OR rows > 1").withColumn("component", F.coalesce("component", "id")), "named", size)
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    groups = stage(named.join(best, "component").select("id", F.col("best.doc").alias("best_doc"), F.col("best.at").alias("best_tag")), "groups", size)
    found = rows.join(small(groups.withColumnRenamed("id", "set")), (F.col("id") == F.col("set")) & (F.col("n") > 0), "left")
    return found.select("tag", "row", F.col("n").alias("n_shingles"),
                        F.when(F.col("best_tag").isNull(), F.col("row.doc_id")).otherwise(F.col("best_doc")).alias("component_id"),
                        F.coalesce(F.col("best_tag") == F.col("tag"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with n_shingles and component_id, the smallest doc_id reached by links.

    A set holds the distinct runs of five words (lower case A-Z, split at ASCII white space); fewer words
    are one shingle. Null and empty texts have an empty set and are linked with nothing. Rows with a
    null doc_id count as larger than all. No pair is missed: every step before the exact comparison only
    leaves out pairs that cannot be alike. Columns with the names of the added ones are replaced.
    """
    return classes(docs).select(*with_columns(docs, {c: F.col(c) for c in ("n_shingles", "component_id")}))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The first row of each component (smallest doc_id, then input order), with its columns as they are."""
    return classes(docs).where("kept").select("row.*")
