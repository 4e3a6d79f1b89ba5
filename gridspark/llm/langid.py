"""Language identification by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Every byte becomes a short vector; filters of
several widths slide over the window, the largest answer of each is kept, and a softmax over these
gives the window's languages. A text has the mean of its windows, by their length. The network is
trained here, in numpy, on a bounded sample of labelled texts; a few thousand numbers go to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import text_buffers, with_columns

WINDOW, DEPTH, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
# The sample: texts per language, windows per text, and languages at most (the most frequent).
TEXTS, WINDOWS, LANGUAGES = 400, 4, 256
EPOCHS, BATCH, RATE, SEED = 8, 64, 4e-3, 7
UNKNOWN = "und"
# Windows put through the network at once: what they make stays in a core's cache.
AT_ONCE = 16


@dataclass
class Network:
    languages: list[str]
    bytes_in: np.ndarray  # (256, DEPTH); byte 0 pads and is zero
    filters: np.ndarray  # (max width * DEPTH, all filters): those of smaller widths have zeros behind
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def answers(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every filter's answers (window, place, filter) and the patches they come from."""
        width = max(WIDTHS)
        x = np.zeros((len(windows), WINDOW + width - 1, DEPTH), np.float32)
        x[:, :WINDOW] = self.bytes_in[windows]
        row, step = x.strides[0], x.strides[1]
        patches = np.lib.stride_tricks.as_strided(x, (len(x), WINDOW, width * DEPTH), (row, step, x.strides[2]))
        return (patches.reshape(-1, width * DEPTH) @ self.filters).reshape(len(x), WINDOW, -1), patches

    def logits(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([self.answers(windows[i:i + AT_ONCE])[0].max(axis=1) for i in range(0, len(windows), AT_ONCE)])
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a byte string, the last one padded with zeros, and the bytes in each."""
    whole, rest = divmod(len(data), WINDOW)
    windows, lengths = data[:whole * WINDOW].reshape(-1, WINDOW), np.full(whole, WINDOW)
    if rest:
        last = np.zeros((1, WINDOW), np.uint8)
        last[0, :rest] = data[-rest:]
        windows, lengths = np.concatenate([windows, last]), np.append(lengths, rest)
    return windows, lengths


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = SEED) -> Network:
    """Fit by Adam on cross-entropy; the gradient of a pooled answer goes to the patch that gave it."""
    rng = np.random.default_rng(seed)
    width, total = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.zeros((width * DEPTH, total), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w * DEPTH, i * FILTERS:(i + 1) * FILTERS] = 1
    normal = lambda shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(languages, normal((256, DEPTH), 0.5), normal((width * DEPTH, total), 0.2) * mask, np.zeros(total, np.float32),
                  normal((total, len(languages)), 0.1), np.zeros(len(languages), np.float32))
    net.bytes_in[0] = 0
    values = [net.bytes_in, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            x, y = windows[own], labels[own]
            answers, patches = net.answers(x)
            place = answers.argmax(axis=1)
            rows = np.arange(len(x))
            hidden = np.maximum(np.take_along_axis(answers, place[:, None, :], 1)[:, 0] + net.bias, 0)
            d_logits = softmax(hidden @ net.out + net.out_bias)
            d_logits[rows, y] -= 1
            d_logits /= len(x)
            d_hidden = (d_logits @ net.out.T) * (hidden > 0)
            chosen = patches[rows[:, None], place]  # (window, filter, width * DEPTH)
            d_filters = np.einsum("bfk,bf->kf", chosen, d_hidden) * mask
            d_patches = (d_hidden[:, :, None] * net.filters.T[None]).reshape(len(x), total, width, DEPTH)
            padded = np.concatenate([x, np.zeros((len(x), width - 1), np.uint8)], axis=1)
            codes = padded[rows[:, None, None], place[:, :, None] + np.arange(width)]
            d_bytes = np.zeros_like(net.bytes_in)
            np.add.at(d_bytes, codes.ravel(), d_patches.reshape(-1, DEPTH))
            d_bytes[0] = 0
            step += 1
            for v, d, m, s in zip(values, (d_bytes, d_filters, d_hidden.sum(0), hidden.T @ d_logits, d_logits.sum(0)), first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(labelled: DataFrame, texts: int = TEXTS, seed: int = SEED) -> Network | None:
    """A network from ``labelled`` (doc_id, text, lang); None if no row has a language and a letter.

    Of every language about ``texts`` texts with a letter, of any length, with the smallest hashes of doc_id
    are taken, and up to ``WINDOWS`` windows of each, evenly over the text: about ``LANGUAGES * texts *
    WINDOWS * WINDOW`` bytes reach the driver, whatever the table's size.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", "lang", "text")
    # One row per language.
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    buckets = 1 << 30
    cuts = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(buckets, int(1.3 * texts / r["count"] * buckets) + 1)) for r in counts], "lang string, cut bigint")
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets))
    last = F.expr(f"(octet_length(text) - 1) div {WINDOW}")
    chosen = F.array_distinct(F.array(*[F.floor(last * k / (WINDOWS - 1)).cast("int") for k in range(WINDOWS)]))
    data = F.encode("text", "UTF-8")
    sample = (rows.withColumn("place", place).join(F.broadcast(cuts), "lang").where("place < cut")
              .select("lang", "place", "doc_id", F.transform(chosen, lambda i: F.substring(data, i * WINDOW + 1, F.lit(WINDOW))).alias("windows"))
              .toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")]))
    languages = sorted(r["lang"] for r in counts)
    taken, windows, labels = dict.fromkeys(languages, 0), [], []
    for lang, own in zip(sample["lang"].to_pylist(), sample["windows"].to_pylist(), strict=True):
        if taken[lang] == texts:
            continue
        taken[lang] += 1
        windows += [cut(np.frombuffer(w, np.uint8))[0] for w in own]
        labels += [languages.index(lang)] * len(own)
    if not windows:
        return None
    return train(np.concatenate(windows), np.array(labels), languages, seed)


def identify(text: Column, network: Network | None) -> Column:
    """struct(lang, score): the most likely language of the whole text and its probability.

    ``und`` with score 0 if the text is null, empty or has no letter, or if there is no network.
    Every byte is looked at; windows of a long text go through the network a block at a time.
    """
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if network is None:
        return none

    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = 4096
        for texts in batches:
            sums = np.zeros((len(texts), len(network.languages)))
            held, owners, weights, n = [], [], [], 0

            def flush():
                if held:
                    p = softmax(network.logits(np.concatenate(held))) * np.concatenate(weights)[:, None]
                    np.add.at(sums, np.concatenate(owners), p)  # noqa: B023

            for i, data in enumerate(text_buffers(texts)):
                for start in range(0, len(data), block * WINDOW):
                    windows, lengths = cut(data[start:start + block * WINDOW])
                    held.append(windows)
                    weights.append(lengths)
                    owners.append(np.full(len(windows), i))
                    n += len(windows)
                    if n >= block:
                        flush()
                        held, owners, weights, n = [], [], [], 0
            flush()
            yield pa.array(list(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)), pa.list_(pa.float64()))

    has_letter = F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))
    p = probabilities(text)
    names = F.array(*[F.lit(x) for x in network.languages])
    best = F.array_max(F.zip_with(p, names, lambda a, b: F.struct(a.alias("score"), b.alias("lang"))))
    return F.when(has_letter, F.struct(best["lang"].alias("lang"), F.least(best["score"], F.lit(1.0)).alias("score"))).otherwise(none)


def with_language(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score; columns with these names are replaced."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), identify(docs["text"], network).alias("found"))
    return rows.select(*with_columns(docs, {"lang_pred": F.col("found.lang"), "score": F.col("found.score")}))
