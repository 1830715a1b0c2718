"""Quality classifier: a convolutional network over bytes, in numpy.

A text is read as overlapping chunks of ``CHUNK`` bytes, ``STEP`` apart, from its first
byte to its last. Learned filters over ``WIDTH`` bytes slide over every chunk (``STRIDE``
apart); a filter's greatest answer in a chunk is the chunk's feature. The mean and the
greatest of the chunks' features and the spread of answers are combined into one
probability. Bytes enter by a learned embedding, nothing but the text is an input.

The network is fitted on the driver to a bounded sample: at most ``sample`` labelled
texts, chosen by the hash of their id, and of each at most ``chunks`` chunks spread evenly
over the whole text. So the driver holds at most sample x chunks x CHUNK bytes (the
defaults: 2,400 x 12 x 256, 7 MB) whatever the size of the corpus. Scoring reads every
byte of every text, inside tasks.

Defined results: a null or empty text has one empty chunk and the score of that; rows
with a null label, or without a text, are not learned from; several labels of one id count as the
smallest; without labels of both kinds every score is the share of label 1 (0.5 without
any). Repeated rows get the same score; other columns pass through, one named like the
result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.llm.textkit import text_bytes

CHUNK, STEP, WIDTH, STRIDE, FILTERS, EMBED = 256, 224, 8, 2, 24, 8
PLACES = (CHUNK - WIDTH) // STRIDE + 1
PAD = 256


@dataclass
class Network:
    embed: np.ndarray  # byte or padding -> EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 x FILTERS: mean, greatest, mean of the average answers
    offset: float

    def tables(self) -> np.ndarray:
        """Answer of every filter to every byte at every place of its width."""
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(
        np.zeros((257, EMBED)), np.zeros((WIDTH, EMBED, FILTERS)), np.zeros(FILTERS),
        np.zeros((3, FILTERS)), float(np.log(share / (1 - share))),
    )


def cut_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk and the first chunk of every text (n+1); an empty text has one."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-np.maximum(sizes - CHUNK, 0) // STEP) + 1)
    heads = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(heads[-1]) - np.repeat(heads[:-1], counts)
    return np.repeat(offsets[:-1], counts) + within * STEP, heads


def chunk_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of chunks, padded behind the end of the text."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(data):
        return np.full(at.shape, PAD, np.int16)
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), PAD)


def answers(network: Network, tables: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest answer of every filter per chunk, its place, and the average answer."""
    total = np.broadcast_to(network.bias.astype(np.float32), (len(chunks), PLACES, FILTERS)).copy()
    for j in range(WIDTH):
        total += tables[j][chunks[:, j : j + (PLACES - 1) * STRIDE + 1 : STRIDE]]
    np.maximum(total, 0, out=total)
    place = total.argmax(axis=1)
    return np.take_along_axis(total, place[:, None], 1)[:, 0], place, total.mean(axis=1)


def pooled(bias: np.ndarray, tables: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and average answers as ``answers`` gives them, in buffers that stay in the cache."""
    total = np.empty((len(chunks) * PLACES, FILTERS), np.float32)
    more = np.empty_like(total)
    for j in range(WIDTH):
        at = chunks[:, j : j + (PLACES - 1) * STRIDE + 1 : STRIDE].ravel()
        np.take(tables[j], at, axis=0, out=more if j else total, mode="clip")
        if j:
            total += more
    total += bias
    np.maximum(total, 0, out=total)
    shaped = total.reshape(len(chunks), PLACES, FILTERS)
    return shaped.max(axis=1), shaped.mean(axis=1)


def combined(best: np.ndarray, mean: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Features of texts from those of their chunks: n x 3 x FILTERS."""
    counts = np.diff(heads)[:, None]
    return np.stack(
        [
            np.add.reduceat(best, heads[:-1], axis=0) / counts,
            np.maximum.reduceat(best, heads[:-1], axis=0),
            np.add.reduceat(mean, heads[:-1], axis=0) / counts,
        ],
        axis=1,
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(texts: list[list[bytes]], labels: np.ndarray, seed: int = 5, epochs: int = 14, batch: int = 48) -> Network:
    """Fit to texts given as lists of chunks, by Adam on the logistic loss. Both labels weigh
    alike in half of the loss, so the rare one is learned too."""
    if not len(labels):
        return constant(0.5)
    positive = float(labels.mean())
    if not 0 < positive < 1:
        return constant(positive)
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.4, (257, EMBED)), rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)),
        np.full(FILTERS, 0.1), np.zeros((3, FILTERS)), float(np.log(positive / (1 - positive))),
    )
    net.embed[PAD] = 0
    net.weights += rng.normal(0, 0.05, net.weights.shape)
    names = ["embed", "filters", "bias", "weights", "offset"]
    first = {n: np.zeros_like(getattr(net, n), dtype=float) for n in names}
    second = {n: np.zeros_like(getattr(net, n), dtype=float) for n in names}
    sizes = [len(t) for t in texts]
    data = np.frombuffer(b"".join(b"".join(t) for t in texts), np.uint8)
    lengths = np.array([len(c) for t in texts for c in t], np.int64)
    ends = np.cumsum(lengths)
    every = chunk_bytes(data, ends - lengths, ends)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    weigh = np.where(labels == 1, 0.5 + 0.25 / positive, 0.5 + 0.25 / (1 - positive))
    step = 0
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(texts))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            rows = np.concatenate([np.arange(heads[i], heads[i + 1]) for i in some])
            own = np.concatenate([[0], np.cumsum(heads[some + 1] - heads[some])])
            chunks = every[rows]
            best, place, mean = answers(net, net.tables(), chunks)
            features = combined(best, mean, own)
            score = sigmoid((features * net.weights).sum((1, 2)) + net.offset)
            error = (score - labels[some]) * weigh[some] / len(some)
            owner = np.repeat(np.arange(len(some)), np.diff(own))
            counts = np.diff(own)[owner][:, None]
            # Back through the mean and the greatest over chunks, then the greatest place.
            is_top = best == features[owner, 1]
            back = error[owner, None] * (
                net.weights[0] / counts + net.weights[1] * is_top
            ) * (best > 0)
            grads = {
                "weights": np.einsum("n,nkf->kf", error, features) + 1e-4 * net.weights,
                "offset": error.sum(), "bias": back.sum(0),
            }
            at = place * STRIDE
            row = np.arange(len(chunks))[:, None]
            filters, embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for j in range(WIDTH):
                byte = chunks[row, at + j]
                filters[j] = np.einsum("cf,cfe->ef", back, net.embed[byte])
                np.add.at(embed, byte, back[:, :, None] * net.filters[j].T[None])
            embed[PAD] = 0
            grads |= {"filters": filters + 1e-5 * net.filters, "embed": embed}
            step += 1
            for name in names:
                g = grads[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - move)
    net.offset = float(net.offset)
    return net


def score_batch(network: Network, column: pa.Array, tables: np.ndarray | None = None) -> np.ndarray:
    """Scores of whole texts; chunks go through in small groups."""
    tables = network.tables() if tables is None else tables
    data, offsets = text_bytes(column)
    starts, heads = cut_chunks(data, offsets)
    ends = np.repeat(offsets[1:], np.diff(heads))
    best, mean = np.zeros((len(starts), FILTERS), np.float32), np.zeros((len(starts), FILTERS), np.float32)
    bias = network.bias.astype(np.float32)
    for low in range(0, len(starts), 64):
        part = slice(low, low + 64)
        chunks = chunk_bytes(data, starts[part], ends[part]).astype(np.intp)
        best[part], mean[part] = pooled(bias, tables, chunks)
    if not len(column):
        return np.zeros(0)
    features = combined(best.astype(float), mean.astype(float), heads)
    return sigmoid((features * network.weights).sum((1, 2)) + network.offset)


def sample_chunks(most: int):
    """At most ``most`` chunks of a text, spread evenly over all of it."""

    def sample(column: pa.Array) -> pa.Array:
        data, offsets = text_bytes(column)
        starts, heads = cut_chunks(data, offsets)
        found = []
        for i in range(len(column)):
            own = starts[heads[i] : heads[i + 1]]
            if len(own) > most:
                own = own[np.linspace(0, len(own) - 1, most).round().astype(int)]
            found.append([data[a : min(a + CHUNK, offsets[i + 1])].tobytes() for a in own])
        return pa.array(found, pa.list_(pa.binary()))

    return sample


def train(
    docs: DataFrame, labels: DataFrame, label: str, learned: Column, doc_id: str = "doc_id",
    text: str = "text", sample: int = 2400, chunks: int = 12,
) -> Network:
    """Fit to at most ``sample`` labelled rows for which ``learned``, a condition on the id,
    holds. At most half of the sample is of either label, so the rare one is not lost."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learned)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    # A third more than half of each kind, for ids that have no text.
    parts = [
        rows.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample * 2 // 3)
        for kind in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(
        chosen, "doc_id"
    )
    cut = F.arrow_udf(sample_chunks(chunks), "array<binary>")(F.col("text"))
    # Several texts of one id: the smallest hash.
    found = found.select("doc_id", "label", cut.alias("chunks"), F.xxhash64("text").alias("t"))
    table = found.groupBy("doc_id", "label").agg(F.min_by("chunks", "t").alias("chunks"), F.xxhash64("doc_id").alias("h"))
    got = sorted(table.collect(), key=lambda r: (r["h"], r["doc_id"]))
    kinds = {kind: [r for r in got if r["label"] == kind] for kind in (0, 1)}
    small = min(len(kinds[0]), sample // 2)
    kinds = {0: kinds[0][: max(small, sample - len(kinds[1]))], 1: kinds[1][: sample - small]}
    rows_ = kinds[0] + kinds[1]
    return fit([[bytes(c) for c in r["chunks"]] for r in rows_], np.array([r["label"] for r in rows_], float))


def classify(docs: DataFrame, network: Network, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, higher for label 1."""
    tables = network.tables()

    def score(column: pa.Array) -> pa.Array:
        return pa.array(score_batch(network, column, tables), pa.float64())

    return docs.withColumn(into, F.arrow_udf(score, "double")(F.col(text)))
