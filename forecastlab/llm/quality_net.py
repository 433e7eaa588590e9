"""Quality by a small byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Learned filters slide over every byte; their maxima over overlapping chunks
(``CHUNK`` bytes every ``STEP``, covering the whole text) go through one hidden layer to a value per
chunk, and the largest, mean and smallest value of a text are combined into one probability.

The network is fitted here, on the driver, from training rows only: a bounded sample of labelled rows
(``MAX_LABELLED``, chosen by a hash of the id) and at most ``CHUNKS_PER_TEXT`` chunks of each, spread
evenly over the text; the combination is fitted on a training fold of its own, over whole texts. Scoring
reads whole texts in slices. Null and empty texts are one chunk of padding. Of contradicting labels of one
document the more frequent one counts, 1 where both are as frequent. Without two classes of labels
the score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecastlab.llm.common import bounded_sample, fold, held_out, id_text, map_arrow, one_label, table
from forecastlab.llm.registry import query
from forecastlab.llm.toxicity import fit_curve
from forecastlab.llm.wordhash import slices
from forecastlab.session import settle

CHUNK, STEP = 256, 128
WIDTH, DEPTH, FILTERS, HIDDEN = 5, 8, 32, 16
MAX_LABELLED = 6_000
CHUNKS_PER_TEXT = 6
COMBINE_FOLD = 4
EPOCHS, BATCH, RATE = 6, 256, 0.004


class Net(NamedTuple):
    bytes: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray


def start_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Net(
        normal(256, DEPTH, scale=0.5),
        normal(WIDTH * DEPTH, FILTERS, scale=(2 / (WIDTH * DEPTH)) ** 0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, scale=HIDDEN**-0.5),
        np.zeros(1, np.float32),
    )


def windows(net: Net, data: np.ndarray) -> np.ndarray:
    """``(..., n - WIDTH + 1, WIDTH * DEPTH)``: the vectors under each filter position."""
    vectors = net.bytes[data].reshape(*data.shape[:-1], -1)
    view = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * DEPTH, axis=-1)
    return view[..., ::DEPTH, :]


def chunk_values(net: Net, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    return hidden, hidden @ net.out + net.out_bias[0]


def gradients(net: Net, data: np.ndarray, good: np.ndarray, weight: np.ndarray) -> Net:
    """Gradients of the weighted logistic loss over a batch of chunks ``(n, CHUNK)``."""
    seen = windows(net, data)
    z = np.ascontiguousarray(seen).reshape(-1, WIDTH * DEPTH) @ net.filters
    z = z.reshape(len(data), -1, FILTERS)
    at = z.argmax(axis=1)  # (n, FILTERS)
    top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :] + net.bias
    pooled = np.maximum(top, 0)
    hidden, value = chunk_values(net, pooled)
    d_value = ((1 / (1 + np.exp(-value)) - good) * weight / len(data)).astype(np.float32)
    d_hidden = np.outer(d_value, net.out) * (hidden > 0)
    d_top = (d_hidden @ net.hidden.T) * (top > 0)
    n = np.arange(len(data))[:, None]
    under = seen[n, at]  # (n, FILTERS, WIDTH * DEPTH)
    d_filters = np.einsum("nfd,nf->df", under, d_top, optimize=True)
    d_under = (d_top[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
    where = data[n[:, :, None], at[:, :, None] + np.arange(WIDTH)].reshape(-1)
    d_bytes = np.stack([np.bincount(where, d_under[:, k], 256) for k in range(DEPTH)], axis=1)
    return Net(
        d_bytes, d_filters, d_top.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_value, d_value.sum(keepdims=True)
    )


def train(data: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam over shuffled batches; both classes weigh the same."""
    net, rng = start_net(seed), np.random.default_rng(seed)
    share = good.mean()
    weight = np.where(good > 0.5, 0.5 / share, 0.5 / (1 - share))
    mean = [np.zeros_like(p) for p in net]
    square = [np.zeros_like(p) for p in net]
    total = max(1, epochs * -(-len(data) // BATCH))
    step = 0
    while step < total:
        order = rng.permutation(len(data))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            moved = []
            for k, (p, g) in enumerate(zip(net, gradients(net, data[rows], good[rows], weight[rows]))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                change = rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                moved.append((p - change).astype(np.float32))
            net = Net(*moved)
            if step >= total:
                break
    return net


def padded(raw: np.ndarray) -> np.ndarray:
    """The bytes with at least ``WIDTH - 1`` zeros behind, to a whole number of steps."""
    blocks = -(-(len(raw) + WIDTH - 1) // STEP)
    out = np.zeros(blocks * STEP, np.uint8)
    out[: len(raw)] = raw
    return out


def text_features(net: Net, texts: list[bytes]) -> np.ndarray:
    """``(texts, 3)``: largest, mean and smallest chunk value of each whole text."""
    parts = [padded(np.frombuffer(t, np.uint8)) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) // STEP for p in parts])])
    data = np.concatenate([*parts, np.zeros(WIDTH - 1, np.uint8)])
    block = np.empty((bounds[-1], FILTERS), np.float32)
    many = 512  # blocks at a time, so that the working set stays in the cache
    for start in range(0, len(block), many):
        stop = min(len(block), start + many)
        seen = windows(net, data[start * STEP : stop * STEP + WIDTH - 1])
        z = np.ascontiguousarray(seen) @ net.filters
        ends = bounds[1:][(bounds[1:] > start) & (bounds[1:] <= stop)] - start
        z[(ends[:, None] * STEP - np.arange(1, WIDTH)).ravel()] = -np.inf  # these reach from the padding into the next text
        block[start:stop] = z.reshape(-1, STEP, FILTERS).max(axis=1)
    block = np.maximum(block + net.bias, 0)
    chunk = block.copy()
    chunk[:-1] = np.maximum(block[:-1], block[1:])
    ends = bounds[1:] - 1
    several = np.diff(bounds) > 1
    chunk[ends] = np.where(several[:, None], chunk[ends - 1], block[ends])
    value = chunk_values(net, chunk)[1].astype(np.float64)
    at, once = bounds[:-1], np.ones(len(value))
    once[ends[several]] = 0  # the last step of a longer text begins no chunk of its own
    mean = np.add.reduceat(value * once, at) / np.add.reduceat(once, at)
    return np.column_stack([np.maximum.reduceat(value, at), mean, np.minimum.reduceat(value, at)])


def spread_chunks(raw: bytes, many: int = CHUNKS_PER_TEXT) -> list[bytes]:
    """At most ``many`` chunks, spread evenly over the whole text."""
    data = padded(np.frombuffer(raw, np.uint8))
    last = max(0, len(data) - CHUNK)
    starts = sorted({int(s) // STEP * STEP for s in np.linspace(0, last, many)})
    return [data[s : s + CHUNK].tobytes().ljust(CHUNK, b"\0") for s in starts]


class Model(NamedTuple):
    net: Net | None
    curve: tuple[float, ...]


def _sample_chunks(sample: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [
            (label, chunk)
            for label, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist())
            for chunk in spread_chunks((text or "").encode("utf-8", "surrogatepass"))
        ]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["quality", "chunk"])

    return map_arrow(sample.select("quality", "text"), work, "quality int, chunk binary")


def _sample_features(sample: DataFrame, net: Net) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = text_features(net, [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
        yield pa.record_batch([batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["quality", "x"])

    return map_arrow(sample.select("quality", "text"), work, "quality int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Train on the training rows of ``labels``; what reaches the driver is bounded by ``max_labelled``."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    chosen = F.broadcast(bounded_sample(one_label(known, "quality"), max_labelled))
    sample = settle(id_text(docs).join(chosen, "doc_id"), "quality_sample")
    part = fold(F.col("doc_id"))
    rows = _sample_chunks(sample.where(part != COMBINE_FOLD)).collect()
    good = np.array([r["quality"] for r in rows], dtype=np.float64)
    if len(set(good)) < 2:
        return Model(None, (float(np.clip(good.mean(), 0, 1)) if len(good) else 0.5,))
    data = np.frombuffer(b"".join(r["chunk"] for r in rows), np.uint8).reshape(-1, CHUNK)
    order = np.lexsort((np.arange(len(data)), data[:, 0], data[:, CHUNK // 2], data[:, -1]))
    net = train(data[order], good[order])
    rows = _sample_features(sample.where(part == COMBINE_FOLD), net).collect()
    if len({r["quality"] for r in rows}) < 2:
        return Model(net, (0.0, 0.0, 1.0, 0.0))
    return Model(net, fit_curve(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows], dtype=float)))


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.net is None:
        return np.full(len(texts), model.curve[0])
    z = model.curve[0] + text_features(model.net, texts) @ np.array(model.curve[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, rows in slices(batch.column("text")):
            scores = probabilities(shared.value, [t.encode("utf-8", "surrogatepass") for t in rows.to_pylist()])
            yield pa.record_batch(
                [batch.column("doc_id").slice(start, len(rows)), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return map_arrow(id_text(docs), work, "doc_id long, score double")


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
