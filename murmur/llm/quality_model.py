"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters (one-hot bytes, WIDTH
wide) slide over every chunk; each filter's maximum over the chunk, through a rectifier, goes through a small dense
layer; its outputs are pooled over all chunks of the document (mean and maximum) and combined into one probability.

Training runs on the driver over at most SAMPLE labelled documents, each with all its chunks; a sampled document that no
longer fits into SAMPLE_BYTES together with those before it (in the order of hashed ids) is passed over. Scoring covers
all bytes of all documents, batch by batch, without a shuffle. For scoring, filters are folded into tables over
byte pairs, so a position costs WIDTH / 2 look-ups per filter.

Cases: null and empty texts are one chunk of zeros and so have a score too; texts shorter than a chunk are padded with
zeros; without labels of both kinds the score is the labels' mean (0.5 if there are none); repeated rows give repeated
rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, pieces, read, remainder, utf8, written
from murmur.llm.sampling import labelled

#: Bytes of a chunk and from one start to the next; width and number of filters; hidden units.
CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 512, 480, 6, 12, 12
#: Most labelled rows fitted on, and most bytes of their texts.
SAMPLE, SAMPLE_BYTES, EPOCHS, SEED = 4000, 32 << 20, 14, 7


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes: all chunks of a text."""
    n = max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
    out = np.zeros((n, CHUNK), np.uint8)
    whole = np.frombuffer(text, np.uint8)
    for row, k in enumerate(range(n)):
        part = whole[k * STRIDE : k * STRIDE + CHUNK]
        out[row, : len(part)] = part
    return out


@dataclass
class Net:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (FILTERS, HIDDEN)
    dense_bias: np.ndarray
    out: np.ndarray  # (2 * HIDDEN,)
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def pairs(self) -> np.ndarray:
        """(FILTERS, WIDTH / 2, 65536): the sum of two adjacent positions' weights, by byte pair (little-endian)."""
        w = self.filters.transpose(2, 0, 1).astype(np.float32)
        return np.ascontiguousarray((w[:, 0::2, None, :] + w[:, 1::2, :, None]).reshape(w.shape[0], WIDTH // 2, 65536))

    def maxima(self, rows: np.ndarray, pairs: np.ndarray, where: bool = False):
        """(n, FILTERS): the largest response of each filter in each chunk (and where it is)."""
        pair = rows[:, :-1].astype(np.intp) | rows[:, 1:].astype(np.intp) << 8
        n = CHUNK - WIDTH + 1
        best, at = np.empty((len(rows), len(pairs)), np.float32), np.empty((len(rows), len(pairs)), np.int64)
        index = [np.ascontiguousarray(pair[:, 2 * k : 2 * k + n]) for k in range(WIDTH // 2)]
        for f, tables in enumerate(pairs):
            r = tables[0].take(index[0])
            for k in range(1, WIDTH // 2):
                r += tables[k].take(index[k])
            if where:
                at[:, f] = r.argmax(1)
            best[:, f] = r.max(1)
        return (best, at) if where else best

    def combine(self, best: np.ndarray, starts: np.ndarray):
        """Probabilities of documents whose chunks begin at these rows, with what the gradient needs."""
        x = np.maximum(best + self.bias, 0)
        z = np.tanh(x @ self.dense + self.dense_bias)
        n = np.diff(np.append(starts, len(z)))
        mean = np.add.reduceat(z, starts) / n[:, None]
        top = np.maximum.reduceat(z, starts)
        logit = np.concatenate([mean, top], 1) @ self.out + self.out_bias[0]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40))), x, z, n, mean, top


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Adam on the log loss; texts are chunk arrays. The gradient of a maximum goes to the position that won."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    net = Net(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, (FILTERS, HIDDEN)), np.zeros(HIDDEN), np.zeros(2 * HIDDEN), np.array([np.log(mean / (1 - mean))]))
    if not len(y) or y.min() == y.max():
        return net
    net.out = rng.normal(0, 0.1, 2 * HIDDEN)
    one, two, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    batch = 64
    epochs = max(epochs, -(-600 * batch // max(len(y), 1) // 2)) if len(y) < 1000 else epochs
    for epoch in range(min(epochs, 40)):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            rows = np.concatenate([texts[i] for i in own])
            starts = np.cumsum([0, *(len(texts[i]) for i in own[:-1])])
            best, where = net.maxima(rows, net.pairs(), True)
            p, x, z, n, _, top = net.combine(best, starts)
            d = (p - y[own]) / len(own)
            doc = np.repeat(np.arange(len(own)), n)
            g_out = np.concatenate([np.add.reduceat(z, starts) / n[:, None], top], 1).T @ d
            gz = (d / n)[doc, None] * net.out[:HIDDEN]
            winners = z == top[doc]
            gz = gz + winners * d[doc, None] * net.out[HIDDEN:]
            gz = gz * (1 - z**2)
            gx = (gz @ net.dense.T) * (x > 0)
            g_filters = np.zeros_like(net.filters)
            r = np.arange(len(rows))[:, None]
            for k in range(WIDTH):
                np.add.at(g_filters[k], (rows[r, where + k], np.arange(FILTERS)[None, :]), gx)
            grads = [g_filters + 1e-5 * net.filters, gx.sum(0), x.T @ gz + 1e-4 * net.dense, gz.sum(0), g_out + 1e-4 * net.out, np.array([d.sum()])]
            step += 1
            rate = 0.01 * (0.5 ** (epoch * 3 / max(epochs, 1)))
            for p_, g, m, v in zip(net.parts(), grads, one, two, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, where=None, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Net:
    """A network from at most `sample` labelled rows (those allowed by `where`, over column id) of at most `size` bytes."""
    rows = written(labelled(docs, labels, "quality", sample, where).select("id", "label", utf8("text").alias("t"), F.xxhash64("id").alias("h")), "model-sample")
    fits, held = [], 0
    for r in rows.select("id", F.length("t").alias("n")).orderBy("h", "id").collect():
        if held + r.n <= size:
            fits.append((r.id,))
            held += r.n
    few = docs.sparkSession.createDataFrame(fits, f"own {labels.schema['doc_id'].dataType.simpleString()}")
    own = sorted(map(tuple, rows.join(F.broadcast(few), F.col("id") == F.col("own")).select("id", "label", "t").collect()))
    return fit([chunks(bytes(t)) for _, _, t in own], np.array([y for _, y, _ in own]))


def probabilities(net: Net, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """A probability for each text; works through its chunks in blocks, so memory does not grow with a text."""
    best, starts, at = [], [], 0
    for some in pieces(iter(texts), len, 1 << 18):
        for text in some:
            starts.append(at)
            at += max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
        if len(some) == 1 and len(some[0]) > 1 << 18:
            text, span = some[0], STRIDE * 512
            blocks = [chunks(text[k : k + span + CHUNK - STRIDE]) for k in range(0, max(1, len(text) - (CHUNK - STRIDE)), span)]
        else:
            blocks = [np.concatenate([chunks(x) for x in some])]
        best += [net.maxima(b[k : k + 128], pairs) for b in blocks for k in range(0, len(b), 128)]
    return net.combine(np.concatenate(best), np.array(starts))[0] if texts else np.zeros(0)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each document."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            p = probabilities(net, pairs, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = train(docs, read(spark, sf_dir, "labels"), remainder("id", 3) != 1)
    return score(docs, net).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
