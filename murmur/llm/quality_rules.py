"""Quality rules: gradient-boosted trees over document statistics.

One pass over whole texts computes the statistics; trees trained on a bounded sample of labelled rows (SAMPLE) are
flattened into numpy node arrays and score whole batches at once. Chosen features are monotone: more symbols, repeated
words or repeated lines never raise a score (a split is refused where its leaves would break that, and children's values
are held on their side of the middle of a constrained split).

Cases: null and empty texts have no words and fail the base rule; where no labels of both kinds exist the verdict is
"keep" and the base rule alone decides; repeated rows give repeated rows; extra columns are dropped by the query and
kept by good(), which streams documents through without a shuffle; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, read
from murmur.llm.sampling import labelled

#: Most labelled rows that are fitted on; trees, their depth, learning rate, bins of a feature, least rows in a leaf.
SAMPLE, TREES, DEPTH, RATE, BINS, LEAST = 20_000, 50, 3, 0.2, 32, 8
#: Verdict "keep" from this probability on.
KEEP = 0.5

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
# Features, and how the score may move as they grow (0: freely).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": 0, "bangs": -1, "digits": 0, "distinct": 1, "line_words": 0, "top_word": -1}


def repeat_words(words: list[bytes]) -> tuple[int, int, int]:
    """Words inside 3-word windows that occur twice or more; distinct words; occurrences of the most frequent one."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    top = int(np.bincount(ids).max()) if len(ids) else 0
    if len(ids) < 4:
        return 0, len(known), top
    n = len(known)
    pair = ids[:-1] * n + ids[1:]
    if n > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    repeated = np.zeros(len(windows), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    inside[:-2] |= repeated
    inside[1:-1] |= repeated
    inside[2:] |= repeated
    return int(inside.sum()), n, top


def stats(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the features."""
    t = text or ""
    b = t.encode("utf-8", "surrogatepass")
    words = b.split()
    n, chars = len(words), len(t) - (len(b) - len(b.translate(None, SPACE)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated, distinct, top = repeat_words(words)
    w, c = max(n, 1), max(chars, 1)
    upper, digits = (len(b) - len(b.translate(None, x)) for x in (UPPER, DIGITS))
    return (n, chars, symbols, dup, repeated), (np.log1p(n), chars / w, symbols / c, dup / max(len(lines), 1), repeated / w, upper / c, b.count(b"!") / w, digits / c, distinct / w**0.75, n / max(len(lines), 1), top / w)


@dataclass
class Trees:
    """Trees as node arrays; a leaf points at itself, so that every row takes DEPTH steps."""

    base: float = 3.0
    depth: int = 0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST) -> Trees:
    """Second-order boosting of the logistic loss over feature histograms."""
    y = np.asarray(y, float)
    if len(y) < 2 * least or y.min() == y.max():
        return Trees()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    feature, limit, left, right, value = [], [], [], [], []
    model = Trees(base=float(np.log(mean / (1 - mean))), depth=depth)
    raw = np.full(len(y), model.base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + 1.0), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(feature)
        for a, v in ((feature, 0), (limit, np.inf), (left, me), (right, me), (value, rate * leaf(g[rows].sum(), h[rows].sum(), low, high))):
            a.append(v)
        if level == depth or len(rows) < 2 * least:
            return me
        best = None
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            vl, vr = np.clip(-gl / (hl + 1), low, high), np.clip(-(gs - gl) / (hs - hl + 1), low, high)
            gain[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = gain[k], f, k, vl[k], vr[k]
        if best is None:
            return me
        _, f, k, vl, vr = best
        feature[me], limit[me], middle = f, float(edges[f][k]), (vl + vr) / 2
        one, two = (low, high), (low, high)
        if monotone[f]:
            one, two = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle))
        side = binned[rows, f] <= k
        left[me] = grow(rows[side], level + 1, *one, g, h)
        right[me] = grow(rows[~side], level + 1, *two, g, h)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        model.roots.append(root := grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        step = Trees(0.0, depth, [root], np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(value))
        raw += step.raw(x)
    model.feature, model.limit, model.left, model.right, model.value = np.array(feature, np.int32), np.array(limit), np.array(left, np.int32), np.array(right, np.int32), np.array(value)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the statistics of at most `sample` labelled rows; only their numbers come to the driver."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [stats(t.as_py())[1] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = labelled(docs, labels, "quality", sample).select("label", "text", "id").mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["label"].to_numpy()))  # the same trees whatever order the rows came in
    return fit(x[order], rows["label"].to_numpy()[order], list(FEATURES.values()))


def verdicts(texts: pa.Array, model: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base columns (rows x 5), base_failed, scores, kept."""
    pairs = [stats(t.as_py()) for t in texts]
    base = np.array([a for a, _ in pairs], np.int64).reshape(-1, 5)
    scores = model.score(np.array([b for _, b in pairs], float).reshape(-1, len(FEATURES)))
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    return base, failed, scores, ~failed & (scores >= KEEP)


def judge(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, the base columns, base_failed, kept, score."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, failed, scores, kept = verdicts(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in base.T), pa.array(failed), pa.array(kept), pa.array(scores)], ["id", *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, all columns as they are."""
    bounded(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at), model)[3]))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")))
