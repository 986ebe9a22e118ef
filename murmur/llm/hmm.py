"""Language-model scores by a hidden Markov model over word classes.

Words are hashed into CLASSES classes; the end of a text is a class of its own. A text's tokens are emitted by a Markov
chain of latent states: each state emits a class, and the class its word, by smoothed corpus counts. So the probability
of a text is a proper one, unknown words included, and is computed exactly by the scaled forward recursion.

1. Texts are encoded once, in blocks of about BLOCK bytes: word numbers of the block's own dictionary, with the counts
   of its words in training texts. Written to the shared folder; texts are not read again.
2. The blocks' dictionaries, at most one row for each word and block, are summed by word, and words that several blocks
   have take their corpus counts home by a join, which adaptive execution can split at a frequent word. So no vocabulary
   is ever broadcast or collected.
3. Baum-Welch: each partition runs forward and backward over its training texts and emits expected counts; their sums, as
   large as the model, make the next one. Texts of similar lengths advance together, token by token. Texts over LONG
   tokens are cut into segments that advance side by side: the products of their transfer matrices carry the exact
   forward and backward states over every border, so the counts are those of whole texts.
4. Scoring joins blocks with their counts and runs the scaled forward recursion in the same way. Base scores come from
   the same counts.

Cases: null and empty texts have one token, the end; very long texts are encoded and scored whole; with no training
texts every count is 0 and N = V = 0; repeated rows count as often as they occur; null ids count as remainder 0, that
is, as training; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, read, remainder, utf8, written

STATES, CLASSES, ROUNDS, SEED = 6, 2048, 5, 11
#: Tokens up to which a text runs in one piece, tokens of a segment of longer ones, tokens that are worked on at once.
LONG, SEGMENT, AT_ONCE = 1024, 128, 400_000
#: Bytes of text in a block.
BLOCK = 8 << 20


def class_of(words: list[bytes], classes: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % classes


def encode(docs: DataFrame, held: str, id_col: str, text_col: str, classes: int) -> DataFrame:
    """Blocks: ids, held flags, lengths, token numbers, and the dictionary with classes and training counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        ids: list[pa.Array] = []
        flags: list[bool] = []
        tokens: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            lens = np.array([len(t) for t in tokens], np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            train = ~np.repeat(np.array(flags, bool), lens)
            counts = np.bincount(flat[train], minlength=len(known)).astype(np.int32)
            words = list(known)
            row = [part << 32 | number, pa.concat_arrays(ids), np.array(flags, bool), lens.tobytes(), flat.tobytes(), words, counts, class_of(words, classes).astype(np.int16).tobytes()]
            kinds = [pa.int64(), pa.list_(row[1].type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            names = ["block", "ids", "held", "lens", "tokens", "words", "counts", "classes"]
            return pa.RecordBatch.from_arrays([pa.array([r], k) if not isinstance(r, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), r) for r, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            at = 0
            for i, t in enumerate(batch.column(2)):
                text = t.as_py().lower()
                tokens.append(np.array([known.setdefault(w, len(known)) for w in text.split()], np.int32))
                flags.append(batch.column(1)[i].as_py())
                size += len(text)
                if size >= BLOCK:
                    ids.append(batch.column(0)[at : i + 1])
                    at = i + 1
                    yield out()
                    number += 1
                    known, ids, flags, tokens, size = {}, [], [], [], 0
            if at < batch.num_rows:
                ids.append(batch.column(0)[at:])
        if tokens:
            yield out()

    schema = f"block long, ids array<{kind}>, held array<boolean>, lens binary, tokens binary, words array<binary>, counts array<int>, classes binary"
    return docs.select(F.col(id_col).alias("id"), F.col(held).alias("held"), utf8(text_col).alias("t")).mapInArrow(run, schema)


def vocabulary(blocks: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """(word, class, total, blocks) for each word (null where one block has it, which needs no join); and (block, pos, total) of the words whose count in the corpus is not
    that in the block, which only words of several blocks can be."""
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("own"))
    totals = words.groupBy("word").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("blocks"))
    totals = written(totals.select(F.when(F.col("blocks") > 1, F.col("word")).alias("word"), F.pmod(F.crc32("word"), F.lit(classes)).cast("int").alias("class"), "total", "blocks"), "hmm-words")
    several = totals.where("blocks > 1 and total > 0").select("word", "total")
    return totals, words.join(several.hint("shuffle_hash"), "word").where("total <> own").select("block", "pos", "total")


class Model:
    """start (K), move (K, K), emit (K, classes + 1): the last class is the end."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, unigram: np.ndarray, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram * (0.05 + rng.gamma(0.7, 1.0, (states, len(unigram))))
        move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def transfers(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run of symbols, the product of its (emission, move) matrices, scaled, and log10 of the scale."""
        k = len(self.start)
        mats, logs = np.empty((len(first), k, k)), np.zeros(len(first))
        for order in parts(size):
            a, n = first[order], size[order]
            x, log = np.tile(np.eye(k), (len(order), 1, 1)), np.zeros(len(order))
            for t in range(int(n[0])):
                m = int((n > t).sum())
                y = (x[:m] * self.emit.T[symbols[a[:m] + t]][:, None, :]).reshape(-1, k) @ self.move
                scale = y.reshape(m, -1).sum(1)
                x[:m] = y.reshape(m, k, k) / scale[:, None, None]
                log[:m] += np.log10(scale)
            mats[order], logs[order] = x, log
        return mats, logs

    def borders(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece: the state distribution before its first token, and how likely what follows the piece is from
        each state entered after it (scaled; ones at the end of a text). text: the number of the text that a piece is of."""
        k = len(self.start)
        before, after = np.tile(self.start, (len(first), 1)), np.ones((len(first), k))
        cut = np.flatnonzero(np.bincount(text)[text] > 1)
        if not len(cut):
            return before, after
        mats, _ = self.transfers(symbols, first[cut], size[cut])
        begin = np.flatnonzero(np.concatenate([[True], text[cut][1:] != text[cut][:-1]]))
        number = np.diff(np.append(begin, len(cut)))
        order = np.argsort(-number, kind="stable")
        begin, number = begin[order], number[order]
        for t in range(1, int(number[0])):
            at = begin[number > t] + t
            s = np.einsum("nk,nkj->nj", before[cut[at - 1]], mats[at - 1])
            before[cut[at]] = s / s.sum(1, keepdims=True)
        for t in range(int(number[0]) - 1, 0, -1):
            at = begin[number > t] + t
            s = np.einsum("nkj,nj->nk", mats[at], after[cut[at]])
            after[cut[at - 1]] = s / s.sum(1, keepdims=True)
        return before, after

    def counts(self, symbols: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Expected counts (start, move, emit) of these sequences, which lie one after the other in symbols."""
        k, out = len(self.start), [np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit)]
        first, size, text = segments(lens)
        head = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        goes_on = np.append(~head[1:], False)
        before, after = self.borders(symbols, first, size, text)
        for order in parts(size):
            a, n, h = first[order], size[order], head[order]
            more = goes_on[order]
            last = np.where(more[:, None], after[order] @ self.move.T, 1.0)  # likelihood of what follows, from a piece's last state
            last /= last.sum(1, keepdims=True)
            longest = int(n[0])
            active = [int((n > t).sum()) for t in range(longest)]
            alpha, e = [], []
            state = before[order]
            for t in range(longest):
                m = active[t]
                e.append(self.emit.T[symbols[a[:m] + t]])
                state = (state[:m] if t == 0 else state[:m] @ self.move) * e[t]
                state = state / state.sum(1, keepdims=True)
                alpha.append(state)
            beta = last[: active[-1]]
            for t in range(longest - 1, -1, -1):
                ended = slice(active[t + 1] if t + 1 < longest else 0, active[t])  # pieces whose last token this is
                ends = np.flatnonzero(more[ended]) + ended.start
                if len(ends):
                    follows = after[order][ends]
                    total = ((alpha[t][ends] @ self.move) * follows).sum(1, keepdims=True)
                    out[1] += self.move * (alpha[t][ends].T @ (follows / total))
                gamma = alpha[t] * beta
                gamma /= gamma.sum(1, keepdims=True)
                s = symbols[a[: active[t]] + t]
                for j in range(k):
                    out[2][j] += np.bincount(s, gamma[:, j], self.emit.shape[1])
                if t == 0:
                    out[0] += gamma[h].sum(0)
                    break
                forth = e[t] * beta
                m = active[t]
                back = forth @ self.move.T
                total = (alpha[t - 1][:m] * back).sum(1, keepdims=True)
                out[1] += self.move * (alpha[t - 1][:m].T @ (forth / total))
                back /= back.sum(1, keepdims=True)
                beta = np.concatenate([back, last[m : active[t - 1]]])
        return out

    def log10(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log10 of each sequence's probability, by the scaled forward recursion."""
        first, size, text = segments(lens)
        before, _ = self.borders(symbols, first, size, text)
        out = np.zeros(len(first))
        for order in parts(size):
            a, n = first[order], size[order]
            state = before[order]
            for t in range(int(n[0])):
                m = int((n > t).sum())
                state = state[:m] * self.emit.T[symbols[a[:m] + t]]
                total = state.sum(1)
                out[order[:m]] += np.log10(total)
                state = state / total[:, None] @ self.move
        return np.bincount(text, out, len(lens)) if len(lens) else np.zeros(0)


def segments(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol, size, number of the sequence) of the pieces of sequences lying one after the other: whole ones up to
    LONG symbols, segments of SEGMENT beyond."""
    lens = np.asarray(lens, np.int64)
    step = np.where(lens > LONG, SEGMENT, np.maximum(lens, 1))
    number = np.maximum(1, -(-lens // step))
    begin = np.cumsum(lens) - lens
    which = np.repeat(np.arange(len(lens)), number)
    k = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
    return begin[which] + k * step[which], np.minimum(lens[which] - k * step[which], step[which]), which


def parts(size: np.ndarray) -> list[np.ndarray]:
    """The numbers of pieces, largest first, in lots of about AT_ONCE symbols, so that those of a lot are of similar sizes."""
    order = np.argsort(-size, kind="stable")
    lot = np.cumsum(size[order]) // AT_ONCE
    return [x for x in np.split(order, np.flatnonzero(np.diff(lot)) + 1) if len(x)]


def with_ends(tokens: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences with the end appended to each."""
    return np.insert(tokens, np.cumsum(lens), end), lens + 1


def train(blocks: DataFrame, unigram: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    model = Model.begin(unigram, states, seed)
    end = len(unigram) - 1

    def of(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for held, lens, tokens, classes in zip(*(batch.column(c) for c in ("held", "lens", "tokens", "classes")), strict=True):
                    n, t = np.frombuffer(lens.as_py(), np.int32), np.frombuffer(tokens.as_py(), np.int32)
                    use = ~np.array(held.as_py(), bool)
                    symbols = np.frombuffer(classes.as_py(), np.int16).astype(np.int64)[t[np.repeat(use, n)]]
                    symbols, n = with_ends(symbols, n[use].astype(np.int64), end)
                    got = model.counts(symbols, n)
                    total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
            if total is not None:
                flat = np.concatenate([c.ravel() for c in total])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

        return run

    for _ in range(rounds):
        got = blocks.select("held", "lens", "tokens", "classes").mapInArrow(of(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(states + states * states + states * len(unigram))
        flat[got["i"].to_numpy()] = got["v"].to_numpy()
        start, move, emit = flat[:states] + 0.1, flat[states : states + states**2].reshape(states, states) + 0.1, flat[states + states**2 :].reshape(states, -1)
        emit = emit + unigram * 20.0
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return model


def score(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); trained on rows whose column `held` is false."""
    bounded(docs.sparkSession)
    blocks = written(encode(docs, held, id_col, text_col, classes), "hmm-blocks")
    words, home = vocabulary(blocks.select("block", "words", "counts"), classes)
    texts = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]
    sums = words.groupBy("class").agg(F.sum("total").alias("n"), F.count_if(F.col("total") > 0).alias("v")).collect()
    n, v = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in sums:
        n[r["class"]], v[r["class"]] = r.n, r.v
    n[classes], v[classes] = texts, texts > 0
    total, distinct = int(n.sum()), int(v.sum())
    unigram = (n + 0.5) / (n + 0.5).sum()
    model = train(blocks, unigram, states, rounds, seed)
    end_base = np.log10((texts + 0.5) / (total + 0.5 * (distinct + 1)))
    mine = home.groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("total").alias("total")).withColumnRenamed("block", "b").hint("shuffle_hash")
    both = blocks.select("block", "ids", "held", "lens", "tokens", "classes", "counts").join(mine, F.col("block") == F.col("b"), "left").drop("b", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                lens, tokens = np.frombuffer(row["lens"].as_py(), np.int32).astype(np.int64), np.frombuffer(row["tokens"].as_py(), np.int32)
                c = row["counts"].values.to_numpy().astype(np.float64)
                if row["pos"].is_valid:
                    c[row["pos"].values.to_numpy()] = row["total"].values.to_numpy()
                kind = np.frombuffer(row["classes"].as_py(), np.int16).astype(np.int64)
                base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
                inside = np.log10((c + 0.5) / (n[kind] + 0.5 * (v[kind] + 1)))
                begin = np.concatenate([[0], np.cumsum(lens)])
                symbols, n_tokens = with_ends(kind[tokens], lens, classes)
                log = model.log10(symbols, n_tokens)
                out = [row["ids"].values, row["held"].values, pa.array(n_tokens), pa.array(exact((c > 0).astype(float), tokens, begin).astype(np.int64) + int(texts > 0)), pa.array(np.full(len(lens), total, np.int64)), pa.array(exact(base, tokens, begin) + end_base), pa.array(log + exact(inside, tokens, begin))]
                yield pa.RecordBatch.from_arrays(out, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def exact(values: np.ndarray, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the tokens' values in each text, added up text by text (no differences of long running sums)."""
    out = np.zeros(len(begin) - 1)
    full = np.flatnonzero(begin[1:] > begin[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[tokens], begin[full])
    return out


def op6_hmm(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held", remainder("doc_id", 5) == 1), "held")
