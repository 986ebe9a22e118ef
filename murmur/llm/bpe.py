"""Byte-level BPE encoding and decoding.

Bytes map to Latin-1 characters, so the vocabulary is a pyahocorasick trie of ordinary strings. A piece is encoded by
backtracking: take the longest token at a position; if it is not compatible with the token before it (merging the two
pieces' bytes would have gone another way), fall back to its next shorter prefix token, and so on; ends found
impossible are marked, so each is tried once and the work is linear in the piece. Compatibility of two adjacent tokens
is decided by unmerging them step by step, and memoised; the check is that of the published "rust-gems" BPE crate (MIT
licence), restated here. The result is exactly that of applying the merges by rank.

Cases: null texts encode as empty ones (no tokens); the empty text has no tokens and the digest of no bytes; very long
texts are encoded whole, piece by piece; repeated rows give repeated rows; extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, utf8

#: Pieces, and pairs of tokens, that a worker remembers before it starts anew; a piece takes some 200 bytes (LONGEST_MEMO bounds
#: its text), so both stay under about 120 MB a worker.
MEMO, PAIRS = 300_000, 600_000
LONGEST_MEMO = 64

# A public splitting pattern, and the same in the form of the standard library's re, equal to it on texts without
# the characters of UNSURE (letters beyond the Latin blocks, other numbers, unusual spaces). Any other pattern is used as it is.
PUBLIC = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+", re.UNICODE)
RARE = re.compile(r"[\x1c-\x1f]")
UNSURE = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ‐-‧]")


class Vocabulary:
    """Ranks of byte strings, and encoding and decoding by them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for k, v in self.ranks.items():
            self.trie.add_word(k, v)
        self.longest = max(map(len, self.ranks), default=0)
        self.full = regex.compile(pattern)
        self.fast = pattern == PUBLIC
        self.split: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.text_of = {v: k for k, v in self.ranks.items()}
        self.size = {v: len(k) for k, v in self.ranks.items()}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.memo = _Memo(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one (itself twice for a single byte), by merging its bytes up to its own rank."""
        if (found := self.split.get(token)) is None:
            text = self.text_of[token]
            if len(text) == 1:
                found = (token, token)
            else:
                left = self.merge(text, token)
                found = (self.ranks[left[0]], self.ranks[left[1]]) if len(left) == 2 else (token, token)
            self.split[token] = found
        return found

    def merge(self, text: str, below: int) -> list[str]:
        """Plain merging by rank, of ranks under below; for whole tokens only, so its cost is bounded by their length."""
        at = list(text)
        while len(at) > 1:
            best, where = below, -1
            for i in range(len(at) - 1):
                rank = self.ranks.get(at[i] + at[i + 1], below)
                if rank < best:
                    best, where = rank, i
            if where < 0:
                break
            at[where : where + 2] = [at[where] + at[where + 1]]
        return at

    def fits(self, one: int, two: int) -> bool:
        """Whether the merges leave these two tokens side by side: no pair across their border merges before its halves did."""
        key = (one, two)
        if (known := self.compatible.get(key)) is not None:
            return known
        text, ranks, limit, answer = self.text_of, self.ranks, 1 << 60, None
        while answer is None:
            joined = ranks.get(text[one] + text[two])
            if joined is not None and joined < limit:
                answer = False
            elif one > two:
                limit, one = one, self.parts(one)[1]
                if one == limit:
                    limit, two = two + 1, self.parts(two)[0]
                    if two + 1 == limit:
                        answer = True
            else:
                limit, two = two + 1, self.parts(two)[0]
                if two + 1 == limit:
                    limit, one = one, self.parts(one)[1]
                    if one == limit:
                        answer = True
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            text = self.text_of[token]
            self.shorter[token] = next((r for n in range(len(text) - 1, 0, -1) if (r := self.ranks.get(text[:n])) is not None), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        rank_of = self.ranks.get
        if (whole := rank_of(text)) is not None:
            return [whole]
        prefix, known, fits, size, longest = self.trie.longest_prefix, self.compatible.get, self.fits, self.size, self.longest
        n, out, start, dead, token = len(text), [], 0, set(), -1
        while start < n:
            if token == -1:  # the longest token that begins here
                window = text[start : start + longest]
                k = prefix(window)
                while k and (token := rank_of(window[:k], -1)) == -1:
                    k -= 1
                if not k:
                    raise ValueError(f"no token for byte {ord(window[0])}")
            last = out[-1] if out else -1
            while token is not None:
                end = start + size[token]
                if end not in dead and (last == -1 or (ok := known((last, token))) or ok is None and fits(last, token)):
                    break
                token = self.next_shorter(token)
            if token is None:
                if not out:
                    raise ValueError("a piece that the vocabulary cannot express")
                dead.add(start)
                start -= size[last]
                out.pop()
                token = self.next_shorter(last)
                continue
            out.append(token)
            start, token = end, -1
        return out

    def pieces(self, text: str) -> list[str]:
        return self.full.findall(text) if not self.fast or (RARE if text.isascii() else UNSURE).search(text) else FAST.findall(text)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """The tokens' bytes, gathered at once from one table of all tokens."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if self.table is None:
            top = max(self.bytes_of) + 1
            each = [self.bytes_of.get(i, b"") for i in range(top)]
            sizes = np.fromiter(map(len, each), np.int64, top)
            self.table = np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes
        blob, starts, sizes = self.table
        out = []
        for some in np.array_split(ids, len(ids) // 1_000_000 + 1):
            n = sizes[some]
            out.append(blob[np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)].tobytes())
        return b"".join(out)


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.of = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.of.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_MEMO:
            self[piece] = packed
        return packed


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker and file: bounded by the vocabulary, not by the data."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary.load(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, verify: bool = True) -> DataFrame:
    """A row for each document: its id, n_tokens, the ids (array of ints, if kept), and digests of ids and decoded bytes.

    verify: decode the ids and digest the bytes (null otherwise). Streams batch by batch; nothing is shuffled.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            n, ids, one, two = [], [], [], []
            for raw in batch.column(1):
                packed = v.encode_packed(raw.as_py().decode("utf-8", "replace"))
                n.append(len(packed) // 4)
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype("<i4"))
                one.append(hashlib.sha256(packed).hexdigest())
                two.append(hashlib.sha256(v.decode(np.frombuffer(packed, "<u4"))).hexdigest() if verify else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    out = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The texts of id lists, as a column beside the others (null ids: null)."""

    @F.pandas_udf("string")
    def run(ids):
        v = vocabulary(path, pattern)
        return ids.map(lambda x: None if x is None else v.decode(x).decode("utf-8", "replace"))

    return encoded.withColumn(out_col, run(ids_col))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from murmur.llm.common import read

    return encode(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=False)
