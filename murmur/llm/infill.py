"""Fill-in-middle transformation: a text is cut at two unit boundaries into prefix, middle and suffix, which change places.

A text becomes an array of code points (UTF-32). Each code point has a class by the kind of unit: the number of its line
("lines", a line holds its newline), or whether it is a space ("words", runs of either kind are units), or its own position
("chars"). Where neighbouring classes differ a unit begins; flatnonzero lists these boundaries, two of them are chosen by
rank, and the pieces between are sliced and encoded again.

Ranks and form come from the SHA-256 of "seed:id", as its first four groups of eight hex digits h1 to h4: the prefix ends
after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger; the form is plain if h3 % 100 >= rate,
else spm if h4 % 100 < spm, else psm.

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is

A text that is empty or holds a sentinel stays plain, so the output tells its pieces apart: no sentinel can begin in one
piece and end in another either, which marks() checks of the sentinels themselves.

Cases: null texts are empty (plain, no units); a null id counts as no digits; texts are transformed whole; repeated rows
give repeated rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, read, utf8

# What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, percent of these with the suffix first, seed of the choices.
RATE, SPM, SEED = 100, 50, 7
UNITS = ("lines", "words", "chars")
NEWLINE, SPACES = 10, np.array([9, 10, 11, 12, 13, 32], np.uint32)


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """The class of each code point."""
    if unit == "lines":
        ends = points == NEWLINE
        return np.cumsum(ends) - ends
    return np.isin(points, SPACES) if unit == "words" else np.arange(len(points))


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end: 0, each position whose class differs from the one before, the length. An empty text has
    the boundary 0 only."""
    kind = classes(points, unit)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def marks(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if they can be told apart in every output: none empty, none inside another, and no end of one begins
    another or itself."""
    for a in sentinels:
        for b in sentinels:
            if not a or a is not b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                raise ValueError(f"sentinels {a!r} and {b!r} cannot be told apart")
    return sentinels


def cut(text: bytes, key: str, unit: str, sentinels: tuple[str, str, str], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Of a text: units, form, code points of prefix and middle (None if plain), and the output."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = boundaries(points, unit)
    n = len(at) - 1
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(s.encode() in text for s in sentinels):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = int(at[lo]), int(at[hi])
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le").encode() for a, b in ((0, first), (first, second), (second, len(points))))
    p, s, m = (x.encode() for x in sentinels)
    spm_first = h4 % 100 < spm
    output = b"".join((s, suffix, p, prefix, m, middle) if spm_first else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm_first else "psm", first, second - first, output


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text with its middle last, cut at boundaries of units."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    marks(sentinels)
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(t.as_py(), k, unit, sentinels, rate, spm) for k, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            n, form, prefix, middle, output = list(zip(*rows, strict=True)) or [()] * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in output], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select(F.col(id_col).alias("id"), key.alias("k"), utf8(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    piece = F.split(F.col(output), "|".join(f"\\Q{s}\\E" for s in marks(sentinels)), -1)
    join = lambda *k: F.concat(*(piece.getItem(i) for i in k))
    return F.when(F.col(form) == "psm", join(1, 3, 2)).when(F.col(form) == "spm", join(2, 3, 1)).otherwise(F.col(output))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', doc_id)) AS s FROM documents),
  h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
  k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM k)
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
