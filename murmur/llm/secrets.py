"""Secret scans through an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). The ledger is a table of (blob, rule version) pairs that
have been scanned, with their findings. A scan reads only those blobs that the ledger does not hold under the rules'
version, once each, however many paths carry them; appends them to the ledger; and joins the findings back to all paths.

Each unseen blob is read at one path, its carrier (the smallest id), found by an aggregate over (blob, id) that merges
copies before its shuffle; texts meet the carriers on the id, evenly however many copies a blob has, and stream past a
hash table of carriers without being sorted. Findings join back on the blob; the side with a hot blob is split by
adaptive execution, as it is only streamed.

Cases: null texts are scanned as empty ones; empty texts have no spans; texts are scanned whole; repeated rows give
repeated rows; extra columns are dropped by the query and kept by redact(). Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, free, read, shared_dir, written

# The kinds in their order, and their patterns. The first three are the base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What follows a key's BEGIN line: all up to its END line, or else only base64 (headers may precede it, a short line ends it).
BODY = r"(?:(?!-----(?:BEGIN|END)).)*-----END [A-Z ]*PRIVATE KEY-----"
BASE64 = r"(?:(?:\s|\\[nr])*(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/]{16,}={0,2}))*(?:(?<=[A-Za-z0-9+/])[\x20\t]*(?:\r?\n|\\n)[A-Za-z0-9+/]{1,15}={0,2}(?=\s*(?:\n|\Z)|\\n))?"
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "pem": rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{BODY}|{BASE64})",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "urlauth": r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,}@",
}
BASE = ("assign", "access", "hex")
#: A text without any of these strings has no span of the kind.
NEEDS = {"access": ("AKIA",), "pem": ("-----BEGIN ",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "jwt": ("eyJ",), "urlauth": ("://",)}
WORDS = re.compile("passw|secret|token|api", re.I | re.A)
RULES = hashlib.sha256(repr(sorted(KINDS.items())).encode()).hexdigest()[:16]
_compiled = {k: re.compile(p, re.A | (re.I if k == "assign" else re.S if k == "pem" else 0)) for k, p in KINDS.items()}
_order = {k: i for i, k in enumerate(KINDS)}


def spans(text: str) -> list[tuple[str, int, int]]:
    """Every span of a text by start, then kind as listed."""
    out = []
    for kind, pattern in _compiled.items():
        if kind == "assign":
            if WORDS.search(text):
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
        elif kind == "access":
            if "AKIA" in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= 20]
        elif kind not in NEEDS or any(x in text for x in NEEDS[kind]):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], _order[x[0]]))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text t, copied) to ledger rows, one for each blob: rows that repeat both id and text meet in one task, which
    remembers the copied blobs that it has scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            new = []
            for blob, copied in zip(batch.column(0), batch.column(2).to_pylist(), strict=True):
                new.append(not copied or blob.as_py() not in done)
                if copied:
                    done.add(blob.as_py())
            batch = batch.filter(pa.array(new, pa.bool_()))
            found = [spans(t.as_py().decode("utf-8", "replace")) for t in batch.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([RULES] * len(rows), pa.string()), pa.array(rows, kind)], ["blob", "rules", "spans"])

    return blobs.select("blob", "t", "copied").mapInArrow(run, LEDGER)


LEDGER = "blob binary, rules string, spans array<struct<kind:string,start:bigint,end:bigint>>"


def update_ledger(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scan the blobs that the ledger at this path lacks under the present rules, and append them.

    Each call appends one folder, named anew, so a call that fails leaves the ledger as it was, and a repeated one scans
    only what is missing.
    """
    spark = docs.sparkSession
    bounded(spark)
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    paths = docs.select(F.col(id_col).alias("id"), t.alias("t")).withColumn("blob", F.unhex(F.sha2("t", 256)))
    carriers = paths.groupBy("blob").agg(F.min("id").alias("carrier"), (F.count("*") > 1).alias("copied"))
    if (seen := read_ledger(spark, ledger)) is not None:
        carriers = carriers.join(seen.where(F.col("rules") == RULES).select("blob").distinct(), "blob", "left_anti")
    carriers = carriers.withColumnRenamed("blob", "b").hint("shuffle_hash")
    unseen = paths.join(carriers, F.col("id").eqNullSafe(F.col("carrier")) & (F.col("blob") == F.col("b")))
    scan_blobs(unseen).write.parquet(f"{ledger}/batch={uuid.uuid4().hex}")


def read_ledger(spark, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(f"{ledger}/*")


def _scanned(docs: DataFrame, ledger: str | None, id_col: str, text_col: str):
    """The ledger brought up to date (a new one in the shared folder where none is given): its rows, and the blob of a text."""
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/murmur/ledger-{uuid.uuid4().hex}"
    update_ledger(docs, ledger, id_col, text_col)
    rows = read_ledger(spark, ledger).where(F.col("rules") == RULES).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")).dropDuplicates(["__blob"])
    rows = written(rows, "ledger-rows")  # a plain table on its side of the join lets adaptive execution split a hot blob
    blob = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")), 256))
    return rows, blob


def findings(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, spans) for every path. Texts stay out of this join."""
    rows, blob = _scanned(docs, ledger, id_col, text_col)
    paths = docs.select(F.col(id_col).alias("__id"), blob.alias("__blob"))
    return paths.join(rows, "__blob", "left").select(F.col("__id").alias(id_col), F.col("__blob").alias("blob"), F.coalesce("__spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every span replaced by a mark; overlapping spans as one; other columns as they are, null texts null.

    Only rows with findings are rewritten; they go through an Arrow function, the others pass as they are.
    """
    rows, blob = _scanned(docs, ledger, id_col, text_col)

    @F.pandas_udf("string")
    def cut(texts, found):
        out = []
        for text, ss in zip(texts, found, strict=True):
            if text is not None and ss is not None and len(ss):
                parts, at = [], 0
                for a, b in sorted((s["start"], s["end"]) for s in ss):
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                text = "".join([*parts, text[at:]])
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    x = free(docs)
    hits = rows.where(F.size("__spans") > 0).select(F.col("__blob").alias(f"{x}blob"), F.col("__spans").alias(f"{x}spans"))
    both = docs.withColumn(f"{x}own", blob).join(hits, F.col(f"{x}own") == F.col(f"{x}blob"), "left")
    return both.withColumn(text_col, F.when(F.col(f"{x}spans").isNotNull(), cut(text_col, f"{x}spans")).otherwise(F.col(text_col))).select(*docs.columns)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = findings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    word = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, word), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", word), ",").alias("spans"),
    )
