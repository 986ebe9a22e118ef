"""Licence scans: notice phrases, identifier tags, and the expressions that follow the tags.

A text is lower-cased (A-Z only) and cut into words (runs of 0-9, a-z and anything beyond ASCII). One Aho-Corasick pass
over the words, joined by single spaces, finds every place of every notice phrase; a second one over the lower-cased
text finds identifier tags. What follows a tag on its line is an expression of licence identifiers with "and", "or",
"with" and parentheses ("with" binds closest, then "and", then "or"); Dijkstra's shunting-yard algorithm turns it into
postfix form, which is evaluated to the set of its labels and to the permissions that any one choice leaves.

An expression is read in one pass, up to its line's end, the next tag or the first word that is no known identifier, so
time is linear in the text however long a line is.

score: 0 without findings; 0.5 with notice phrases only; 0.75 with a tag that no expression of known identifiers follows;
1 with one that does.  labels: those of phrases, and of identifiers in expressions (lower case; "+" kept; an exception
after "with" is "id with exception").

Cases: null and empty texts have no words and no labels (score 0); texts are scanned whole; repeated rows give repeated
rows; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, read, utf8

# Notice phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Phrases that the method adds.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
# Tags before an expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
# First parts of identifiers that ask for copies under the same terms.
COPYLEFT = ("gpl", "lgpl", "agpl", "mpl", "epl", "cc-by-sa", "eupl")

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NOT_WORD = bytes(32 if not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else c for c in range(256))
TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
BINDS = {"or": 1, "and": 2, "with": 3}

# Licence identifiers (lower case; "-only", "-or-later" and "+" may follow) and exceptions that "with" may add.
IDS = frozenset(
    """0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0
    bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc0-1.0 cc-by-1.0 cc-by-2.0
    cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0
    cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0
    hpnd icu ijg ipl-1.0 isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libtiff lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa
    odbl-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat unicode-3.0 unicode-dfs-2016 unlicense
    upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1""".split()
)
LATER = re.compile(r"(?:\+|-only|-or-later)\Z")
OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+\Z")
EXCEPTION = re.compile(r"[a-z0-9.-]*exception(?:-[0-9.]+)?\Z")


class Malformed(ValueError):
    pass


def known(word: str) -> bool:
    """Whether a word is a licence identifier: one of IDS, a later version of one, or a reference to a text of one's own."""
    return word in IDS or LATER.sub("", word) in IDS or OWN.match(word) is not None


def postfix(tokens: list[str], prefix: bool = False) -> list[str]:
    """Shunting-yard in one pass: infix to postfix; Malformed where operands and operators do not alternate, parentheses do
    not pair, or "with" stands elsewhere than between two single operands.

    prefix: of the longest run of leading tokens that is complete, [] if there is none. The pass remembers what its two
    stacks held where the expression was last complete, so that nothing is parsed twice.
    """
    out: list[str] = []
    held: list[str] = []
    complete: tuple[int, list[str]] = (0, [])
    wants, depth, single = True, 0, False  # an operand next; open parentheses; the last operand may take an exception
    for t in tokens:
        ok = wants == (t == "(" or t != ")" and t not in BINDS) and not (t == "(" and held and held[-1] == "with") and not (t == ")" and not depth) and not (t == "with" and not single)
        if not ok:
            if prefix:
                break
            raise Malformed(t)
        if t == "(":
            held.append(t)
            depth += 1
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth, single = depth - 1, False
        elif t in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
            wants = True
        else:
            out.append(t)
            wants, single = False, not (held and held[-1] == "with")
        if not wants and not depth:
            complete = len(out), held[::-1]
    if prefix:
        return out[: complete[0]] + complete[1] if complete[0] else []
    if wants or depth:
        raise Malformed("end")
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """The labels of a postfix expression, and whether some choice of its "or" branches is free of copyleft."""
    labels: set[str] = set()
    stack: list[tuple[str | None, bool]] = []  # an identifier on its own, or None for a compound; free of copyleft
    for t in rpn:
        if t not in BINDS:
            stack.append((t, not t.startswith(COPYLEFT)))
            continue
        (right, right_free), (left, left_free) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((f"{left} with {right}", left_free))
        else:
            labels.update(x for x in (left, right) if x)
            stack.append((None, left_free or right_free if t == "or" else left_free and right_free))
    ((last, free),) = stack
    return labels | {last} if last else labels, free


def expression(text: str) -> tuple[set[str], bool, bool]:
    """Of what follows a tag: labels, whether it parses, whether a choice is free of copyleft.

    Tokens end at the first word that is no identifier, exception or operator; the longest run of them that is a complete
    expression counts, so that prose after an expression does no harm and prose alone is no licence.
    """
    tokens, end, before = [], 0, ""
    for m in TOKEN.finditer(text):
        if text[end : m.start()].strip(" \t"):
            break
        t = m[0].rstrip(".:") or m[0]
        if t not in BINDS and t not in "()" and not (EXCEPTION.match(t) if before == "with" else known(t)):
            break
        tokens.append(t)
        end, before = m.end(), t
    rpn = postfix(tokens, True)
    if not rpn:
        return set(), False, False
    labels, free = evaluate(rpn)
    return labels, True, free


def _automaton(words) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, value in words:
        a.add_word(w, value)
    a.make_automaton()
    return a


def scan(text: bytes, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    lower = text.translate(LOWER)
    words = lower.translate(NOT_WORD).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    done = index = 0
    for end, (label, size, is_base) in sorted(phrases.iter(joined), key=lambda x: x[0] - x[1][1]):
        labels.add(label)
        score = 0.5
        if is_base:
            at = end - size + 1
            index += joined.count(" ", done, at)
            done = at
            first = index if first is None else first
            last = index
            n_base += 1
            base.add(label)
    parsed = free = None
    found = list(tags.iter(lower.decode("latin-1")))
    for k, (end, _) in enumerate(found):  # an expression ends with its line, or where the next tag begins
        stop = found[k + 1][0] - len(found[k + 1][1]) + 1 if k + 1 < len(found) else len(lower)
        stop = min((x for x in (lower.find(b"\n", end, stop), lower.find(b"\r", end, stop)) if x >= 0), default=stop)
        more, ok, liberal = expression(lower[end + 1 : stop].decode("utf-8", "replace"))
        labels |= more
        parsed = ok if parsed is None else parsed or ok
        free = liberal if free is None else free and liberal
        score = max(score, 1.0 if ok else 0.75)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(found), free


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, more: dict[str, str] | None = None, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """A row for each document: n_words, places of base phrases, labels, score, number of tags, permissive (null without tag)."""
    base = PHRASES if phrases is None else phrases
    extra = {k: v for k, v in (MORE_PHRASES if more is None else more).items() if k not in base}
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _automaton((w, (v, len(w), kind)) for kind, d in ((True, base), (False, extra)) for k, v in d.items() for w in [f" {k} ".encode().decode("latin-1")])
        two = _automaton((t, t) for t in tags)
        for batch in batches:
            rows = [scan(t.as_py(), one, two) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_tags bigint, permissive boolean"
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_tags", "permissive")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
