"""Periodic runs, web archives and fill-in-middle against plain definitions: nulls, empty and long texts, ties, repeated rows,
clashing column names, empty tables."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import infill, periods, warc
from murmur.llm.queries import queries

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain_runs(w, shortest=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, letters = rng.randrange(0, 80), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            p, s = rng.randrange(1, 14), rng.randrange(n)
            for i in range(s + p, n):
                w[i] = w[i - p]
        shortest = rng.choice([12, 12, 2, 3, 7])
        assert periods.runs_of(w, shortest) == plain_runs(w, shortest) == periods.runs(np.array(w, np.int64), shortest)


def test_runs_of_long_and_nested_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for w in (b, [7] * 3000, [i % 5 for i in range(2500)], list(range(400)) * 3, (list(range(30)) * 2 + list(range(9)) * 3) * 4, [0, 1] * 700 + [0] * 700):
        assert periods.runs(np.array(w)) == plain_runs(w)


def test_ordered_sets_of_many_blocks(monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", 4)
    rng = random.Random(3)
    numbers = rng.sample(range(1000), 300)
    ends, held = periods.Ends(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        want = max((y for y in held if y < x), default=None), min((y for y in held if y > x), default=None)
        assert ends.add(x) == want
        held.append(x)
    assert list(ends) == sorted(held) and ends.size == 300 and max(map(len, ends.blocks)) <= 5


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "é", "stone", "½", "日本", "walk"]) for _ in range(n))


def documents(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n\t ", "a", "Und " * 500, prose(rng, 300), "one\ntwo\n\nthree", "no newline", "\n\n\n", "line <P> in\nit\n", "x<S>y", "tail <M>", "🎉\nzwei\r\ndrei\n<", "<S\n", "P>\nS>"]
    texts += ["\n".join(prose(rng, 6) for _ in range(k)) for k in range(1, 60)] + [prose(rng, 40) + (" again and again the same words" * 9)] * 2 + [" ".join(map(str, range(3000))) * 2]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(70, texts[70])]
    rows += [(i, prose(rng, 90)) for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = ("id", "t", "k", "n", "form", "runs", "output", "collapsed", "n_words", "w", "top")
    return df.select("*", *(F.lit(7).alias(c) for c in clash)), rows


def repeats(i, words):
    h = 1 if i is None else zlib.crc32(str(i).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]


def test_runs_query_equals_plain_definition(spark, tmp_path):
    docs, rows = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, queries()["op11_runs"](spark, str(tmp_path)).collect()))
    want, planted = [], 0
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        x = repeats(i, w)
        planted += x != w
        found = plain_runs(x)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((i, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(lines), sha(" ".join(y for k, y in enumerate(x) if k not in gone))))
    assert planted > 5
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(names, r, strict=True)) + ")" for r in want)


def test_collapsed_text_has_each_period_once(spark):
    one = spark.createDataFrame([(1, "start " + "a b c " * 8 + "end")], "doc_id long, text string")
    r = periods.periodic_runs(one).first()
    assert [tuple(x) for x in r.runs] == [(1, 24, 3)] and r.collapsed == "start a b c end" and r.n_words == 26
    assert not periods.periodic_runs(one, shortest=40).first().runs
    with pytest.raises(ValueError):
        periods.periodic_runs(one, shortest=1)


def cut(i, t, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    units = re.findall(unit, t)
    d = sha(f"7:{'' if i is None else i}")
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def test_infill_query_equals_plain_definition(spark, tmp_path):
    docs, rows = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries()["op13_infill"](spark, str(tmp_path)).collect()))
    want = collections.Counter()
    for i, t in rows:
        *head, out = cut(i, t or "")
        want[(i, *head, sha(out), sha(t or ""))] += 1
    assert got == want and {x[2] for x in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("unit", "pattern"), [("lines", r"[^\n]*\n|[^\n]+"), ("words", r"[ \t-\r]+|[^ \t-\r]+"), ("chars", r"(?s).")])
def test_infill_units_rates_and_round_trip(spark, unit, pattern):
    docs, rows = documents(spark)
    got = infill.fill_in_middle(docs, unit=unit, rate=60, spm=20).withColumn("back", infill.restored())
    want = collections.Counter((i, *cut(i, t or "", pattern, 60, 20), t or "") for i, t in rows)
    assert collections.Counter(map(tuple, got.collect())) == want
    other = ("[[pre]]", "[[suf]]", "[[mid]]")
    back = infill.fill_in_middle(docs, sentinels=other).select("doc_id", infill.restored(sentinels=other).alias("t")).collect()
    assert sorted(map(str, back)) == sorted(f"Row(doc_id={i}, t={t or ''!r})" for i, t in rows)


def test_sentinels_must_be_told_apart():
    for bad in (("<a", "ab", "c"), ("x", "xy", "z"), ("aba", "q", "r"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.marks(bad)


PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    html = ["<html>ä</html>", "", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "http://x.example 0.0.0.0 20240101000000 text/html 5\nabcde\n", "filedesc://x 0.0.0.0 2024 text/plain 3\n1 0 a", "\r\n\r\n", "x" * 9000, "HTTP/1.1 200 OK\r\nX-Page-Id: 999\r\n\r\n", "1"]
    rows = [(k, rng.choice(["http://a.example/b c", "https://é.example/\n", None, "", "dns:x.example", f"http://h/{k}"]), rng.choice(html)) for k in rng.sample(range(-20, 500), 120)]
    return rows + rows[:3] + [(None, None, "only without id"), (None, "http://n/", "only without id"), (None, "http://n/", "1"), (None, None, None), (700, "http://one", "tie"), (700, "http://two", "tie"), (701, None, "tie")]


def b32(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


@pytest.mark.parametrize("size", [8 << 20, 5000])
def test_archives_query_equals_plain_definition(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "ARC_BYTES", size)
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    df.select("*", *(F.lit(7).alias(c) for c in ("path", "content", "type", "record_id", "i", "u", "h", "place", "target"))).write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    want = collections.Counter()
    for k, _, h in rows:
        f = first.get(h or "")
        want[k, len((h or "").encode()), b32(h), "response" if k == f else "revisit", None if k == f else f] += 1
    got = collections.Counter(map(tuple, queries()["op12_warc"](spark, str(tmp_path)).collect()))
    assert got == want and {x[3] for x in want} == {"response", "revisit"}


def test_archives_are_intact_and_small_payloads_stay_responses(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    df = spark.createDataFrame(pages(), PAGES)
    warc.write_archives(warc.arc_archives(df), f"{tmp_path}/w", least_bytes=2)
    rows = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert all(r.intact for r in rows) and {r.type for r in rows} == {"warcinfo", "response", "revisit"}
    assert len([r for r in rows if r.type != "warcinfo"]) == len(pages())
    assert all(r.type == "response" for r in rows if r.payload_digest in (b32("1"), b32("")) and r.type != "warcinfo")
    known = {r.record_id for r in rows if r.type == "response"}
    assert all(r.refers_to in known for r in rows if r.type == "revisit")
    files = list((tmp_path / "w").glob("part-*.gz"))
    assert len(files) > 1
    for f in files:
        data = gzip.open(f).read()
        assert not data or data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")





def test_legacy_archives_of_both_versions(spark, tmp_path):
    http = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\n\xff\xfe bytes\n"
    one = warc.arc_head(1, "one.arc", "19970101") + b"http://a.example/a b 10.0.0.1 19970102030405 text/html %d\n%s\n" % (len(http), http)
    one += b"\n\nnot a header\ndns:a.example 10.0.0.2 1997 text/dns 4\nabcd\n" + b"http://a.example/pic 10.0.0.3 bad image/gif 3\nGIF\n" + b"http://cut/ 10.0.0.4 19970102030405 no-type 500\nshort"
    two = warc.arc_head(2, "two.arc", "20040101000000") + b"http://b.example/ 10.0.0.5 20040506070809 text/html 200 abc - 99 two.arc %d\n%s\n" % (len(http), http)
    packed = b"".join(gzip.compress(x) for x in (warc.arc_head(1, "p.arc", "2001"), b"http://c.example/ 10.0.0.6 200102 text/html 2\nok\n"))
    archives = spark.createDataFrame([("one.arc", bytearray(one)), ("two.arc", bytearray(two)), ("p.arc.gz", bytearray(packed)), ("empty", bytearray(b""))], "path string, content binary")
    rows = {r.uri: r for r in warc.convert(archives).collect()}
    got = {u: (r.type, r.date, r.mime, r.ip, r.truncated) for u, r in rows.items() if r.type != "warcinfo"}
    kind = "application/http; msgtype=response"
    assert got == {
        "http://a.example/a%20b": ("response", "1997-01-02T03:04:05Z", kind, "10.0.0.1", False),
        "dns:a.example": ("response", "1997-01-01T00:00:00Z", "text/dns", "10.0.0.2", False),
        "http://a.example/pic": ("resource", "1970-01-01T00:00:00Z", "image/gif", "10.0.0.3", False),
        "http://cut/": ("resource", "1997-01-02T03:04:05Z", "application/octet-stream", "10.0.0.4", True),
        "http://b.example/": ("response", "2004-05-06T07:08:09Z", kind, "10.0.0.5", False),
        "http://c.example/": ("resource", "2001-02-01T00:00:00Z", "text/html", "10.0.0.6", False),
    }
    assert sorted(r.uri for r in rows.values() if r.type == "warcinfo") == ["filedesc://one.arc", "filedesc://p.arc", "filedesc://two.arc"]
    assert rows["http://b.example/"].payload == b"\xff\xfe bytes\n" and rows["http://b.example/"].head == http[: http.index(b"\r\n\r\n") + 4]
    again = {r.uri: r.record_id for r in warc.convert(archives.repartition(2)).collect()}
    assert again == {u: r.record_id for u, r in rows.items()} and len(set(again.values())) == len(again)
    warc.write_archives(archives, f"{tmp_path}/w", order=F.concat("date", "record_id"))
    back = {r.uri: r for r in warc.read_archives(spark, f"{tmp_path}/w").where("type <> 'warcinfo'").collect()}
    assert all(r.intact for r in back.values()) and back["http://b.example/"].type == "revisit" and back["http://b.example/"].refers_to == again["http://a.example/a%20b"]
    out = warc.resolved(warc.written(warc.read_archives(spark, f"{tmp_path}/w").where("type <> 'warcinfo'"), "test-warc")).where("type = 'revisit'").first()
    assert out.payload_bytes == len(b"\xff\xfe bytes\n") and out.page_id is None


def test_half_written_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.records_of_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.records_of_warc(b"something else\r\n"))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op11_runs", "op12_warc", "op13_infill"):
        assert queries()[name](spark, str(tmp_path)).count() == 0
