import collections
import dataclasses
import datetime
import json
import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from murmur.functions import fuzzy
from murmur.functions import quality as Q
from murmur.functions import text as T
from murmur.operators import calls, candidates, engines, frames, geometry, matching, rounds, runs
from murmur.operators import dedup as D
from murmur.operators.segment import improve_pipeline, segment_news
from murmur.sources import pcm, readers, writers
from murmur.streaming import board, jobs


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("v")).first().v


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            now = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(row[j + 1], row[j])
            before = now
    return row[-1]


def plain_partial(a, b):
    a, b = sorted((a, b), key=len)
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    best = lambda a, b: max(200 * plain_lcs(a, w) / (n + len(w)) for w in [b[:i] for i in range(1, n)] + [b[i : i + n] for i in range(len(b) - n + 1)] + [b[len(b) - i :] for i in range(1, n)])
    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def test_similarity_vectors():
    assert round(fuzzy.ratio("kitten", "sitting"), 3) == 61.538 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "b") == 0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b", "a b c") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert [fuzzy.stem(w) for w in ("caresses", "ponies", "agreed", "hopping", "relational", "happiness", "sky")] == ["caress", "poni", "agre", "hop", "relat", "happi", "sky"]


def test_similarity_against_definitions():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 15))) for _ in range(2))
        assert fuzzy.lcs(a, b) == plain_lcs(a, b) and fuzzy.ratio(a, b) == fuzzy.ratio(b, a) and 0 <= fuzzy.ratio(a, b) <= 100
        assert abs(fuzzy.partial_ratio(a, b) - plain_partial(a, b)) < 1e-9
        for limit in (50, 70, 85):
            assert D.over(a, b, limit) == (fuzzy.ratio(a, b) > limit) and D.partial_over(a, b, limit) == (plain_partial(a, b) > limit)


def test_text_functions(spark):
    assert one(spark, T.clean_text, "a|b  — c...d� ") == "ab - c.d'"
    assert one(spark, T.strip_affixes, "BREAKING NEWS Rain for more go to site.com") == "Rain"
    assert one(spark, lambda c: F.array_join(T.significant_numbers(c), ","), "72,292 in 2023 and 716 or 12") == "72292,716"
    digits = "1" * 50
    assert one(spark, lambda c: F.array_join(T.significant_numbers(c), ","), f"{digits} 0716 02023 000 1899 2100") == f"{digits},716,0,1899,2100"
    assert tuple(one(spark, T.find_delimiter, "none")) == (" - ", 0) and tuple(one(spark, T.find_delimiter, "a - b | c")) == (" - ", 1)
    assert one(spark, lambda c: T.json_strings(c), '```json\n["a", 1, " b "]\n```') == ["a", "b"]
    assert one(spark, lambda c: T.json_strings(c), '["cut off\n- "a line long enough to count",\nshort') == ["a line long enough to count"]
    assert one(spark, T.json_strings_or_object, '{"x": ["a", "b"]}') == ["a", "b"]
    pick = T.json_strings_or_object
    for said, want in (
        ('{"a": [1, " x ", ""], "b": ["y"]}', ["x"]), ('{"n": 1, "a": ["p"], "b": ["q"]}', ["p"]), ('Sure: {"a": {"b": ["q"]}} ok', ["q"]), ('```json\n[" a ", 2, null]\n``` done', ["a"]), ("[]", []), ('["a"]]', []),
        ("``` - 'a line long enough to be counted', ```", ["a line long enough to be counted"]), ('{"a": 1}', []), (None, None), ("", []),
    ):
        assert one(spark, pick, said) == want, said
    heads = lambda x: [tuple(h) for h in one(spark, T.parse_headlines, x)]
    assert heads('[{"headlines": ["q"]}]') == [] == heads('{"headlines": 3}') == heads("") == heads(None) == heads("no json")
    assert heads('So: {"headlines": ["q", {"text": " r ", "confidence": "Low"}, 5, {"confidence": "low"}, ["z"]]}. Bye') == [("Q", "medium"), ("R", "low")]
    assert heads('```json\n{"headlines": [{"text": "x", "confidence": "odd"}]}\n```') == [("X", "high")]
    costs = spark.createDataFrame([(None, 1e6, 5.0, 1.0), (1e6, None, 5.0, 1.0), (1e6, 1e6, None, 1.0), (1e6, 1e6, 1e6, None), (1e6, 1e6, 1e6, 4.0)], "i double, o double, t double, p double")
    cost = T.token_cost("i", "o", F.lit(2.0), F.lit(3.0), "t", "p")
    assert [r.v for r in costs.select(cost.alias("v")).collect()] == [0.0, 0.0, 5.0, 5.0, 9.0]
    assert one(spark, lambda c: T.srt_time(c.cast("double")), "3661.5") == "01:01:01,500"
    assert one(spark, Q.quality_v6, "SHORT") == 0.0
    assert one(spark, T.clean_text, None) is None and one(spark, T.words, "") == []


def test_tiles_and_bands(spark):
    tiles = lambda w: one(spark, lambda c: geometry.tile_starts(c.cast("int"), 3000, 1000), str(w))
    assert tiles(2999) == [0] and tiles(3000) == [0] and tiles(6500) == [0, 2000, 3500]


def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(1)
    a = [(i, s := rng.randint(0, 500), s + rng.randint(1, 90)) for i in range(120)]
    b = [(i, s := rng.randint(0, 500), s + rng.randint(1, 90)) for i in range(120)]
    got = geometry.interval_join(spark.createDataFrame(a, "i int, s int, e int"), spark.createDataFrame(b, "j int, u int, v int"), ("s", "e"), ("u", "v"), 50).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, s, e in a for j, u, v in b if e > u and s < v)


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), ("", "")], "r string, h string")
    got = df.select(matching.wer(T.words("r"), T.words("h")).alias("w"), matching.cer(F.col("r"), F.col("h")).alias("c"), matching.asr_metrics("r", "h").alias("m")).collect()
    assert [round(r.w, 4) for r in got] == [0.6667, 1.0, 0.0] == [round(r.m.wer, 4) for r in got] and [r.c for r in got][1:] == [1.0, 0.0]
    assert round(got[0].m.mer, 4) == 0.5 and round(got[0].m.wil, 4) == round(1 - 2 / 3 * 2 / 4, 4)


def test_edits_equal_the_whole_table():
    rng = random.Random(12)

    def plain(a, b):  # (distance, -hits), least in this order
        row = [(j, 0) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], (i, 0)
            for j, y in enumerate(b, 1):
                step = (before[0], before[1] - 1) if x == y else (before[0] + 1, before[1])
                before, row[j] = row[j], min(step, (row[j][0] + 1, row[j][1]), (row[j - 1][0] + 1, row[j - 1][1]))
        return row[-1][0], -row[-1][1]

    for k in range(10_000):
        symbols = "ab" if k % 3 else "aàb€𝄞xyz"
        a = [rng.choice(symbols) for _ in range(rng.randint(0, 12))]
        b = [rng.choice(symbols) for _ in range(rng.randint(0, 12))] if k % 2 else [c for c in a if rng.random() > 0.2] + [rng.choice(symbols)] * rng.randint(0, 2)
        want = plain(a, b)
        assert fuzzy.error_counts(a, b) == want and fuzzy.edit_distance(a, b) == want[0] == fuzzy.edit_distance("".join(b), "".join(a))
    long = "".join(rng.choice("abcdefgh ") for _ in range(700))
    for share in (0.02, 0.6):  # over many machine words, near and far
        other = "".join(rng.choice("abcdefgh ") if rng.random() < share else c for c in long)[20:]
        assert fuzzy.error_counts(long, other) == plain(long, other) and fuzzy.edit_distance(long, other) == plain(long, other)[0]


def test_best_match_and_f1(spark):
    gt = spark.createDataFrame([(0, "RAIN IN SPAIN"), (1, "SNOW ON HILLS"), (2, "NOTHING ALIKE 77")], "id long, text string")
    ext = spark.createDataFrame([(5, "RAIN IN SPAIN"), (6, "RAIN IN SPAIN"), (7, "HILLS ON SNOW"), (8, "qqqq")], "id long, text string")
    found = matching.best_matches(gt, ext)
    left = {r.id: (r.other, r.score) for r in matching.scored(found, "l", gt).collect()}
    assert left[0] == (5, 100.0) and left[1] == (7, 100.0) and left[2][1] < 60
    p = {r.threshold: r for r in matching.prf(found, gt, ext).collect()}
    assert p[70].tp_gt == 2 and p[70].tp_ext == 3 and p[70].precision == 0.75 and round(p[70].recall, 4) == 0.6667
    none = matching.best_matches(gt, ext.limit(0))
    assert {(r.other, r.score) for r in matching.scored(none, "l", gt).collect()} == {(-1, 0.0)}


@pytest.mark.parametrize("chars", [4_000_000, 60])
def test_best_matches_equal_brute_force(spark, monkeypatch, chars):
    """One block of references and several; slices, ties, empty and null texts, letters beyond ASCII."""
    monkeypatch.setattr(matching, "BLOCK_CHARS", chars)
    monkeypatch.setattr(matching, "PART_CHARS", 300)
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 5)))
    gt = [(i, text()) for i in range(20)] + [(50, None), (51, "")]
    ext = [(i, text(), "xy"[i % 2]) for i in range(100, 160)] + [(200, None, "x"), (201, "", "y"), (202, gt[3][1], "x"), (203, gt[3][1], "x")]
    left, right = spark.createDataFrame(gt, "id long, text string"), spark.createDataFrame(ext, "id long, text string, slice string").repartition(3)
    got = {(r.slice, r.side, r.id): (r.other, r.score) for r in matching.best_matches(left, right, ("slice",)).collect()}
    want = {}
    for j, b, k in ext:
        for i, a in gt:
            if a is not None and b is not None:
                s = fuzzy.similarity(a, b)
                for key, other in (((k, "r", j), i), ((k, "l", i), j)):
                    if key not in want or (s, -other) > (want[key][1], -want[key][0]):
                        want[key] = other, s
    assert got == want
    p = {(r.slice, r.threshold): r for r in matching.prf(matching.best_matches(left, right, ("slice",)), left, right, ("slice",)).collect()}
    for k in "xy":
        for t in matching.THRESHOLDS:
            r, n = p[k, t], sum(x == k for *_, x in ext)
            hits = [sum(s >= t for (x, side, _), (_, s) in want.items() if x == k and side == o) for o in "lr"]
            assert (r.tp_gt, r.tp_ext, r.fn, r.fp) == (*hits, len(gt) - hits[0], n - hits[1])
    empty = matching.best_matches(left.limit(0), right)
    assert empty.count() == 0 and matching.prf(empty, left.limit(0), right).count() == 3


def test_uncovered_and_pairs(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abc de") for _ in range(rng.randint(0, 14)))
    items = [(i % 2, i, text()) for i in range(40)]
    good = [(i % 2, text()) for i in range(12)]
    got = D.uncovered(spark.createDataFrame(items, "g int, pos long, text string"), spark.createDataFrame(good, "g int, good string"), "g").collect()
    assert sorted(r.pos for r in got) == sorted(p for g, p, t in items if not any(h == g and fuzzy.partial_ratio(t, o) > 80 for h, o in good))
    for rule in ("clean", "v6", "aggregate"):
        got = D.duplicate_pairs(spark.createDataFrame(items, "g int, pos long, text string"), rule, "g").collect()
        assert sorted((r.pos, r.pos2) for r in got) == sorted((p, q) for g, p, t in items for h, q, u in items if g == h and p < q and D.RULES[rule].same(t, u))
    a, b = text() + "aab", text() + "aba"
    both = spark.createDataFrame([(a, b), ("", "x"), ("aa", "aaa")], "a string, b string").select(T.common_letters("a", "b").alias("n")).collect()
    assert [r.n for r in both] == [sum(min(a.count(c), b.count(c)) for c in set(a)), 0, 2]


def test_rouge_and_cosine(spark):
    rng = random.Random(3)
    data = [([rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    for n in (1, 2):
        for r in df.select("a", "b", matching.rouge_n(F.col("a"), F.col("b"), n).alias("v")).collect():
            x, y = (collections.Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (r.a, r.b))
            hits = sum((x & y).values())
            assert abs(r.v - (2 * hits / (x.total() + y.total()) if hits else 0)) < 1e-12
    long = spark.createDataFrame([(["w%d" % i for i in range(30_000)], ["w%d" % i for i in range(0, 30_000, 3)])], "a array<string>, b array<string>")
    assert long.select(matching.wer("a", "b").alias("v")).first().v == 20_000 / 30_000
    e = [(i % 3, i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    one = spark.createDataFrame(e, "g int, id int, e array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for r in matching.best_cosine(one, one.select("g", "e").where("id > 20"), "g", 7).collect():
        own = next(v for _, i, v in e if i == r.id)
        assert abs(r.best - max(cos(own, v) for g, i, v in e if g == r.g and i > 20)) < 1e-9


def test_scroll_match(spark):
    rng = random.Random(5)
    strip = [rng.random() for _ in range(300)]
    rows = [(strip[:200], strip[k : 200 + k]) for k in (0, 3, 17)] + [(strip[:12], strip[:12]), (None, strip[:200]), ([1.0] * 200, [1.0] * 200)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(frames.scroll_match("a", "b", F.lit(80), F.lit(0.5)).alias("m")).collect()
    assert [r.m["shift"] for r in got[:3]] == [0, 3, 17] and all(r.m.confidence > 0.999 for r in got[:3])
    assert [tuple(r.m) for r in got[3:5]] == [(0, 0.0)] * 2 and got[5].m.confidence == 0.0


def test_greedy_rules(spark):
    near = ("killed 716 people in the city today", "killed 72,292 people in the city today")
    assert fuzzy.ratio(*near) > 60 and not D.dup_v6(*near)
    items = spark.createDataFrame([(1, 0, "alpha beta gamma delta one"), (1, 1, "alpha beta gamma delta one!"), (1, 2, "something else entirely"), (2, 0, "alpha beta gamma delta one")], "g long, pos long, text string")
    kept = D.dedup(items, "clean", "g").collect()
    assert sorted((r.g, r.pos) for r in kept) == [(1, 0), (1, 2), (2, 0)]
    for rule in D.RULES:
        out = D.dedup(items.withColumn("quality", F.lit(0.9)), rule, "g").collect()
        texts = [r.text for r in out if r.g == 1]
        assert not any(D.RULES[rule].same(a, b) for i, a in enumerate(texts) for b in texts[:i])


def noisy(rng, n):
    words = ["the", "river", "ran", "over", "7,123", "99", "2020", "stone", "hills", "Émile", "x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        u = list(t)
        for _ in range(rng.randint(0, 6)):
            if u and rng.random() < 0.5:
                u.pop(rng.randrange(len(u)))
            else:
                u.insert(rng.randint(0, len(u)), rng.choice("abé 3"))
        out.append("".join(u))
    return out + out[:4] + ["", " ", "  the  river"]


def plain_greedy(rows, rule):
    kept, dropped, replaced = [], 0, 0
    for x in rows:
        at = next((k for k, y in enumerate(kept) if rule.same(x.text, y.text)), None)
        if at is None:
            kept.append(x)
        elif rule.better and rule.better(x, kept[at]):
            kept[at] = x
            replaced += 1
        else:
            dropped += 1
    return kept, dropped, replaced


@pytest.mark.parametrize("rule", D.RULES)
@pytest.mark.parametrize("most", [2000, 13])
def test_dedup_equals_one_sequential_pass(spark, monkeypatch, rule, most):
    """In one task, and with slices and rounds so small that groups go by rounds or components; null texts and groups, ties,
    equal texts."""
    monkeypatch.setattr(D, "HEAD", most)
    monkeypatch.setattr(D, "SLICE", most)
    rng = random.Random(6)
    Item = collections.namedtuple("Item", "g pos text quality chunk")
    rows = [Item([None, 1, 2, 1][i % 4], i, t, rng.choice([0.2, 0.5, 0.52, 0.9, 0.95]), i // 20) for i, t in enumerate(noisy(rng, 40))] + [Item(1, 900, None, 0.5, 0)]
    got = collections.defaultdict(list)
    for r in D.dedup(spark.createDataFrame(rows, "g long, pos long, text string, quality double, chunk int"), rule, "g").collect():
        got[r.g].append((r.kept_pos, r.pos, r.text, r.dropped, r.replaced))
    for g in (None, 1, 2):
        own = [x for x in rows if x.g == g and x.text is not None]
        size = collections.Counter()
        for x in own:
            size[x.chunk] += len(x.text)
        key = {
            "v6": lambda x: (-x.quality, x.pos), "improve": lambda x: (-x.quality, abs(len(x.text) - 90) / 90, x.pos), "chunks": lambda x: (-size[x.chunk], -len(x.text), x.pos), "clean": lambda x: x.pos,
        }.get(rule, lambda x: (-len(x.text), x.text, x.pos))
        kept, dropped, replaced = plain_greedy(sorted(own, key=key), D.RULES[rule])
        assert sorted(got[g]) == [(k, x.pos, x.text, dropped, replaced) for k, x in enumerate(kept, 1)]


def test_pairs_covers_and_artifacts_over_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 11)
    rng = random.Random(9)
    rows = [(i % 2, i, t) for i, t in enumerate(noisy(rng, 30))]
    heads = ["OLD STEAM TRAIN FOUND NEAR THE HARBOUR", "STRIKE AT AIRPORT ENTERS ITS SECOND WEEK", "CUP FINAL DECIDED ON PENALTY KICKS TODAY"]
    rows += [(0, 500 + i, t) for i, t in enumerate([*heads, heads[0][:20] + heads[1][20:], f"{heads[0]} {heads[2]}", *heads])]
    df = spark.createDataFrame(rows + [(1, 999, None)], "g int, pos long, text string").repartition(3)
    for rule in D.RULES:
        got = sorted((r.g, r.pos, r.pos2) for r in D.duplicate_pairs(df, rule, "g").collect())
        assert got == sorted((g, p, q) for g, p, t in rows for h, q, u in rows if g == h and p < q and D.RULES[rule].same(t, u))
    want = []
    for g, p, t in rows:
        w = t.split()
        mid = len(w) // 2
        if len(t) >= 30 and len(w) >= 4:
            others = [(q, u.split()) for h, q, u in rows if h == g and q != p]
            first = {q for q, v in others if D.over(" ".join(w[:mid]), " ".join(v[:mid]), 65)}
            second = {q for q, v in others if D.over(" ".join(w[mid:]), " ".join(v[-mid:]), 65)}
            if second and first - second:
                want.append((g, p))
    assert sorted((r.g, r.pos) for r in D.merge_artifacts(df, "g").collect()) == sorted(want) and want
    good = spark.createDataFrame([(g, t[:9]) for g, _, t in rows[::3]], "g int, good string")
    got = sorted((r.g, r.pos) for r in D.uncovered(df.where("text is not null"), good, "g").collect())
    assert got == sorted((g, p) for g, p, t in rows if not any(h == g and fuzzy.partial_ratio(t.lower(), o[:9].lower()) > 80 for h, _, o in rows[::3]))


def test_bounds_lose_no_pair():
    rng = random.Random(11)
    letters = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    long = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in (60, 63, 64, 65, 127, 128, 129, 600)]
    for texts in (letters, noisy(rng, 25), long + [t[3:] + "xy" for t in long]):
        view = candidates.View(texts)
        i, j = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts)), indexing="ij"))
        assert candidates.lcs_pairs(view, view, i, j).tolist() == [fuzzy.lcs(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]
        for rule in D.RULES.values():
            block = candidates.Block(texts, rule.clauses)
            left = {p for a, b in candidates.possible(block, block) for p in zip(a.tolist(), b.tolist(), strict=True)}
            assert {(a, b) for a in range(len(texts)) for b in range(len(texts)) if rule.same(texts[a], texts[b])} <= left


def test_ranks_and_components_of_large_groups(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.randrange(40), i) for i in range(500)]
    got = {r.i: r.rank for r in rounds.ranked(spark.createDataFrame(rows, "g string, v int, i int").repartition(3), ["g"], [F.desc("v"), F.asc("i")]).collect()}
    for g in (None, "a", "b"):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[i] for _, _, i in own] == list(range(1, len(own) + 1))
    edges = [("x", i, i + 1) for i in range(1, 60)] + [("x", 100, k) for k in range(101, 140)] + [("y", 7, 7), ("y", 5, 9), (None, 3, 1)]
    got = {(r.g, r.node): r.root for r in rounds.components(spark.createDataFrame(edges, "g string, u long, v long"), "g").collect()}
    assert got == {("x", i): 1 for i in range(1, 61)} | {("x", k): 100 for k in range(100, 140)} | {("y", 5): 5, ("y", 9): 5, (None, 1): 1, (None, 3): 1}


def test_scans_and_quantiles_of_any_group(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, float("nan"), *map(float, range(12))]), rng.randint(-4, 4)) for i in range(900)]
    rows += [("none", i, None, None) for i in range(900, 904)] + [("one", 904, 2.5, 7)] * 2
    df = spark.createDataFrame(rows, "g string, i int, v double, w int").repartition(7)
    got = rounds.scanned(df, ["g"], [F.col("i"), F.col("w")], {"run": F.col("w"), "k": F.lit(1)}, {"run": "all"})
    seen, want = collections.Counter(), []
    totals = collections.Counter()
    for g, _, _, w in rows:
        totals[g] += w or 0
    for g, i, _, w in sorted(rows, key=lambda r: r[1]):
        seen[g, "run"] += w or 0
        seen[g, "k"] += 1
        want.append((str(g), i, seen[g, "run"], seen[g, "k"], totals[g]))
    assert sorted((str(r.g), r.i, r.run, r.k, r["all"]) for r in got.collect()) == sorted(want)
    for share in (0.0, 0.5, 0.9):
        plain = df.groupBy("g").agg(F.percentile("v", share).alias("q"))
        assert sorted(map(str, plain.collect())) == sorted(str(r).replace("quantile=", "q=") for r in rounds.quantile(df, ["g"], "v", share).collect())
    whole = df.where("not isnan(v)")
    assert rounds.quantile(whole, [], "v", 0.9).first()[0] == whole.select(F.percentile("v", 0.9)).first()[0]
    assert rounds.quantile(df.limit(0), ["g"], "v").count() == 0 and rounds.quantile(df.limit(0), [], "v").first()[0] is None
    assert frames.positions(df.withColumn("pos", F.lit(5)), "g", ("i",)).columns == ["g", "i", "v", "w", "pos"]
    board = runs.leaderboard(df.select("g", "i", "w"), "w", ["g"], ["i"]).where("g = 'hot'").orderBy("rank").collect()
    assert [r.rank for r in board] == list(range(1, len(board) + 1)) and [r.w for r in board] == sorted((r.w for r in board), reverse=True)


def test_segmentation(spark):
    heads = [f"HEADLINE NUMBER {w} ABOUT THE {x} OF A FARAWAY LAND" for w, x in zip(("ONE", "TWO", "SIX", "TEN"), ("RIVERS", "MOUNTAINS", "PEOPLE", "WEATHER"), strict=True)]
    text = " FOR MORE GO TO SITE.COM ".join([" - ".join(heads * 2)] * 3)
    streams = spark.createDataFrame([("a", text), ("b", "")], "stream string, text string")
    assert {r.text for r in segment_news(streams).collect()} <= set(heads) and segment_news(streams).count() >= 1
    assert {r.stream for r in improve_pipeline(streams).collect()} == {"a"}


def test_runs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, m double")
    got = {r.k: r for r in df.groupBy("k").agg(*runs.mean_std("m")).collect()}
    assert got["a"].mean == 2 and got["b"].std == 0 and got["c"].n == 0 and got["c"].mean != got["c"].mean
    rec = spark.createDataFrame([("m", "retry", "error", 3), ("m", "original", "success", 1), ("m", "chunked", "success", 2)], "model string, label string, status string, timestamp int")
    assert runs.latest_success(rec, ["model"]).first().label == "original" and runs.latest_success(rec, ["model"], "rank").first().label == "chunked"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"id": 1, "text": " a "}, {"id": 2, "text": ""}]))
    (tmp_path / "lines.txt").write_text("# c\n\none \n two\n")
    (tmp_path / "chunk_007").mkdir()
    (tmp_path / "chunk_007" / "t.txt").write_text("hello")
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tiles" / "1.json").write_text(json.dumps({"tile": "1", "headlines": [{"text": "A", "confidence": "low"}]}))
    (tmp_path / "tiles" / "2.json").write_text(json.dumps({"tile": "2", "error": "x"}))
    (tmp_path / "tiles" / "3.json").write_text("{broken")
    (tmp_path / "tiles" / "headlines_combined.json").write_text(json.dumps({"tile": "9", "headlines": []}))
    (tmp_path / "run.json").write_text(json.dumps({"results": [{"model_id": "m", "status": "success", "summary": "s"}]}))
    assert [r.text for r in readers.read_items(spark, f"{tmp_path}/items.json").collect()] == ["a"] and readers.read_items(spark, f"{tmp_path}/none.json").count() == 0
    assert [(r.pos, r.text) for r in readers.read_lines(spark, f"{tmp_path}/lines.txt").orderBy("pos").collect()] == [(2, "one"), (3, "two")]
    assert [(r.chunk, r.text) for r in readers.read_chunks(spark, f"{tmp_path}/chunk_*/t.txt").collect()] == [(7, "hello")]
    assert [(r.tile, r.text) for r in readers.read_tiles(spark, f"{tmp_path}/tiles").collect()] == [("1", "A")]
    assert [(r.label, r.model_id) for r in readers.read_runs(spark, [("original", f"{tmp_path}/run.json"), ("retry", f"{tmp_path}/no*.json")]).collect()] == [("original", "m")]
    items = spark.createDataFrame([("s", 5, "x"), ("s", 3, "y")], "g string, pos int, text string")
    writers.write_items(items, f"{tmp_path}/out", ["pos"], ["g"])
    assert sorted((r.id, r.text) for r in spark.read.json(f"{tmp_path}/out").collect()) == [(1, "y"), (2, "x")]
    seg = spark.createDataFrame([(0, 1.5, 2.0, " a "), (1, 901.0, 902.25, "b")], "id int, start double, end double, text string")
    assert [r.value for r in writers.srt(seg.withColumn("g", F.lit(1)), ["g"]).orderBy("n").collect()][1] == "2\n00:15:01,000 --> 00:15:02,250\nb\n"
    writers.write_chunks(seg, f"{tmp_path}/chunks")
    assert spark.read.text(f"{tmp_path}/chunks", wholetext=True).where("chunk_idx = 1").first().value.startswith("# chunk 001\n# segments 1\nb")
    small = spark.createDataFrame([(1, None), (22, 0.12345)], "a int, b double")
    assert "| 1 | n/a |" in writers.markdown(small) and writers.ascii_table(small).splitlines()[0] == "a   b"
    with pytest.raises(ValueError):
        writers.markdown(small, 1)
    assert writers.percent(0.12345) == "12.3 %" and writers.percent(None) == writers.percent(float("nan")) == "n/a" and writers.python_round(0.12345, 4) == round(0.12345, 4)
    writers.write_text(seg.withColumn("g", F.lit(1)), f"{tmp_path}/texts", ["g"])
    assert spark.read.text(f"{tmp_path}/texts", wholetext=True).first().value.strip() == "a\nb"
    for stamp in ("2024-01-01", "2024-01-02"):
        writers.write_run(seg.withColumn("text", F.lit(stamp)), f"{tmp_path}/runs", stamp)
    assert {r.text for r in readers.read_latest(spark, f"{tmp_path}/runs").collect()} == {"2024-01-02"} and readers.newest(spark, f"{tmp_path}/runs/run_ts=*").endswith("2024-01-02")
    with pytest.raises(PySparkException):  # a run that fails midway leaves the former one the latest, and no trace among the runs
        writers.write_run(seg.withColumn("text", F.raise_error(F.lit("midway")).cast("string")), f"{tmp_path}/runs", "2024-01-03")
    assert {r.text for r in readers.read_latest(spark, f"{tmp_path}/runs").collect()} == {"2024-01-02"} and readers.newest(spark, f"{tmp_path}/runs/run_ts=*").endswith("2024-01-02")
    seg.withColumn("text", F.lit("2024-01-04")).write.json(f"{tmp_path}/runs/run_ts=2024-01-04")  # written, but not yet the latest
    assert {r.text for r in readers.read_latest(spark, f"{tmp_path}/runs").collect()} == {"2024-01-02"}
    writers.write_run(seg.withColumn("text", F.lit("again")), f"{tmp_path}/runs", "2024-01-04")
    assert {r.text for r in readers.read_latest(spark, f"{tmp_path}/runs").collect()} == {"again"} and readers.read_latest(spark, f"{tmp_path}/none") is None
    for name in ("run_2", "run_10", "run_x", "run_"):
        (tmp_path / "found" / name).mkdir(parents=True)
    assert [n for n, _ in readers.discover_runs(spark, f"{tmp_path}/found")] == [2, 10] and readers.discover_runs(spark, f"{tmp_path}/none") == []
    for name in ("b.mp4", "a.mp4", "the channel.mp4"):
        (tmp_path / name).touch()
    assert readers.preferred(spark, f"{tmp_path}/*.mp4", "channel").endswith("channel.mp4") and readers.preferred(spark, f"{tmp_path}/*.mp4").endswith("a.mp4") and readers.preferred(spark, f"{tmp_path}/*.avi") is None
    (tmp_path / "words.json").write_text(json.dumps([{"x": 1, "text": "a", "confidence": 0.5}]))
    (tmp_path / "empty.json").write_text("[]")
    assert [[r.status for r in readers.read_words(spark, f"{tmp_path}/{n}.json").collect()] for n in ("words", "empty", "none")] == [["ok"], ["empty"], ["missing"]]
    assert readers.newest(spark, f"{tmp_path}/nothing*") is None


def test_wav_ranges_at_every_cut(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {}
    for name, width, channels, n in (("a", 2, 1, 1000), ("b", 4, 2, 777), ("c", 2, 3, 5), ("d", 4, 1, 0)):
        values = rng.integers(-(1 << (8 * width - 1)), 1 << (8 * width - 1), (n, channels))
        made[name] = (values.mean(1).astype(np.float32) / np.float32(pcm.SCALE[width]) if channels > 1 else values[:, 0].astype(np.float32) / np.float32(pcm.SCALE[width])) if n else np.empty(0, np.float32)
        frame = width * channels
        body = values.astype(f"<i{width}").tobytes()
        extra = b"LIST" + (3).to_bytes(4, "little") + b"abc\0"  # a chunk of odd length before the samples
        form = b"fmt " + b"".join(v.to_bytes(k, "little") for v, k in ((16, 4), (1, 2), (channels, 2), (100, 4), (100 * frame, 4), (frame, 2), (8 * width, 2)))
        claimed = 2**32 - 1 if name == "b" else len(body)  # written as a stream: the length is not known
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF\0\0\0\0WAVE" + form + extra + b"data" + claimed.to_bytes(4, "little") + body)
    (tmp_path / "_hidden.wav").write_bytes(b"no")
    (tmp_path / "notes.txt").write_text("no")
    spark.dataSource.register(pcm.PcmSource)
    for size, split, every, begin, end in ((1, 64, 1, 0, None), (7, 50, 1, 0, None), (64, 100, 3, 0.33, None), (1000, 10**9, 1, 1, 5.5), (33, 41, 2, 2.0, 7.01)):
        read = spark.read.format("pcm").option("range", size).option("split", split).option("every", every).option("begin", begin)
        rows = (read if end is None else read.option("end", end)).load(str(tmp_path)).collect()
        got = {(r.path.rsplit("/", 1)[-1][0], r.start): r.samples for r in rows}
        want = {}
        for name, x in made.items():
            last = len(x) if end is None else min(len(x), int(np.ceil(end * 100)))
            first = int(np.ceil(begin * 100))
            want |= {(name, s): x[s : min(s + size, last)].tolist() for s in range(first, last, size * every)}
        assert got == want and len(rows) == len(got)
    assert spark.read.format("pcm").option("split", 100).load(str(tmp_path)).rdd.getNumPartitions() > 10
    (tmp_path / "odd").mkdir()
    assert spark.read.format("pcm").load(str(tmp_path / "odd")).count() == 0
    (tmp_path / "odd" / "e.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0, 100, 0, 0, 0, 44, 1, 0, 0, 3, 0, 24, 0]) + b"data\3\0\0\0abc")
    with pytest.raises(PySparkException, match="Unsupported sample width: 3"):
        spark.read.format("pcm").load(str(tmp_path / "odd")).count()
    df = spark.createDataFrame([("x", 2, 5, None), ("x", 1, -32768, 3), ("y", 1, 32767, 0)], "f string, o int, a int, b int")
    assert pcm.write_wav(df, "f", "o", ["a", "b"], str(tmp_path / "new")) == 2
    back = {r.path[-5]: r.samples for r in spark.read.format("pcm").load(str(tmp_path / "new")).collect()}
    assert back == {"x": [(-32768 + 3) / 2 / 32768, 2.5 / 32768], "y": [32767 / 2 / 32768]}
    with pytest.raises(PySparkException, match="does not fit"):
        pcm.write_wav(df.withColumn("a", F.lit(32768)), "f", "o", ["a"], str(tmp_path / "new"))


def test_variants_in_order(spark, tmp_path):
    rows = [(v, i % 37, i, "t\n") for i in range(300) for v in (["hot", None] if i % 3 else ["hot", "b"])]
    df = spark.createDataFrame(rows, "v string, a long, b long, t string").repartition(6)
    writers.write_variants(df, "v", ("a", "b"), str(tmp_path / "out"))
    got = [(r.v, r.n, r.a, r.b) for r in spark.read.schema("n long, a long, b long, t string, v string").json(str(tmp_path / "out")).collect()]
    want = []
    for v in ("hot", "b", None):
        want += [(v, n, a, b) for n, (a, b) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == v), 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for f in sorted((tmp_path / "out" / "v=hot").glob("*.json")):
        n = [json.loads(line)["n"] for line in f.read_text().splitlines()]
        assert n == list(range(n[0], n[0] + len(n)))


def test_calls(spark):
    rows = spark.createDataFrame([("echo", "m", "a b"), ("no", "m", "x")], "provider string, model_id string, prompt string")
    got = {r.provider: r for r in calls.run_models(rows).collect()}
    assert got["echo"].status == "success" and got["no"].status == "error" and got["no"].summary is None
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429 retry_delay { seconds: 7 }" if len(tries) == 1 else "timeout")
        return "ok"

    assert calls.Retry(20, 2, 3, waits.append).call(flaky) == "ok" and waits == [7.0, 40]
    with pytest.raises(ValueError):
        calls.Retry(1, 1, 3, waits.append).call(lambda: int("x"))
    tries.clear()
    waits.clear()
    linear = dataclasses.replace(calls.IMAGES, sleep=waits.append)

    def limited():
        tries.append(1)
        raise RuntimeError("429 retry_delay { seconds: 7 }" if len(tries) == 2 else "rate limit")

    with pytest.raises(RuntimeError):
        linear.call(limited)
    assert waits == [11, 8, 31] and len(tries) == 4
    assert calls.guarded(["a", "b", "c"], ["a"]) == ["a", "b", "c"] and calls.first_that_parses(lambda x: None, lambda x: x[:1])(["a", "b"]) == ["a"]
    chunks = spark.createDataFrame([("t", i, f"text {i}") for i in range(45)], "g string, pos int, text string")
    models = spark.createDataFrame([("echo", "m1"), ("echo", "m2")], "provider string, model_id string")
    assert calls.summarize(chunks, models, "g").count() == 6
    with pytest.raises(ValueError, match="1000 models"):
        calls.summarize(chunks, spark.range(1001).selectExpr("'echo' provider", "string(id) model_id"), "g")


def test_three_levels_and_cleaning(spark):
    chunks = spark.createDataFrame([("t", i, f"text {i}") for i in range(45)], "g string, pos int, text string")
    models = spark.createDataFrame([("echo", "m1"), ("flaky", "m2"), ("rare", "m3")], "provider string, model_id string")

    def flaky(model, system, user):
        if "[20]" in user:
            raise ValueError("no answer")
        return "fine"

    def rare(model, system, user):
        return "good" if user.endswith("7") else ""

    got = {r.model_id: r for r in calls.summarize_in_three(chunks, models, "g", providers={"echo": calls.echo, "flaky": flaky, "rare": rare}).collect()}
    assert set(got) == {"m1", "m2"} and got["m1"].status == "success" and got["m2"].status == "error" and got["m2"].error == "a batch is incomplete"
    assert calls.merged(["a"] * 3, lambda x: []) == ["a"] * 3 and calls.merged(list("abcdef"), lambda x: 1 / 0, lambda x: x[:2], lambda x: x[:4]) == list("abcd")
    heads = ["RIVERS FLOOD THREE VALLEYS AFTER RAIN", "MINISTERS AGREE ON NEW PENSION LAW", "OLD STEAM TRAIN FOUND BENEATH HARBOUR", "STRIKE AT AIRPORT ENTERS SECOND WEEK", "FAMOUS PAINTER DIES AGED NINETY ONE", "CUP FINAL DECIDED ON PENALTY KICKS"]
    items = spark.createDataFrame([("s", i, t) for i, t in enumerate([*heads, *(h.lower() for h in heads), "short"])], "g string, pos long, text string")
    upper = lambda x: [t.upper() for t in x]
    got = calls.clean_run(items, "g", (lambda x: None, upper), (lambda x: x[:1], lambda x: x[:4]), batch=5).collect()
    assert len(got) == 4 and {r.text for r in got} <= set(heads) and sorted(r.id for r in got) == [1, 2, 3, 4]


def test_engines(spark):
    class Letters:
        name = "letters"

        def run(self, content):
            if content == b"!":
                raise ValueError("unreadable")
            return [(len(content) - i, chr(c), 0.9) for i, c in enumerate(content)]

    class Teller:
        name, model_id = "teller", "t1"

        def call(self, content, mime, prompt):
            if not content:
                raise TimeoutError("late")
            return f'{{"headlines": ["{mime} {prompt}"]}}', 1, 2

    files = spark.createDataFrame([("a.png", bytearray(b"abc")), ("b.jpg", bytearray(b"!")), ("c.jpg", bytearray())], "path string, content binary")
    got = {r.path: r for r in engines.recognise(files, Letters).collect()}
    assert got["a.png"].full_text == "c b a" and got["b.jpg"].error == "ValueError: unreadable" and got["c.jpg"].words == []
    assert all(r.wall_seconds >= 0 and r.rss_mb_before > 0 and r.rss_mb_after > 0 for r in got.values())
    took = {r.path: r for r in engines.timings(engines.recognise(files, Letters)).collect()}
    assert took["a.png"].text_length_chars == 5 and took["a.png"].word_count == 3 and took["b.jpg"].word_count == 0 and took["b.jpg"].error
    sums = engines.resources(engines.recognise(files, Letters)).collect()
    assert [(r.engine, r.calls, r.failed) for r in sums] == [("letters", 3, 1)] and sums[0].rss_mb_peak > 0
    got = {r.path: r for r in engines.ask(files, Teller, "p").collect()}
    assert [h.text for h in got["a.png"].headlines] == ["IMAGE/PNG P"] and got["c.jpg"].error == "TimeoutError: late" and got["c.jpg"].headlines == []


def test_streaming_dedup_and_windows(spark, tmp_path):
    schema = "g string, pos long, text string, ts timestamp, value double"
    when = datetime.datetime(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame([(g, p, t, when, 1.0) for g, p, t in x], schema)
    rows(("a", 0, "alpha beta gamma delta one"), ("a", 1, "alpha beta gamma delta one!"), ("b", 0, "alpha beta gamma delta one")).write.parquet(f"{tmp_path}/in/1")

    def go(make, name):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        out = []
        q = make(stream).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return out, jobs.progress(q)

    kept = lambda s: jobs.kept_items(s, "g", "clean")
    out, p = go(kept, "kept")
    assert sorted((r.g, r.pos) for r in out) == [("a", 0), ("b", 0)] and p["rows"] == 3 and not p["active"] and p["error"] is None
    rows(("a", 2, "alpha beta gamma delta one?"), ("a", 3, "something else entirely")).write.parquet(f"{tmp_path}/in/2")
    assert [(r.g, r.pos) for r in go(kept, "kept")[0]] == [("a", 3)]  # the kept list came back from the checkpoint
    assert len(go(lambda s: jobs.first_seen(s, "ts", "text"), "seen")[0]) == 4
    out = []
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    jobs.tumbling(stream, "ts").writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/tumbling").trigger(availableNow=True).start().awaitTermination()
    assert out[-1].segments == 5 and out[-1].total == 5.0


@pytest.mark.parametrize("rule", ["clean", "v6", "aggregate"])
def test_kept_items_equal_one_greedy_pass(spark, tmp_path, monkeypatch, rule):
    from murmur.streaming import kept

    monkeypatch.setattr(kept, "PAGE", 3)  # the driver's value; workers keep theirs, so the plain class is held against it below
    rng = random.Random(len(rule))
    words = "alpha beta gamma delta epsilon zeta".split()
    text = lambda: rng.choice([None, "", "ab", *(" ".join(rng.choices(words, k=rng.randint(1, 9))).replace("a", rng.choice("aaAe")) for _ in range(12))])
    rows = [(rng.choice(["a", "a", None]), i, text()) for i in range(240)]
    want, seen = [], {}
    for g, i, t in rows:
        if t is not None and not any(D.RULES[rule].same(t, k) for k in seen.setdefault(g, [])):
            seen[g].append(t)
            want.append((str(g), i, t))
    out = []
    for part in range(3):  # a new query from the checkpoint for each part
        spark.createDataFrame(rows[part * 80 : part * 80 + 80], "g string, pos long, text string").repartition(3).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema("g string, pos long, text string").parquet(f"{tmp_path}/in/*")
        jobs.kept_items(stream, "g", rule).writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r.g), r.pos, r.text) for r in out) == sorted(want)

    class Map(dict):
        getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815

    import pandas as pd

    for g in ("a", None):
        p = kept.Kept(rule)
        p.pages, p.counts = Map(), Map()
        mine = [r for r in rows if r[0] == g]
        got = [t for k in range(0, len(mine), 17) for y in p.handleInputRows((g,), iter([pd.DataFrame(mine[k : k + 17], columns=["g", "pos", "text"])]), None) for t in y["pos"]]
        assert got == [i for k, i, _ in want if k == str(g)] and all(len(v[0]) <= 3 for v in p.pages.values())


def test_job_board(spark, tmp_path):
    at = f"{tmp_path}/jobs"
    listener = board.JobListener(at)
    spark.streams.addListener(listener)
    try:
        spark.range(10).write.parquet(f"{tmp_path}/in/1")

        def start(name, work):
            stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in/*")
            return stream.writeStream.queryName(name).foreachBatch(work).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()

        def wrong(batch, n):
            raise ValueError("no such thing")

        def settled(want):
            for _ in range(100):
                rows = {r.job: r for r in board.board(spark, at).collect()} if (tmp_path / "jobs").exists() else {}
                if {k: v.status for k, v in rows.items()} == want:
                    return rows
                time.sleep(0.2)
            raise AssertionError(rows)

        start("good", lambda b, n: b.count()).awaitTermination()
        with pytest.raises(PySparkException):
            start("bad", wrong).awaitTermination()
        rows = settled({"good": "done", "bad": "failed"})
        assert rows["good"].rows == 10 and rows["good"].batches == 1 and rows["good"].message is None
        assert "no such thing" in rows["bad"].message and rows["bad"].batches == 0
        spark.range(5).write.parquet(f"{tmp_path}/in/2")
        start("bad", lambda b, n: b.count()).awaitTermination()  # the failed batch again, then what is new
        start("good", lambda b, n: b.count()).awaitTermination()
        rows = settled({"good": "done", "bad": "done"})
        assert rows["good"].rows == rows["bad"].rows == 15 and rows["good"].batches == 2
    finally:
        spark.streams.removeListener(listener)
    files = sum(f.suffix == ".parquet" for f in (tmp_path / "jobs").iterdir())
    last = max(r.updated_at for r in rows.values())
    for _ in range(2):  # told twice: one row
        listener._put("batch:0", "lost", last, "running", 0, 7, None)
    assert sum(f.suffix == ".parquet" for f in (tmp_path / "jobs").iterdir()) == files + 1
    jobs.append_status(spark.createDataFrame([("old", 5, "done"), ("old", 4, "running")], jobs.STATUS), at)
    now = {r.job: r.status for r in board.board(spark, at, last + 1001, 1000).collect()}
    assert now == {"good": "done", "bad": "done", "lost": "interrupted", "old": "done"}
    assert {r.job: r.status for r in board.board(spark, at, last + 1000, 1000).collect()}["lost"] == "running"


def test_streaming_resume(spark, tmp_path):
    schema = "ts timestamp, value double"
    rows = lambda n: spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, i), float(i)) for i in range(n)], schema)
    rows(10).write.parquet(f"{tmp_path}/in/a")
    work = lambda df: df.groupBy(F.window("ts", "15 minutes").start.alias("start")).agg(F.count("*").alias("n"))
    go = lambda: jobs.resume(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/cp", work)
    assert go() >= 1 and go() == 0
    rows(5).write.parquet(f"{tmp_path}/in/b")
    assert go() >= 1 and spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] == 15


def test_registry_is_whole(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert e.entry(spark).columns == ["threshold", "tp_gt", "tp_ext", "fn", "fp", "precision", "recall", "f1"]
