"""What the findings of round 3 asked for."""

import collections
import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions import text as T
from murmur.operators import candidates, matching
from murmur.operators import dedup as D
from tests.test_core import noisy, plain_greedy


@pytest.fixture
def apart(spark):
    """Shuffles whose partitions stay apart, as they do where tables are large."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def test_cosine_slices_meet(apart):
    """slices met only where a long and an int fell into one partition by chance."""
    rng = random.Random(3)
    rows = apart.createDataFrame([(i % 3, i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "g int, id int, e array<double>")
    found = {r.id: r.best for r in matching.best_cosine(rows, rows.select("g", "e"), "g", 7).collect()}
    assert set(found) == set(range(60)) and all(abs(v - 1) < 1e-9 for v in found.values())


def test_blocks_and_parts_meet(apart, monkeypatch):
    """The same step in the best-match join."""
    monkeypatch.setattr(matching, "BLOCK_CHARS", 60)
    monkeypatch.setattr(matching, "PART_CHARS", 100)
    rows = apart.createDataFrame([(i, f"text number {i}") for i in range(40)], "id long, text string")
    found = matching.best_matches(rows, rows).collect()
    assert len(found) == 80 and all(r.id == r.other and r.score == 100 for r in found)


def test_upper_keeps_letters_apart(spark):
    """ß became SS and met the word ss."""
    said = ["straße ss aéö", "ᾀŉﬁ\U00010428x", "", None, "plain"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, x string").orderBy("i").select(T.upper_each("x").alias("v")).collect()]
    assert got == ["STRAẞE SS AÉÖ", "ᾈŉﬁ\U00010400X", "", None, "PLAIN"]


@pytest.mark.parametrize("rule", D.RULES)
@pytest.mark.parametrize("slices", [2000, 13])
def test_links_count_all_pairs(apart, monkeypatch, rule, slices):
    """F1 to F3, F12: one row an item, with the number of pairs that it is in; copies, null groups and texts, groups in one cell and in slices."""
    monkeypatch.setattr(D, "SLICE", slices)
    monkeypatch.setattr(D, "CELL", 200)
    texts = noisy(random.Random(4), 12)
    rows = [(g, i, t) for g in (None, 1, 2, 3, 4) for i, t in enumerate(texts[: 40 - 7 * (g or 0)] + texts[:5])] + [(1, 900, None), (9, 0, "alone")]
    got = {(r.g, r.pos): (r.class_id, r.n_links) for r in D.duplicate_links(apart.createDataFrame(rows, "g int, pos int, text string").repartition(3), rule, "g").collect()}
    same = D.RULES[rule].same
    want = {(g, p): (min(q for h, q, u in rows if (g, t) == (h, u)), sum(g == h and p != q and u is not None and same(t, u) for h, q, u in rows)) for g, p, t in rows if t is not None}
    assert got == want


@pytest.mark.parametrize("rule", D.RULES)
@pytest.mark.parametrize("known", [1 << 28, 0])
def test_pass_over_copies(monkeypatch, rule, known):
    """F8 to F15: copies that come while places change hands, of one quality and of several."""
    monkeypatch.setattr(D, "KNOWN", known)
    monkeypatch.setattr(D, "ROWS", 5)
    rng = random.Random(11)
    Item = collections.namedtuple("Item", "pos text quality")
    texts = noisy(rng, 15)
    for own in (True, False):
        mark = {t: rng.choice([0.2, 0.5, 0.52, 0.9, 0.95]) for t in texts}
        rows = [Item(i, t, mark[t] if own else rng.choice([0.5, 0.9, 0.95])) for i, t in enumerate(rng.choices(texts, k=400))]
        calls = []
        counted = dataclasses.replace(D.RULES[rule], same=lambda a, b: calls.append((a, b)) or D.RULES[rule].same(a, b))
        found, dropped, replaced = D.greedy(rows, counted)
        kept, less, moved = plain_greedy(rows, D.RULES[rule])
        assert ([x for x, _ in found], dropped, replaced) == (kept, less, moved)
        assert not known or len(calls) == len(set(calls))


def test_components_still_equal_one_pass(spark, monkeypatch):
    """Groups of many distinct texts go by components as before."""
    rng = random.Random(6)
    rows = [(i % 2, i, t, rng.choice([0.2, 0.5, 0.9]), i // 20) for i, t in enumerate(noisy(rng, 40))]
    df = spark.createDataFrame(rows, "g long, pos long, text string, quality double, chunk int")
    for rule in ("v6", "improve", "chunks"):
        whole = sorted(D.dedup(df, rule, "g").collect())
        with monkeypatch.context() as m:
            m.setattr(D, "HEAD", 9)
            m.setattr(D, "SLICE", 9)
            m.setattr(D, "HEADS", 1)
            assert sorted(D.dedup(df, rule, "g").collect()) == whole


@pytest.mark.parametrize("few", [256, 0])
def test_artifacts_of_copies(spark, monkeypatch, few):
    """F8: copies are one text, which may match itself where it occurs again."""
    monkeypatch.setattr(D, "FEW", few)
    texts = ["OLD STEAM TRAIN FOUND NEAR THE HARBOUR", "OLD STEAM TRAIN FOUND ITS SECOND WEEK", "STRIKE AT AIRPORT ENTERS ITS SECOND WEEK", "alpha beta gamma alpha beta gamma more"]
    rows = [(g, i, t) for g in (1, 2) for i, t in enumerate(texts * g)] + [(2, 99, None)]
    want = []
    for g, p, t in ((g, p, t) for g, p, t in rows if t is not None):
        w = t.split()
        mid = len(w) // 2
        others = [(q, u.split()) for h, q, u in rows if u is not None and h == g and q != p]
        first = {q for q, v in others if D.over(" ".join(w[:mid]), " ".join(v[:mid]), 65)}
        second = {q for q, v in others if D.over(" ".join(w[mid:]), " ".join(v[-mid:]), 65)}
        if second and first - second:
            want.append((g, p))
    assert sorted((r.g, r.pos) for r in D.merge_artifacts(spark.createDataFrame(rows, "g int, pos int, text string"), "g").collect()) == want and want


def test_tasks_follow_the_work(spark, monkeypatch):
    """F16: tasks grow in number with the texts, not in length; the same matches."""
    left = spark.createDataFrame([(i, f"reference {i} of some length") for i in range(5)], "id long, text string")
    right = spark.createDataFrame([(i, f"text {i} that refers to reference {i % 5}") for i in range(90)], "id long, text string").coalesce(2)
    whole = sorted(matching.best_matches(left, right).collect())
    deals = []
    deal = type(right).repartition
    monkeypatch.setattr(matching, "TASK_WORK", 30_000)
    monkeypatch.setattr(type(right), "repartition", lambda self, n, *by: deals.append(n) or deal(self, n, *by))
    assert sorted(matching.best_matches(left, right).collect()) == whole and deals and deals[0] > 20


def _sentences(rng, n):
    """Sentences of a few syllables, which have most letters and bigrams in common."""
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti", "tion", "ing", "ly"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(n)]


def test_nearest_substrings():
    """the bound on partial ratios, part by part of 64 characters, against the plain table."""
    rng = random.Random(6)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b):
                new.append(row[j] if x == y else 1 + min(row[j + 1], new[j]))
            row = new
        return min(row)

    texts = ["".join(rng.choice("abcdé 𝄞"[:k]) for _ in range(n)) for k in (1, 2, 7) for n in (0, 1, 2, 20, 63, 64, 65, 127, 128, 129, 200)]
    texts += [t[10:60] + t[70:90] for t in texts if len(t) > 100]
    view = candidates.View(texts)
    i, j = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    want = [sum(plain(texts[a][k : k + 64], texts[b]) for k in range(0, len(texts[a]), 64)) for a, b in zip(i, j, strict=True)]
    assert candidates.nearest_pairs(view, view, i, j, np.full(len(i), 10_000)).tolist() == want
    part = candidates.nearest_pairs(view, view, i, j, np.full(len(i), 10))
    assert all(p == w if w <= 10 else 10 < p <= w for p, w in zip(part.tolist(), want, strict=True))


def test_bounds_lose_no_pair_of_long_and_saturated_texts():
    """letters that occur more than 255 times, and texts too long for the bound."""
    rng = random.Random(8)
    long = ["a" * 300 + "bc" * 40, "a" * 270 + "cb" * 45, "xa" * 400, "".join(rng.choice("ab ") for _ in range(1500)), "".join(rng.choice("abcd ef") for _ in range(4200))]
    texts = long + [t[len(t) // 3 :] for t in long] + [t[5:] + "zz" for t in long]
    for name in ("longest", "aggregate"):
        rule = D.RULES[name]
        block = candidates.Block(texts, rule.clauses)
        left = {p for a, b in candidates.possible(block, block) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert {(a, b) for a in range(len(texts)) for b in range(len(texts)) if rule.same(texts[a], texts[b])} <= left


def test_few_pairs_reach_the_predicate():
    """most of the time of dedup_sentences went to pairs that an LCS with the whole and the letters of windows had left."""
    rng = random.Random(7)
    texts = _sentences(rng, 150)
    texts += [t[4 : len(t) // 2] + "x" + t[len(t) // 2 : -3] for t in texts[:20]]
    rule = D.RULES["longest"]
    block = candidates.Block(texts, rule.clauses)
    left = {p for a, b, _ in candidates.judged(block, block, lambda i, j: i < j) for p in zip(a.tolist(), b.tolist(), strict=True)}
    true = {(a, b) for b in range(len(texts)) for a in range(b) if rule.same(texts[a], texts[b])}
    assert len(true) >= 20 and true <= left and len(left) <= 2 * len(true)
