"""What the findings of round 4 asked for."""

import random

import pytest

from murmur.functions import fuzzy
from murmur.operators import candidates
from murmur.operators import dedup as D
from tests.test_core import noisy


def test_token_sets_are_certain():
    """most of the time of dup_pairs_aggregate went to token-set ratios of single pairs; now the block has them."""
    rng = random.Random(5)
    words = ["at", "AT", "900", "1600", "large", "larger", "ring", "r1ng", "über", "𝄞x", "too", "of", "the", "day", "a" * 30]
    texts = ["", " ", "at", "at at", "the day\tof"] + [" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(120)] + noisy(rng, 8)
    many = [f"w{i}" for i in range(80)]
    texts += [" ".join(many[:n]) for n in (61, 62, 63, 64, 80)] + [" ".join(many[5:70] + ["z"]), " ".join(w + "x" for w in many)]
    clauses = (candidates.Clause("token_set", 80, over=False),)
    half = len(texts) // 2
    for x, y in ((texts, texts), (texts[:half], texts[half:])):
        left, right = candidates.Block(x, clauses), candidates.Block(y, clauses)
        got = [(a, b, s) for i, j, sure in candidates.judged(left, right) for a, b, s in zip(i.tolist(), j.tolist(), sure.tolist(), strict=True)]
        assert all(s for *_, s in got)
        assert {(a, b) for a, b, _ in got} == {(a, b) for a, s in enumerate(x) for b, t in enumerate(y) if fuzzy.token_set_ratio(s, t) >= 80}


@pytest.mark.parametrize("rule", D.RULES)
@pytest.mark.parametrize("slices", [500, 7])
@pytest.mark.parametrize("over_all", [True, False])
def test_links_of_groups_with_the_same_texts(spark, monkeypatch, rule, slices, over_all):
    """groups that have most texts in common judged each pair again; null groups and texts, copies, texts of one group alone."""
    monkeypatch.setattr(D, "SLICE", slices)
    monkeypatch.setattr(D, "SHARED", slices)
    monkeypatch.setattr(D, "GROUPS", 1000 if over_all else 0)
    monkeypatch.setattr(D, "_links" if over_all else "_links_over_all", None)
    rng = random.Random(9)
    texts = noisy(rng, 8)
    rows = [(g, i, t) for g in (None, "b", "c", "") for i, t in enumerate(rng.sample(texts, len(texts) - 3) + texts[:4])] + [("b", 900, None), ("d", 0, "alone")]
    got = {(r.g, r.pos): (r.class_id, r.n_links) for r in D.duplicate_links(spark.createDataFrame(rows, "g string, pos int, text string").repartition(3), rule, "g").collect()}
    same = D.RULES[rule].same
    want = {(g, p): (min(q for h, q, u in rows if (g, t) == (h, u)), sum(g == h and p != q and u is not None and same(t, u) for h, q, u in rows)) for g, p, t in rows if t is not None}
    assert got == want


def test_halves_equal_one_pass(spark, monkeypatch):
    """every round ranked and wrote all undecided items of a group anew; groups end at different halves, one has only copies left."""
    rng = random.Random(13)
    texts = noisy(rng, 8)
    rows = [(g, i, t) for g, n in ((None, 12), (1, 40), (2, len(texts))) for i, t in enumerate(texts[:n] + texts[:3])] + [(3, i, "the same text again and again" + "!" * (i % 15)) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, pos int, text string").repartition(3)
    whole = sorted(D.dedup(df, "longest", "g").collect(), key=str)
    names = []
    stored = D.stored
    monkeypatch.setattr(D, "HEAD", 8)
    monkeypatch.setattr(D, "stored", lambda x, name: names.append(name) or stored(x, name))
    assert sorted(D.dedup(df, "longest", "g").collect(), key=str) == whole
    assert names.count("ranks") == 1 and names.count("left") >= 2
