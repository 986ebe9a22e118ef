"""Three scorers of noisy items; they look alike and have different thresholds, so they stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.text import col, count_class, replace, words


def bind(value: Column, f) -> Column:
    """f(value) with value computed once (a one-element array holds it), however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _letters(w: Column) -> Column:
    return replace(w, "[^a-zA-Z]", "")


def quality_v6(c) -> Column:
    """Capitals (0.4), real words (0.4), length (0.2); 0 under 15 characters or without letters."""
    n, alpha = F.length(col(c)), count_class(c, "\\p{Alpha}")
    real = lambda w: F.size(F.filter(w, lambda x: (F.length(x) >= 3) & (count_class(x, "\\p{Alpha}") / F.length(x) > 0.7))) / F.size(w)
    length = F.when(n < 30, 0.5).when(n > 200, 0.6).otherwise(1.0)
    score = lambda a: count_class(c, "\\p{Lu}") / a * 0.4 + bind(words(c), real) * 0.4 + length * 0.2
    return F.when(n < 15, F.lit(0.0)).otherwise(bind(alpha, lambda a: F.when(a == 0, F.lit(0.0)).otherwise(score(a))))


#: Five letters in a row of one or two kinds: the second kind may come second, third, fourth or last.
TWO_LETTERS = r"(.)(.)(?:\1|\2){3}|(.)\3(.)(?:\3|\4){2}|(.)\5{2}(.)(?:\5|\6)|(.)\7{3}."


def _good(x: Column, vowels_from: int, run_from: int, longest: int | None) -> Column:
    n = F.length(x)
    vowels = F.length(replace(x, "[^aeiouAEIOU]", ""))
    # A change of case between neighbours: upper before lower plus lower before upper.
    switches = F.regexp_count(x, F.lit("[a-z](?=[A-Z])")) + F.regexp_count(x, F.lit("[A-Z](?=[a-z])"))
    run = (n >= run_from) & F.regexp_like(F.lower(x), F.lit(TWO_LETTERS))
    bad = ((n >= vowels_from) & (vowels == 0)) | ((n >= 4) & (switches > 2) & (switches >= n * 0.4)) | run
    return ~(bad | (n > longest)) if longest else ~bad


def _shares(c, vowels_from: int, run_from: int, longest: int | None, f) -> Column:
    """f(struct of good, scored, n_words, last): words judged good, words with letters, all words, letters of the last one."""

    def of(w: Column) -> Column:
        spelled = F.filter(F.transform(w, _letters), lambda x: x != "")
        return bind(spelled, lambda s: F.struct(F.size(F.filter(s, lambda x: _good(x, vowels_from, run_from, longest))).alias("good"), F.size(s).alias("scored"), F.size(w).alias("n_words"), F.length(_letters(F.element_at(w, -1))).alias("last")))

    return bind(bind(words(c), lambda w: F.when(F.size(w) > 0, of(w))), f)


def quality_merge(c) -> Column:
    """0.6 good words + 0.4 length - penalty for a clipped end; 0 under 20 characters, 3 words or without letters."""
    n = F.length(col(c))
    length = F.when(n < 40, 0.3).when(n <= 120, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 120) / 200))

    def score(x: Column) -> Column:
        penalty = F.when(x["last"].between(1, 2) | col(c).endswith("-") | col(c).endswith(","), 0.05).otherwise(0.0)
        return F.when((x["n_words"] >= 3) & (x["scored"] > 0), x["good"] / x["scored"] * 0.6 + length * 0.4 - penalty).otherwise(F.lit(0.0))

    return F.when(n < 20, F.lit(0.0)).otherwise(_shares(c, 4, 5, None, score))


def quality_improve(c) -> Column:
    """0.5 good words + 0.5 length - 0.1 for a scrap at the end; at least 0; 0 under 35 characters or 3 words."""
    n = F.length(col(c))
    length = F.when(n < 40, 0.3).when(n < 50, 0.6).when(n <= 130, 1.0).when(n <= 150, 0.7).when(n <= 180, 0.4).otherwise(0.2)

    def score(x: Column) -> Column:
        raw = x["good"] / F.greatest(x["scored"], F.lit(1)) * 0.5 + length * 0.5 - F.when(x["last"] <= 2, 0.1).otherwise(0.0)
        return F.when(x["n_words"] >= 3, F.greatest(F.lit(0.0), raw)).otherwise(F.lit(0.0))

    return F.when(n < 35, F.lit(0.0)).otherwise(_shares(c, 5, 6, 16, score))


def cycle_score(n_delimiters: Column, n_chars: Column, edge: Column) -> Column:
    """How complete and clean a cycle is: delimiters (best 10 to 35), place (the first and last are partial), length."""
    split = F.when(n_delimiters < 10, n_delimiters / 10).when(n_delimiters > 35, 35 / n_delimiters).otherwise(1.0)
    size = F.when(n_chars < 500, 0.2).when(n_chars > 4000, 3000 / n_chars).otherwise(1.0)
    return split * F.when(edge, 0.3).otherwise(1.0) * size


def garbage_v6(c) -> Column:
    """The reason for which an item goes, null if it stays."""
    n = F.length(col(c))
    return F.when(n < 20, "too_short").when((quality_v6(c) < 0.86) | (n > 150), "garbage")


def class_improve(c) -> Column:
    """garbage, good (40 to 140 characters) or merged."""
    n = F.length(col(c))
    return F.when((n < 35) | (n > 200) | (quality_improve(c) < 0.5), "garbage").when(n.between(40, 140), "good").otherwise("merged")


def keep_post_merge(c) -> Column:
    return (F.length(col(c)) >= 40) & (quality_merge(c) >= 0.55) & ~F.regexp_like(col(c), F.lit("(?i)^for more"))
