"""Similarity of strings and word sets as column expressions; none is a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def grams(text: Column, size: int = 3) -> Column:
    """Substrings of ``size`` characters, white space runs as one space; none for shorter texts."""
    flat = F.regexp_replace(text, r"\s+", " ")
    n = F.length(flat) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(flat, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def qgram_similarity(a: Column, b: Column) -> Column:
    """(n + m - L1 distance of the 3-gram profiles) / (n + m); 0 if either is null or both are empty."""
    x, y = grams(a), grams(b)

    def shared(acc, g):
        times = lambda c: F.size(F.filter(c, lambda o: o == g))
        return acc + F.least(times(x), times(y))

    both = F.aggregate(F.array_distinct(x), F.lit(0), shared)
    n = F.length(a) + F.length(b)
    return ratio(n - (F.size(x) + F.size(y) - 2 * both), n)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def close(a: Column, b: Column, threshold: float) -> Column:
    return levenshtein_similarity(a, b) >= threshold


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def title_cosine(a: Column, words_a: Column, b: Column, words_b: Column) -> Column:
    """Shared distinct words over the root of the product of the texts' lengths in characters."""
    return ratio(F.size(F.array_intersect(words_a, words_b)), F.sqrt(F.length(a).cast("double")) * F.sqrt(F.length(b).cast("double")))


def token_cosine(words_a: Column, words_b: Column) -> Column:
    """The cosine proper, of sets of words."""
    a, b = F.array_distinct(words_a), F.array_distinct(words_b)
    return ratio(F.size(F.array_intersect(a, b)), F.sqrt((F.size(a) * F.size(b)).cast("double")))


def contained_words(text: Column, words: Column) -> Column:
    """The words that are substrings of the text."""
    return F.filter(words, lambda w: F.contains(text, w))


def pairwise(x: Column, y: Column) -> Column:
    """All pairs of elements of two arrays, as structs x and y."""
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(a.alias("x"), b.alias("y")))))


def mean_levenshtein(x: Column, y: Column) -> Column:
    """Mean similarity over all pairs of words, weighted by their lengths; 0 if there is none."""
    weight = lambda p: F.length(p["x"]) + F.length(p["y"])
    pairs = pairwise(x, y)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + levenshtein_similarity(p["x"], p["y"]) * weight(p))
    return ratio(total, F.aggregate(pairs, F.lit(0), lambda acc, p: acc + weight(p)))
