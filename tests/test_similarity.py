import pytest
from pyspark.sql import functions as F

from sievework.functions import similarity as S
from sievework.functions import text as T


def one(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("abcd", "abcd", 1.0), ("abcd", "bcde", (8 - 2) / 8), ("ab", "xy", 1.0), ("", "", 0.0), (None, "abc", 0.0),
        ("aaaa", "aaa", (7 - 1) / 7), ("a  b c", "a b c", 1.0 * (6 + 5) / 11),
    ],
)
def test_qgram(spark, a, b, expected):
    assert one(spark, a, b, S.qgram_similarity) == pytest.approx(expected)


@pytest.mark.parametrize("a, b, expected", [("kitten", "sitting", 1 - 3 / 7), ("", "", 1.0), ("", "ab", 0.0), ("é", "e", 0.0)])
def test_levenshtein(spark, a, b, expected):
    assert one(spark, a, b, S.levenshtein_similarity) == pytest.approx(expected)


def test_word_sets(spark):
    assert one(spark, "a b c", "b c d", lambda a, b: S.jaccard(T.tokens(a), T.tokens(b))) == pytest.approx(0.5)
    assert one(spark, "", "", lambda a, b: S.jaccard(T.tokens(a), T.tokens(b))) == 0
    assert one(spark, "a b", "a c", lambda a, b: S.title_cosine(a, T.tokens(a), b, T.tokens(b))) == pytest.approx(1 / 3)
    assert one(spark, "a b", "a c", lambda a, b: S.token_cosine(T.tokens(a), T.tokens(b))) == pytest.approx(0.5)
    assert one(spark, "ab x", "ab", lambda a, b: S.mean_levenshtein(T.tokens(a), T.tokens(b))) == pytest.approx(4 / 7)
    assert one(spark, "", "ab", lambda a, b: S.mean_levenshtein(T.tokens(a), T.tokens(b))) == 0
