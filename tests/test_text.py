"""Unit vectors of the cleaning, worked out by hand, and Python's re as a cross-check of the rewrites."""

import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import features, words


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


TITLES = [
    'LG 55" Class (55.0 inches diag.) LED-LCD HDTV - Best Buy', "Samsung UN46 120 Hertz Wi-Fi", "sony  sony Bravia 3 D blu ray", "Toshiba 40.0 inch",
    "écran écran 32\" tv", "a.b .c 1.5 x.", "westinghouse jvc tv", "", "built in, internet apps",
]


@pytest.mark.parametrize("patterns", [T.PATTERNS, T.BASELINE_PATTERNS])
def test_rewrites_agree_with_re(spark, patterns):
    expected = []
    for t in TITLES:
        t = t.lower()
        for p, r in patterns:
            t = re.sub(p, r.replace("$1", r"\1"), t)
        expected.append(t)
    assert column(spark, TITLES, lambda c: T.clean_title(c, patterns)) == expected


def test_title_words(spark):
    assert column(spark, ["un46d6000 120hz led abc 55", "no words"], lambda c: F.array_join(T.title_words(c), "|")) == ["un46d6000|120hz", ""]


def test_feature_words(spark):
    assert column(spark, ["55 inch", "weight 12.5lb", "120", "12 a 7"], lambda c: F.array_join(T.feature_words(F.array(c)), "|")) == ["", "12.5lb", "120", "7"]


def test_parts_of_a_word(spark):
    assert column(spark, ["un46.5d60", "abc", "12"], lambda c: F.concat_ws("|", T.numeric_part(c), T.other_part(c))) == ["46.560|und", "|abc", "12|"]


PRODUCTS = "pid long, title string, url string, shop string, model_id string, features map<string,string>"


def test_later_of_colliding_keys_wins_and_names_are_filled(spark):
    # Built in SQL: a Python dict reaches Spark in no particular order.
    df = spark.sql("""SELECT 1L AS pid, 'x' AS title, map('Screen Size:', '40"', 'screen size', '46 "', 'Refresh Rate', '120 Hertz', 'Aspect Ratio', '16:9 wide') AS features""")
    got = features.clean_features(df).first()["features"]
    assert got == {"screen size class": "46inch", "screen refresh rate": "120hz", "aspect ratio": "16i9"}


def test_brands(spark):
    rows = [(1, "lg 55inch", "u", "s", "m", {}), (2, "plain", "u", "s", "m", {"brand": "sony"}), (3, "plain", "u", "s", "m", {}), (4, "a samsung of lg", "u", "s", "m", {"brand": ""})]
    got = {r["pid"]: (r["brand"], r["features"]["brand"]) for r in features.fill_brands(spark.createDataFrame(rows, PRODUCTS)).collect()}
    assert got == {1: ("lg", "lg"), 2: ("sony", "sony"), 3: (None, None), 4: ("lg", "lg")}


def test_model_words_keep_complete_attributes_only(spark):
    rows = [(i, f"tv{i}x", "u", "s", "m", {"a": "one 1"} | ({"b": "rare"} if i == 0 else {})) for i in range(4)]
    got = {r["pid"]: r["model_words"] for r in words.model_words(spark.createDataFrame(rows, PRODUCTS), 0.5).collect()}
    assert got[0] == "1 one tv0x" and got[3] == "1 one tv3x"


def test_empty_table(spark):
    assert words.clean_products(spark.createDataFrame([], PRODUCTS)).count() == 0
    assert words.clean_products_baseline(spark.createDataFrame([], PRODUCTS)).count() == 0
