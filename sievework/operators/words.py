"""Model words: the words that identify a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T

from . import features


def model_words(products: DataFrame, threshold: float = 0.5, null_token: str = "None", weight: str | None = None) -> DataFrame:
    """Adds model_words (a string) and words (an array): mixed runs of the title and values of complete attributes."""
    chosen = features.select_features(products, threshold, weight)
    values = F.transform("selected", lambda k: F.when(F.map_contains_key("features", k), F.coalesce(F.try_element_at("features", k), F.lit(null_token))).otherwise(""))
    joined = F.concat_ws(" ", F.array_join(T.title_words(F.col("title")), " "), F.array_join(values, " "))
    return _with_words(chosen.withColumn("joined", joined)).drop("selected")


def model_words_baseline(products: DataFrame) -> DataFrame:
    """Baseline: mixed runs of the title and the numbers at the ends of attribute values."""
    joined = F.concat_ws(" ", F.array_join(T.title_words(F.col("title")), " "), F.array_join(T.feature_words(F.map_values("features")), " "))
    return _with_words(products.withColumn("joined", joined))


def _with_words(products: DataFrame) -> DataFrame:
    words = features.once(products.withColumn("words", T.unique_sorted(T.tokens(F.col("joined")))), "words")
    return words.withColumn("model_words", F.array_join("words", " ")).drop("joined")


def clean_products(products: DataFrame, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """The whole improved cleaning: title, attributes, brand, model words. ``weight``: the column of the number of products in a row."""
    titled = features.once(products.drop("url").withColumn("title", T.clean_title(F.col("title"))), "title")
    return model_words(features.fill_brands(features.clean_features(titled)), threshold, weight=weight)


def clean_products_baseline(products: DataFrame) -> DataFrame:
    """The baseline cleaning, which is local to a row."""
    cleaned = features.once(products.drop("url").withColumn("title", T.clean_title_baseline(F.col("title"))), "title")
    return model_words_baseline(features.pop_brand(cleaned))
