"""Small look-ups over products and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pid_by_title(products: DataFrame, title: str) -> int:
    """The first product with the title; ValueError if there is none."""
    found = products.where(F.col("title") == title).agg(F.min("pid")).first()[0]
    if found is None:
        raise ValueError(f"no product has the title {title!r}")
    return found


def same_shop() -> Column:
    return F.col("shop_i") == F.col("shop_j")


def same_brand() -> Column:
    return F.col("brand_i").eqNullSafe(F.col("brand_j"))


def entry_key(entry: Column) -> Column:
    return entry["key"]


def entry_value(entry: Column) -> Column:
    return entry["value"]


def value_set(features: Column) -> Column:
    return F.array_sort(F.array_distinct(F.map_values(features)))


def least_features(a: Column, b: Column) -> Column:
    return F.least(F.size(F.map_keys(a)), F.size(F.map_keys(b)))
