"""Cleaning of attribute maps, brands and the choice of complete attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T

STRIP = ":/()[]{}"
DROPPED = ("screen size", "screen size (measured diagonally", "refresh rate", "vertical resolution")


def _get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _filled(m: Column, key: str, *others: str) -> Column:
    """The value of ``key``; if it is missing or empty, the first other one that isn't."""
    filled = [F.when(_get(m, k) != "", _get(m, k)) for k in (key, *others)]
    return F.coalesce(*filled, _get(m, key))


def once(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps the optimizer from computing the columns anew wherever a later expression refers to them."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def last_wins(entries: Column) -> Column:
    """A map of entries; a later one takes the place of an earlier one with its key."""
    none = F.create_map().cast("map<string,string>")
    return F.aggregate(entries, none, lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def normalise_map(features: Column, patterns=T.PATTERNS) -> Column:
    """Lower-cased keys without brackets at their ends, rewritten values; of colliding keys the last wins."""
    entries = F.transform(
        F.map_entries(features),
        lambda e: F.struct(F.btrim(F.lower(e["key"]), F.lit(STRIP)).alias("key"), T.rewrite(F.lower(F.coalesce(e["value"], F.lit("None"))), patterns).alias("value")),
    )
    return last_wins(entries)


def standardise(m: Column) -> Column:
    """Fills the attributes that have other names in some shops and brings their values to one form."""
    new = {
        "maximum resolution": F.regexp_replace(F.regexp_replace(_get(m, "maximum resolution"), r"(?U)[^\d\sx]", ""), r"(?U)\s*x\s*", "x"),
        "screen size class": F.regexp_replace(_filled(m, "screen size class", "screen size", "screen size (measured diagonally"), r"(\d+\.?\d*)\s*inch.*", "$1inch"),
        "screen refresh rate": F.regexp_replace(F.regexp_replace(_filled(m, "screen refresh rate", "refresh rate"), r"(\d+\.?\d*)\s*hz.*", "$1hz"), r"trumotion|clearscn|clear motion rate", ""),
        "recommended resolution": _filled(m, "recommended resolution", "vertical resolution"),
        "aspect ratio": F.regexp_replace(F.regexp_replace(_get(m, "aspect ratio"), r"\b(\d+)\s(\d+)\b", "$1i$2"), r"\s.*$", ""),
    }
    rest = F.map_filter(m, lambda k, v: ~k.isin(*DROPPED, *new))
    made = F.map_filter(F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return F.map_concat(rest, made)


def clean_features(products: DataFrame, patterns=T.PATTERNS) -> DataFrame:
    """Normalises and standardises the attribute maps."""
    normal = once(products.withColumn("features", normalise_map(F.col("features"), patterns)), "features")
    return once(normal.withColumn("features", standardise(F.col("features"))), "features")


def put(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.lit(key), value))


def brand_in_title(title: Column, brands=T.BRANDS) -> Column:
    """The first brand, in the order of the list, that is part of the title."""
    return F.coalesce(*(F.when(F.contains(title, F.lit(b)), F.lit(b)) for b in brands))


def fill_brands(products: DataFrame, brands=T.BRANDS) -> DataFrame:
    """Sets ``brand`` from the map or else from the title, and writes it into the map, a null as well."""
    found = F.coalesce(F.when(_get(F.col("features"), "brand") != "", _get(F.col("features"), "brand")), brand_in_title(F.col("title"), brands), _get(F.col("features"), "brand"))
    branded = once(products.withColumn("brand", found), "brand")
    return once(branded.withColumn("features", put(F.col("features"), "brand", F.col("brand"))), "features")


def pop_brand(products: DataFrame) -> DataFrame:
    """Baseline: moves the attribute ``Brand``, lower-cased, out of the map."""
    brand = F.lower(_get(F.col("features"), "Brand"))
    return products.withColumn("brand", brand).withColumn("features", F.map_filter("features", lambda k, v: k != "Brand"))


def brand_of(features: Column) -> Column:
    """``brand`` or, if that is missing or empty, ``brand name``."""
    return F.coalesce(F.when(_get(features, "brand") != "", _get(features, "brand")), _get(features, "brand name"))


def key_counts(products: DataFrame, weight: str | None = None) -> DataFrame:
    """(key, n, total): in how many products each attribute occurs; ``weight`` is the column of the number of products in a row."""
    each = F.col(weight) if weight else F.lit(1).cast("long")
    total = products.agg(F.coalesce(F.sum(each), F.lit(0)).alias("total"))
    counts = products.select(F.explode(F.map_keys("features")).alias("key"), each.alias("each")).groupBy("key").agg(F.sum("each").alias("n"))
    return counts.join(F.broadcast(total))  # one row


def complete_keys(products: DataFrame, threshold: float, weight: str | None = None) -> DataFrame:
    """(key, n) of attributes that at least a share ``threshold`` of the products has."""
    return key_counts(products, weight).where(F.col("n") >= F.lit(threshold) * F.col("total")).select("key", "n")


def select_features(products: DataFrame, threshold: float, weight: str | None = None) -> DataFrame:
    """Keeps complete attributes in the map and adds ``selected``, their names by falling count.

    The names are one row; it holds one entry an attribute, not a product.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "key")))
    keys = complete_keys(products, threshold, weight).agg(F.transform(order, lambda x: x["key"]).alias("selected"))
    joined = products.join(F.broadcast(keys))  # one row
    return joined.withColumn("features", F.map_filter("features", lambda k, v: F.array_contains("selected", k)))
