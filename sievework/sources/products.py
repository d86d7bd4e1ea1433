"""Readers of product records, and adapters that make products of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import store

RECORD = T.StructType(
    [
        T.StructField("modelID", T.StringType()), T.StructField("shop", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()), T.StructField("featuresMap", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Products of JSON objects {key: [product, ...], ...}, one a file; the keys are dropped, pid follows the content.

    pid is dense from 0 in order of (modelID, shop, title, url). Rows are counted
    within ranges of that order, and the ranges by their sizes, one row each.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(RECORD))).alias("m"))
    order = ["modelID", "shop", "title", "url"]
    ranged = flatten(parsed, "m").repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the partition above 33 bits of the row in it
    placed = store.written(ranged.select("*", F.shiftright(number, 33).alias("range"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rows = placed.join(F.broadcast(before), "range")  # one row a partition
    return rows.select((F.col("before") + F.col("place")).alias("pid"), F.col("modelID").alias("model_id"), "shop", "title", "url", F.col("featuresMap").alias("features"))


def flatten(df: DataFrame, column: str) -> DataFrame:
    """A row for each element of the lists of a map."""
    return df.select(F.explode(F.flatten(F.map_values(column))).alias("r")).select("r.*")


# The same definitions serve the queries and the SQL that they are held against.
MAKER = "case p_size % 8 when 0 then 'LG' when 1 then 'Samsung' when 2 then 'Sony' when 3 then 'Philips' when 4 then 'Toshiba' when 5 then 'JVC' when 6 then 'Westinghouse' else 'Noname' end"
OFFER = {
    "pid": "p_partkey",
    "model_id": "concat(p_name, '|', p_brand)",
    "shop": "concat('shop', p_partkey % 7)",
    "url": "concat('http://shop.example/', p_partkey)",
    "title": f"""case p_partkey % 4
        when 0 then concat({MAKER}, ' ', p_name, ' ', p_size, '" ', p_type, ' HDTV')
        when 1 then concat(p_name, ' - ', {MAKER}, ' ', p_size, '.0 Inch (', p_type, ') Wi-Fi')
        when 2 then concat({MAKER}, ' ', {MAKER}, ' ', p_name, ' ', p_size, '-inches ', p_type, ', Smart TV 120Hertz')
        else concat(p_name, ' ', p_type, ' ', p_size, '.5inch & 60 hz Blu-ray. Class') end""",
}
FEATURES = (
    ("Brand:", f"case when p_partkey % 5 = 0 then null else {MAKER} end"),
    ("Screen Size", "concat(p_size, '\"')"),
    ("(Refresh Rate)", "case when p_partkey % 3 = 0 then null else '120 Hertz' end"),
    ("Type", "p_type"),
    ("Aspect Ratio", "'16:9 wide'"),
    ("Vertical Resolution", "case when p_partkey % 2 = 0 then null else '1080p' end"),
    ("Maximum Resolution", "concat(p_size * 40, ' X 1080 (native)')"),
    ("Brand", f"case when p_partkey % 11 = 0 then concat({MAKER}, ' tv') else null end"),
)


def offers(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Products made of the whole ``part`` table; attributes with a null value are left out of the map. ``spread``: deal the rows of few large files to all tasks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part = part.repartition("p_partkey") if spread else part
    entries = ", ".join(f"""struct('{k}' as key, {v} as value)""" for k, v in FEATURES)
    return part.select(*(F.expr(f"cast({e} as {'long' if c == 'pid' else 'string'})").alias(c) for c, e in OFFER.items()), F.expr(f"map_from_entries(filter(array({entries}), e -> e.value is not null))").alias("features"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products made of the whole ``documents`` table: words are those of the whole text."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(
        F.col("doc_id").alias("pid"), F.md5("text").alias("model_id"), F.col("source").alias("shop"), F.col("lang").alias("brand"),
        F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))).alias("words"),
    )
