"""MinHash signatures and banded locality-sensitive hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

PRIME = 2147483647
#: Words of the products that a task hashes at once and hash values that it holds, which fit a CPU's cache; members of a bucket that meet in one place.
WORDS_AT_ONCE, VALUES_AT_ONCE, BLOCK = 4096, 1 << 16, 4096


def coefficients(number: int, seed: int = 42) -> list[tuple[int, int]]:
    """(a, c) of the hash family x -> (a x + c) mod PRIME."""
    draw = lambda k, s: int(hashlib.md5(f"{s}-{seed}-{k}".encode()).hexdigest()[:7], 16)
    return [(draw(k, "a") + 1, draw(k, "c")) for k in range(number)]


def word_id(word: Column) -> Column:
    """28 bits of the word's digest."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long")


def vocabulary(products: DataFrame) -> DataFrame:
    return products.select(F.explode("words").alias("word")).distinct()


def term_presence(products: DataFrame, containment: str = "substring") -> DataFrame:
    """(pid, word): the words of the vocabulary that a product has.

    ``substring`` looks for each word inside the joined model words, ``token``
    takes the product's own words. No word holds a blank, so one lies inside the
    joined words if it lies inside one of them; the parts of each distinct word
    meet the vocabulary in an equi-join.
    """
    own = products.select("pid", F.explode("words").alias("word"))
    if containment == "token":
        return own
    words = vocabulary(products)
    cut = "flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, length(word) - i + 1), n -> substring(word, i, n))))"
    inside = words.where("word <> ''").select(F.col("word").alias("whole"), F.explode(F.array_distinct(F.expr(cut))).alias("word")).join(words, "word")
    return own.withColumnRenamed("word", "whole").join(inside, "whole").select("pid", "word").distinct()


def minima(at: np.ndarray, every: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The minima, a row a product: its words are those of ``every`` from at[k] to at[k + 1]; ``a``, ``c``: columns of the hash family.

    Numpy products of words with hash functions, by pieces of VALUES_AT_ONCE or of one function's words.
    """
    out = np.zeros((len(at) - 1, len(a)), np.int64)
    k = 0
    while k < len(out):  # as many products as have about WORDS_AT_ONCE words
        end = max(k + 1, int(np.searchsorted(at, at[k] + WORDS_AT_ONCE, side="right")) - 1)
        some = np.flatnonzero(at[k + 1 : end + 1] > at[k:end])
        if len(some):
            ids, starts = every[at[k] : at[end]], at[k:end][some] - at[k]
            step = max(1, VALUES_AT_ONCE // len(ids))
            for h in range(0, len(a), step):
                x = a[h : h + step] * ids
                x += c[h : h + step]  # below 2^57; 2^31 leaves 1, so halves add up
                x = (x & PRIME) + (x >> 31)
                x = np.minimum(x.view(np.uint64), (x - PRIME).view(np.uint64))  # a negative one is large without its sign
                out[k + some, h : h + step] = np.minimum.reduceat(x, starts, axis=1).T
        k = end
    return out


def signatures(products: DataFrame, number: int, seed: int = 42) -> DataFrame:
    """pid and ``signature``, an array of minima; 0 throughout for a product without words. No shuffle."""
    ids = products.select("pid", F.transform("words", word_id).alias("ids"))
    a, c = (np.array(x, np.int64)[:, None] for x in zip(*coefficients(number, seed), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            out = minima(np.array(column.offsets, np.int64), column.values.to_numpy(zero_copy_only=False), a, c)
            signature = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * number), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("pid"), signature], ["pid", "signature"])

    schema = T.StructType([ids.schema["pid"], T.StructField("signature", T.ArrayType(T.LongType()))])
    return ids.mapInArrow(run, schema)


def bands(signed: DataFrame, number: int, rows: int, empty: str = "bucket") -> DataFrame:
    """(pid, band, bucket); the last band takes what is left. ``empty``: whether products without words share buckets or have none."""
    if empty == "drop":
        signed = signed.where(F.array_max("signature") > 0)
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(number - 1)),
        lambda b: F.struct(b.alias("band"), F.unhex(F.md5(F.array_join(F.slice("signature", b * rows + 1, F.when(b == number - 1, F.size("signature")).otherwise(F.lit(rows))), ","))).alias("bucket")),
    )
    return signed.select("pid", F.explode(parts).alias("b")).select("pid", "b.band", "b.bucket")


def candidates(banded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (i, j), i < j, that share a bucket; ``banded`` is read several times.

    Buckets of one product are dropped before the join. Those of more than BLOCK
    are dealt to slots, and each pair of slots meets by itself, so no task gets
    all pairs of a hot bucket.
    """
    keys = [*by, "band", "bucket"]
    shared = banded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = banded.join(shared, keys).withColumn("slots", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("pid"), "slots").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rows = rows.select(*keys, "pid", "slot", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"))
    a, b = rows.select(*keys, "x", "y", F.col("pid").alias("i"), F.col("slot").alias("slot_i")), rows.select(*keys, "x", "y", F.col("pid").alias("j"), F.col("slot").alias("slot_j"))
    return a.join(b, [*keys, "x", "y"]).where("i < j and (x = y or slot_i <> slot_j)").select(*by, "i", "j").distinct()


def candidate_pairs(products: DataFrame, number: int, rows: int, seed: int = 42, empty: str = "bucket") -> DataFrame:
    return candidates(store.written(bands(signatures(products, number * rows, seed), number, rows, empty)))


def true_pairs(products: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (i, j), i < j, with the same model_id."""
    rows = products.where("model_id is not null").select(*by, "pid", "model_id")
    keys = [*by, "model_id"]
    return rows.withColumnRenamed("pid", "i").join(rows.withColumnRenamed("pid", "j"), keys).where("i < j").select(*by, "i", "j")


def similarity_threshold(number: int, rows: int) -> float:
    return (1.0 / number) ** (1.0 / rows)
