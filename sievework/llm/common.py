"""What the operators of this subpackage share: scratch tables, words, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch. Texts may be long, so batches are short.
BATCH_ROWS = 1000
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with short Arrow batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scratch tables -------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Unset, a temporary one in local mode, where all share the machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that are still there, with their sessions: results read some of them until the driver ends.
_left: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_left() -> None:
    for path, spark in list(_left.items()):
        if spark.sparkContext._jsc is not None:  # nothing can be reached from a stopped session
            _delete(spark, path)


class Scratch:
    """Tables written to the shared folder to cut lineage and to survive lost executors.

    ``drop`` removes tables that nothing reads any more; ``close`` removes all. What
    a lazy result still reads stays until the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, drop: Iterable[DataFrame] = (), free: bool = False) -> DataFrame:
        """Writes ``df`` and reads it again; ``free`` also lets go of the shuffle files that led to it."""
        path = f"{scratch_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        _left[path] = self.spark
        for x in drop:
            self.drop(x)
        if free:
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()  # Spark's cleaner drops the files of shuffles that no object refers to
        return out

    def drop(self, df: DataFrame) -> None:
        path, _ = self.paths.pop(id(df), (None, None))
        if path:
            _delete(self.spark, path)

    def close(self) -> None:
        for _, df in list(self.paths.values()):
            self.drop(df)


# --- words ----------------------------------------------------------------


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` lower-cases A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads its input."""
    h = (h ^ (h >> _S33)) * _MIX1
    h = (h ^ (h >> _S33)) * _MIX2
    return h ^ (h >> _S33)


_ODD = np.array([xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(64)], np.uint64)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each window of ``size`` words; with fewer words, one for all of them."""
    n = len(h)
    if n == 0:
        return h
    take, width = (n - size + 1, size) if n >= size else (1, n)
    out = np.full(take, _ODD[63 - width], np.uint64)
    for i in range(width):
        out += h[i : i + take] * _ODD[i]
    return mix(out)


# --- connected components ---------------------------------------------------


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b); component is the smallest node.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes.
    Each step is one aggregate and one join on the node; links never leave the
    executors, only one number a round reaches the driver.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = scratch.save(small.select("x.*").where("u <> v").distinct(), drop=[large])
        same = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(e)
        e = new
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
