"""How many pairs of weighted samples share a bucket, counted without a row a pair.

Draws with replacement, copies and coarse bands make pairs that no disk holds, while
an evaluation takes their numbers alone. Products of equal signatures share all
buckets, so they count as one content with a weight for each sample. Contents lie
in blocks; two blocks meet in one place, where a row of bits tells for each content
of the one with which of the other it shares a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lsh, store

#: Bytes of signatures in a block, the least number of blocks, contents whose bits are held at once, and index entries that are expanded at once.
BLOCK_BYTES, LEAST_BLOCKS, AT_ONCE, EXPANDED = 16 << 20, 8, 64, 1 << 21
#: A bucket with a larger share of the contents of a block than 1 / HOT has a row of bits of its own, so a band has at most HOT of them.
HOT = 256


def bucket_codes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit hashes of the buckets, a row a band; of 10^11 pairs in 51 bands fewer than one in a million runs has a collision."""
    out = np.zeros((bands, len(signatures)), np.uint64)
    for k in range(rows):
        out += signatures[:, k : bands * rows : rows].T.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            out ^= out >> np.uint64(shift)
            out *= np.uint64(factor)
        out ^= out >> np.uint64(31)
    return out


def shared_weight(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, same: bool) -> np.ndarray:
    """For each sample the sum of the products of weights over pairs of contents that share a bucket.

    ``x``, ``y``: codes of two blocks, a row a band; ``wx``, ``wy``: weights, a row a sample. ``same``: one
    block with itself, of which each pair of different contents counts once.
    """
    bands, n, m = len(x), x.shape[1], y.shape[1]
    width = -(-m // 64)
    one, low = np.uint64(1), np.uint64(63)
    orders = np.argsort(y, axis=1, kind="stable").astype(np.int32)
    first, size, hot = np.empty((bands, n), np.int32), np.empty((bands, n), np.int32), np.zeros((bands, n), np.int32)
    tables = [np.zeros((1, width), np.uint64)]
    least, made = max(2, m // HOT), 1
    for b in range(bands):
        ordered = y[b, orders[b]]
        first[b] = np.searchsorted(ordered, x[b])
        size[b] = np.searchsorted(ordered, x[b], side="right") - first[b]
        starts = np.unique(first[b][size[b] > least])
        if len(starts):
            table = np.zeros((len(starts), m), bool)
            ends = np.searchsorted(ordered, ordered[starts], side="right")
            for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
                table[k, orders[b, start:end]] = True
            packed = np.zeros((len(starts), width * 8), np.uint8)
            packed[:, : -(-m // 8)] = np.packbits(table, axis=1, bitorder="little")
            tables.append(packed.view(np.uint64))
            large = size[b] > least
            hot[b, large] = made + np.searchsorted(starts, first[b, large])
            size[b, large] = 0
            made += len(starts)
    table = np.concatenate(tables)
    hot, first, size = (np.ascontiguousarray(v.T) for v in (hot, first, size))
    planes = []
    for s, w in enumerate(wy):
        for k in range(int(w.max(initial=0)).bit_length()):
            bits = np.zeros(width * 8, np.uint8)
            bits[: -(-m // 8)] = np.packbits(w >> k & 1 == 1, bitorder="little")
            planes.append((s, k, bits.view(np.uint64)))
    total = np.zeros(len(wy), np.int64)
    for at in range(0, n, AT_ONCE):
        end = min(n, at + AT_ONCE)
        met = np.zeros((end - at, width), np.uint64)
        for r in np.flatnonzero(hot[at:end].any(1)):
            own = hot[at + r]
            np.bitwise_or.reduce(table[own[own > 0]], axis=0, out=met[r])
        row, band = np.nonzero(size[at:end])
        length = size[at + row, band].astype(np.int64)
        cuts = np.searchsorted(np.cumsum(length), np.arange(EXPANDED, int(length.sum()) + EXPANDED, EXPANDED), side="right")
        for k0, k1 in zip([0, *cuts], [*cuts, len(row)], strict=True):
            if k0 < k1:
                some = length[k0:k1]
                place = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some - first[at + row[k0:k1], band[k0:k1]], some)
                member = orders[np.repeat(band[k0:k1], some), place]
                np.bitwise_or.at(met.reshape(-1), np.repeat(row[k0:k1], some) * width + (member >> 6), one << (member.astype(np.uint64) & low))
        if same:
            own = np.arange(at, end)
            met[own - at, own >> 6] &= ~(one << (own.astype(np.uint64) & low))
        some = np.flatnonzero(met.any(1))
        if len(some):
            met = met[some]
            for s, k, plane in planes:
                total[s] += int((np.bitwise_count(met & plane).sum(1, dtype=np.int64) * wx[s, at + some]).sum()) << k
    return total // 2 if same else total


def signed(products: DataFrame, grid, seed: int = 42) -> DataFrame:
    """pid, model_id, ``signature`` as binary 32-bit integers (minima are below 2^31) and ``key``, a digest of it; written once. ``products``: pid, model_id, words."""
    made = lsh.signatures(products.select(F.struct("pid", "model_id").alias("pid"), "words"), max(b * r for b, r in grid), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("signature")
            rows = column.flatten().to_numpy().astype(np.int32).reshape(len(column), -1)
            yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array([x.tobytes() for x in rows], pa.binary())], ["pid", "signature"])

    rows = made.mapInArrow(run, T.StructType([made.schema["pid"], T.StructField("signature", T.BinaryType())]))
    return store.written(rows.select("pid.*", "signature", F.unhex(F.md5("signature")).alias("key")))


def _blocks(contents: DataFrame, boots: int) -> DataFrame:
    """(block, signatures, weights) of the contents, one row a partition; equal keys, which lie in one, count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, tuple[bytes, list[int]]] = {}
        for batch in batches:
            for key, *content in zip(*(batch.column(c).to_pylist() for c in ("key", "signature", "n")), strict=True):
                found.setdefault(key, content)
        if found:
            weights = np.array([n for _, n in found.values()], np.int64).reshape(-1, boots)
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"".join(x for x, _ in found.values()), weights.tobytes()))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "signatures", "weights"])

    return contents.mapInArrow(run, "block int, signatures binary, weights binary")


def counts(products: DataFrame, samples: DataFrame, grid) -> DataFrame:
    """(boot_id, n, bands, rows, found, tp, true): the sample's size, its pairs that share a bucket, those of one model among them, and all pairs of one model.

    ``products``: as by ``signed``; ``samples``: boot_id, model_id, key, a row a draw.
    """
    spark = products.sparkSession
    drawn = store.written(samples.groupBy("boot_id", "key", "model_id").agg(F.count(F.lit(1)).alias("n")))
    boots = [r[0] for r in drawn.select("boot_id").distinct().orderBy("boot_id").collect()]  # one row a sample
    schema = "boot_id long, n long, bands int, rows int, found long, tp long, true long"
    if not boots:
        return spark.createDataFrame([], schema)
    width = max(b * r for b, r in grid)

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("n")[k]) for k in range(len(boots)))).alias("n"))

    held = drawn.groupBy("key", "model_id").agg(F.array(*(F.sum(F.when(F.col("boot_id") == b, F.col("n")).otherwise(0)) for b in boots)).alias("n"))
    held = store.written(held)
    contents = store.written(summed(held, "key"))
    blocks = max(LEAST_BLOCKS, -(-contents.count() * width * 4 // BLOCK_BYTES))
    dealt = products.select("key", "signature").repartition(blocks, "key").join(contents, "key")
    placed = store.written(_blocks(dealt, len(boots)))

    def pairs(rows: DataFrame) -> list[int]:
        """Pairs within each row, by sample."""
        return list(rows.agg(*(F.coalesce(F.sum(F.expr(f"n[{k}] * (n[{k}] - 1) div 2")), F.lit(0)) for k in range(len(boots)))).first())

    sizes = contents.agg(*(F.sum(F.col("n")[k]) for k in range(len(boots)))).first()
    labelled = held.where("model_id is not null")
    true, within, within_true = pairs(summed(labelled, "model_id")), pairs(contents), pairs(labelled)

    def rows_of(totals: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array([list(n) for n in totals], pa.list_(pa.int64()))], ["g", "n"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(f"signatures_{s}")[k].as_buffer(), np.int32).reshape(-1, width) for s in "xy")
                wx, wy = (np.ascontiguousarray(np.frombuffer(batch.column(f"weights_{s}")[k].as_buffer(), np.int64).reshape(-1, len(boots)).T) for s in "xy")
                same = batch.column("x")[k] == batch.column("y")[k]
                yield rows_of([shared_weight(bucket_codes(x, *g), wx, bucket_codes(y, *g), wy, same) for g in grid])

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(f"signature_{s}").to_pylist()), np.int32).reshape(-1, width) for s in "xy")
            w = (batch.column("n_x").flatten().to_numpy() * batch.column("n_y").flatten().to_numpy()).reshape(-1, len(boots))
            yield rows_of([w[(bucket_codes(x, *g) == bucket_codes(y, *g)).any(0)].sum(0) for g in grid])

    def by_grid(rows: DataFrame) -> dict[int, list[int]]:
        return {r["g"]: r["n"] for r in summed(rows, "g").collect()}  # one row a configuration

    a, b = (placed.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("signatures", "weights"))) for s in "xy")
    # Blocks meet as partitions of a Cartesian product, which writes nothing.
    found = by_grid(a.hint("shuffle_replicate_nl").join(b, F.col("x") <= F.col("y")).mapInArrow(met, "g int, n array<long>"))
    several = labelled.groupBy("model_id").agg(F.count(F.lit(1)).alias("several")).where("several > 1").select("model_id")
    several = store.written(labelled.join(several, "model_id", "left_semi"))
    own = products.select("key", "signature").join(several.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    told = store.written(several.join(own, "key"))
    a, b = (told.select("model_id", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "signature", "n"))) for s in "xy")
    hits = by_grid(a.join(b, "model_id").where("key_x < key_y").select("signature_x", "signature_y", "n_x", "n_y").mapInArrow(agreed, "g int, n array<long>"))
    none = [0] * len(boots)
    rows = [
        (boot, sizes[k], bands, r, within[k] + found.get(g, none)[k], within_true[k] + hits.get(g, none)[k], true[k])
        for k, boot in enumerate(boots) for g, (bands, r) in enumerate(grid)
    ]
    return spark.createDataFrame(rows, schema)
