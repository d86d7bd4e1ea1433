"""Near-duplicates among embeddings by sorted projection passes.

In each pass the vectors are sorted by the concatenated signs of random
projections, and each is compared with its neighbours in a window of bounded
width. Vectors at a small angle share long prefixes in some of the passes. Pairs
that reach the threshold are united across the passes into components.

How often a vector has to be passed over follows from how crowded its place is: if
it shares at most L signs with the rows at the ends of its window, a partner that
shares L + 1 lies inside. Each pass so bounds the chance to miss a partner right at
the threshold, and vectors whose bounds do not yet multiply to MISS are passed over
again, among themselves, since a pair is found if it is for one of its ends. Where
that would take longer than comparing all that are left, they are all compared.

A window sees only part of a large group, so the links of a component are then
counted over all its pairs, by matrix products of blocks of its members; that
count is exact whatever the size of the component. Equal vectors are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.95
WINDOW = 32
BITS = 62
MISS = 0.001
PASSES_LEAST = 8
BLOCK = 1024
SEED = 11


def _agree(threshold: float) -> float:
    """Chance that a projection has the same sign for two vectors at the threshold."""
    return 1 - math.acos(threshold) / math.pi


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes until a pair at the threshold has shared a window, but for a chance of ``miss``."""
    bits = max(0.0, math.log2(max(1, n) / window))
    return max(PASSES_LEAST, math.ceil(math.log(miss) / math.log1p(-min(0.9999, _agree(threshold) ** bits))))


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it can link with nothing."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / math.sqrt(float(v @ v))


def _planes(dims: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED, dims, number)).standard_normal((dims, BITS))


def prepare(embeddings: DataFrame) -> DataFrame:
    """vec_id, key (equal for equal vectors) and unit vector as bytes of every row; both are null where the row can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [None if i is None else unit(v) for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True)]
            keys = [None if u is None else xxhash.xxh3_128_digest((np.array(v, np.float64) + 0.0).tobytes()) for u, v in zip(units, batch.column("embedding").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], ["vec_id", "key", "unit"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, key binary, unit binary")


def _keyed(numbers: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            units = [np.frombuffer(x) for x in batch.column("unit").to_pylist()]
            signs = np.zeros((len(numbers), len(units)), np.int64)
            dims = np.array([len(u) for u in units], np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([units[i] for i in at])
                for k, p in enumerate(numbers):
                    if (d, p) not in planes:
                        planes[d, p] = _planes(int(d), p)
                    signs[k, at] = (x @ planes[d, p] > 0) @ power
            for k, p in enumerate(numbers):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(units), p), pa.int32()), pa.array(dims.astype(np.int32)), pa.array(signs[k]), batch.column("rep"), batch.column("unit")],
                    ["pass", "dims", "sign", "rep", "unit"],
                )

    return run


def shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading signs that two keys of BITS signs share."""
    x = a ^ b
    high, low = np.frexp((x >> 31).astype(float))[1], np.frexp((x & (1 << 31) - 1).astype(float))[1]
    return BITS - np.where(high > 0, high + 31, low)


def _windows(threshold: float, window: int):
    """Compares each row with the ``window`` rows before it; rows come sorted, those of other passes don't count.

    Gives (a, b, null) for links and (a, null, miss) for each row, with the log of
    the chance that a partner at the threshold was missed.
    """

    def missed(parts: list[tuple], first: bool, last: bool) -> pa.RecordBatch:
        rep, sign = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = len(rep)
        side = np.full(n, -1), np.full(n, -1)  # at the end of a pass nothing is outside of the window
        if n > window:
            side[0][window:] = side[1][:-window] = shared_signs(sign[window:], sign[:-window])
        if first:  # rows of the pass may be in the partition before
            side[0][:window] = BITS
        if last:
            side[1][max(0, n - window) :] = BITS
        most = np.maximum(*side)
        found = np.where(most < BITS, np.minimum(0.9999, _agree(threshold) ** (most + 1.0)), 0.0)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(n, pa.int64()), pa.array(np.log1p(-found))], ["a", "b", "miss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, units = None, np.zeros(0, np.int64), None
        parts, first = [], True
        for batch in batches:
            kind = np.stack([batch.column("pass").to_numpy(), batch.column("dims").to_numpy()])
            rep, raw = batch.column("rep").to_numpy(), batch.column("unit").to_pylist()
            sign = batch.column("sign").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (kind[:, 1:] != kind[:, :-1]).any(0), [True]])) if len(rep) else np.zeros(1, int)
            for s, e in zip(edge, edge[1:], strict=False):
                this = tuple(kind[:, s])
                x = np.frombuffer(b"".join(raw[s:e])).reshape(e - s, -1)
                i = rep[s:e]
                if this != now and parts:
                    yield missed(parts, first, False)
                    parts, first = [], False
                parts.append((i, sign[s:e]))
                if this == now:
                    x, i = np.concatenate([units, x]), np.concatenate([ids, i])
                old = len(i) - (e - s)
                a, b = [], []
                for k in range(1, min(window, len(i) - 1) + 1):
                    lo = max(0, old - k)
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[lo : len(i) - k], x[lo + k :]) >= threshold) + lo
                    a.append(i[near])
                    b.append(i[near + k])
                if a:
                    a, b = np.concatenate(a), np.concatenate(b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.float64())], ["a", "b", "miss"])
                now, ids, units = this, i[-window:], x[-window:]
        if parts:
            yield missed(parts, first, True)

    return run


def _counted(threshold: float):
    """Links of the members of each block pair (component, x, y); rows come sorted by these."""

    def count(rows: list[tuple]) -> pa.RecordBatch:
        ids, side, times, raw = zip(*rows, strict=True)
        ids, side, times = np.array(ids), np.array(side), np.array(times)
        sizes = np.array([len(r) for r in raw])
        links = np.zeros(len(ids), np.int64)
        for size in np.unique(sizes):
            left, right = (np.flatnonzero((sizes == size) & s) for s in ((side != 1), (side != 0)))
            if not len(left) or not len(right):
                continue
            x, y = (np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1) for at in (left, right))
            near = (x @ y.T >= threshold) & (ids[left][:, None] != ids[right][None, :])
            links[left] += near @ times[right]
            if (side == 0).any() or (side == 1).any():  # two different blocks
                links[right] += near.T @ times[left]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["rep", "links"])

    return _grouped(count)


def _joined(threshold: float):
    """(a, b) that join the members of each block pair into the components of its links, b the first of a's."""

    def join(rows: list[tuple]) -> pa.RecordBatch:
        ids, _, _, raw = zip(*rows, strict=True)
        ids, sizes = np.array(ids), np.array([len(r) for r in raw])
        a, b = [], []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
            near, left = x @ x.T >= threshold, np.ones(len(at), bool)
            np.fill_diagonal(near, False)
            for start in np.flatnonzero(near.any(1)):
                todo = np.array([start]) if left[start] else []
                left[start] = False
                while len(todo):
                    todo = np.flatnonzero(near[todo].any(0) & left)
                    left[todo] = False
                    a.append(np.full(len(todo), ids[at[start]]))
                    b.append(ids[at[todo]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _grouped(join)


def _grouped(count):
    """Applies ``count`` to the rows of each block pair (component, x, y); rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for c, x, y, *row in zip(*(batch.column(n).to_pylist() for n in ("component", "x", "y", "rep", "side", "times", "unit")), strict=True):
                if (c, x, y) != now:
                    if rows:
                        yield count(rows)
                    now, rows = (c, x, y), []
                rows.append(row)
        if rows:
            yield count(rows)

    return run


def _dealt(sized: DataFrame) -> DataFrame:
    """A row (component, x, y, rep, times, unit, side) for each pair of blocks that a row of a component of ``m`` rows is in."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    dealt = sized.withColumn("slot", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select(
        "component", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"), "rep", "times", "unit",
        F.when(F.col("slot") < F.col("other"), 0).when(F.col("slot") > F.col("other"), 1).otherwise(2).alias("side"),
    )
    return dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")


def find_links(nodes: DataFrame, scratch: common.Scratch, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(a, b), a < b, that join the nodes (rep, key, unit) into the components of their links."""
    n = nodes.count()
    left, found, done = nodes.select("rep", "unit").withColumn("miss", F.lit(0.0)), [], 0
    number = passes_for(n, threshold, window)
    # Comparing all n takes n / 2 products each, a pass ``window``.
    while n > 1 and n > 2 * number * window:
        keyed = left.select("rep", "unit").mapInArrow(_keyed(range(done, done + number)), "pass int, dims int, sign long, rep long, unit binary")
        # Equal signs are dealt on by a hash, so that a hot key is no single task.
        order = ["pass", "dims", "sign", "salt", "rep"]
        ranged = keyed.withColumn("salt", F.xxhash64("rep", "pass")).repartitionByRange(*order).sortWithinPartitions(*order)
        out = scratch.save(ranged.mapInArrow(_windows(threshold, window), "a long, b long, miss double"))
        found.append(out.where("b is not null").select("a", "b"))
        rates = out.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("miss").alias("now"))
        rows = left.join(rates, "rep").withColumn("miss", F.col("miss") + F.col("now")).where(F.col("miss") > math.log(MISS))
        left = scratch.save(rows.select("rep", "unit", "miss", ((math.log(MISS) - F.col("miss")) / F.least("now", F.lit(-1e-9)) * number).alias("more")))
        done += number
        n, more = left.agg(F.count(F.lit(1)), F.percentile_approx("more", 0.9)).first()
        number = max(PASSES_LEAST, math.ceil(min(more or 0, n)))
        left = left.select("rep", "unit", "miss")
    if n > 1:
        sized = left.select("rep", "unit", F.lit(0).cast("long").alias("component"), F.lit(1).cast("long").alias("times"), F.lit(n).cast("long").alias("m"))
        found.append(_dealt(sized).mapInArrow(_joined(threshold), "a long, b long"))
    links = found[0] if found else nodes.selectExpr("rep as a", "rep as b").limit(0)
    for more in found[1:]:
        links = links.unionByName(more)
    return scratch.save(links.distinct(), free=True)


def dedup(embeddings: DataFrame, scratch: common.Scratch | None = None, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do rows without vec_id, whose component is null. Vectors of
    different lengths don't link. Equal vectors link. Rows that share a vec_id but
    not their vector are vectors of their own, each with its own links. Extra
    columns are not read; an empty table gives an empty result.
    """
    spark = common.session(embeddings)
    scratch = scratch or common.Scratch(spark)
    prepared = scratch.save(prepare(embeddings))
    used = prepared.where("key is not null")
    # Equal vectors are one node, named by the smallest vec_id; where a vec_id has several vectors, a hash names the others.
    same = used.groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("least").orderBy("key"))
    same = scratch.save(same.select("key", "least", "times", F.when(place == 1, F.col("least")).otherwise(F.xxhash64("key")).alias("rep")))
    nodes = used.join(same.select("key", F.col("least").alias("vec_id"), "rep"), ["key", "vec_id"]).dropDuplicates(["key"])
    nodes = scratch.save(nodes.select("rep", "key", "unit"))
    links = find_links(nodes, scratch, threshold, window)
    found = scratch.save(common.components(links, scratch).toDF("rep", "component"))
    members = found.unionByName(found.select(F.col("component").alias("rep"), "component").distinct())
    sized = members.join(members.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component")
    sized = sized.join(nodes, "rep").join(same.select("key", "times"), "key")
    counted = _dealt(sized).mapInArrow(_counted(threshold), "rep long, links long")
    n_links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    named = members.join(same.select("rep", "least"), "rep")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("rep", "smallest")
    per_key = same.join(n_links, "rep", "left").join(named, "rep", "left")
    per_key = per_key.select("key", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "least").alias("component"))
    out = prepared.select("vec_id", "key").join(per_key, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
