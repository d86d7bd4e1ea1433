"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct five-word shingles. Shingles are hashed
into groups; the counts of the groups are the document's point. The overlap of
two documents is at most the sum of the coordinate minima of their points, and
in an R-tree at most the sum of the minima of a point and the upper corner of a
node's box, so whole nodes are skipped.

One tree over all points would be read almost whole by every query, since boxes
of many points are loose in every coordinate, so the space is tiled first. Two
sets with a Jaccard similarity of 0.75 or more share one of the first
floor(n / 4) + 1 shingles of each in any order common to all documents; the
order here is by hash, with shingles of heavy groups last. A tile holds the
documents with one such shingle in common. In a hash order the k-th prefix
element misses with the share of the union that is not in the intersection, at
most 1/4, so 25 elements suffice up to a chance of 1e-15 a pair, which is below
that of a collision of the 64-bit hashes; where heavy shingles stand in the way
the prefix is longer, up to the exact length.

Documents with equal sets are one node. First, in STAR_ROUNDS rounds, each member
of a tile is compared with one member alone, which is linear in the tile. After
them, tiles whose members are still in different components are joined by
R-tree; tiles beyond BLOCK members are split into blocks, and a pair comes from
the smallest tile that it shares. Only counts, never links, reach the driver.
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

WORDS, PERCENT = 5, 75
#: Coarse groups by which heavy shingles are told; a group is heavy from HEAVY times the mean on.
COARSE_BITS, HEAVY, HEAVY_LEAST, LOCAL_LEAST = 20, 16, 64, 8
#: ln of the chance that a shortened prefix misses a link.
MISS = math.log(1e-15)
#: Dimensions of a point: a power of two of two to four times the set's size; boxes use FOLD times fewer.
DIMS_LEAST, DIMS_MOST, FOLD = 64, 1 << 17, 8
LEAF, BLOCK = 16, 4096
#: Rounds in which the members of a tile are compared with one member only.
STAR_ROUNDS = 3


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; none for a text without words."""
    return np.unique(common.window_hashes(common.word_hashes(common.words_of(text, lower=True)), words))


def links(overlap: int, a: int, b: int, percent: int = PERCENT) -> bool:
    """Whether sets of a and b elements with so many in common are similar enough."""
    return 100 * overlap >= percent * (a + b - overlap)


def dims_of(n: int) -> int:
    return min(DIMS_MOST, max(DIMS_LEAST, 1 << (2 * n - 1).bit_length()))


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts of the hash groups: the low bits of a hash are its group. One byte a count where that holds them."""
    dims = dims_of(len(hashes))
    counts = np.bincount((hashes & np.uint64(dims - 1)).astype(np.int64), minlength=dims)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4")


def fold(p: np.ndarray, dims: int) -> np.ndarray:
    """The point in fewer dimensions, a power of two."""
    return p.reshape(-1, dims).sum(0, dtype=np.int64)


def prefix(hashes: np.ndarray, heavy: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles that a document's tiles come from; ``heavy`` is a bit map of coarse groups."""
    n = len(hashes)
    if n == 0:
        return hashes
    coarse = (hashes >> np.uint64(64 - COARSE_BITS)).astype(np.int64)
    is_heavy = (heavy[coarse >> 3] >> (coarse & 7).astype(np.uint8)) & 1 == 1
    h = int(is_heavy.sum())
    exact = n - -(-percent * n // 100) + 1
    # At most a share 1 - t of the union and so n (1 - t) / t elements differ; none of them need be heavy.
    t = percent / 100
    miss = 1 - t if h == 0 else n * (1 - t) / t / max(n - h, 1e-9)
    size = min(exact, math.ceil(MISS / math.log(miss))) if miss < 0.95 else exact
    return np.concatenate([hashes[~is_heavy], hashes[is_heavy]])[:size]


def _coarse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COARSE_BITS, np.int64)
    for batch in batches:
        got = [shingles(t) >> np.uint64(64 - COARSE_BITS) for t in batch.column("text").to_pylist()]
        if got:
            total += np.bincount(np.concatenate(got).astype(np.int64), minlength=len(total))
    # A group that is heavy over all is above the mean in most tasks; the others need not be sent. A heavy group
    # that is missed only makes tiles larger, since any order of the shingles finds all links.
    at = np.flatnonzero(total >= max(LOCAL_LEAST, 4 * total.mean()))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["coarse", "n"])


def heavy_groups(documents: DataFrame) -> np.ndarray:
    """Bit map of the heavy coarse groups, 2^COARSE_BITS / 8 bytes whatever the input."""
    counts = documents.select(F.col("text").cast("string")).mapInArrow(_coarse_counts, "coarse long, n long").groupBy("coarse").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    rows = counts.join(F.broadcast(total)).where(f"n >= greatest({HEAVY_LEAST}, {HEAVY} * t / {1 << COARSE_BITS})").select("coarse").toArrow()
    bits = np.zeros(1 << COARSE_BITS, bool)
    bits[rows.column("coarse").to_numpy()] = True
    return np.packbits(bits, bitorder="little")


PREPARED = "doc_id long, tid long, n long, key binary, tokens array<long>"
NODES = "rep long, n long, tokens array<long>, point binary"


def prepare(documents: DataFrame, heavy: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tid"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([prefix(s, heavy).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "tid", "n", "key", "tokens"],
            )

    return documents.select("doc_id", "tid", "text").mapInArrow(run, PREPARED)


def nodes(texts: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Size, prefix and point of the nodes that share a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([prefix(s, heavy).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([point(s).tobytes() for s in sets], pa.binary()),
                ],
                ["rep", "n", "tokens", "point"],
            )

    return texts.mapInArrow(run, NODES)


def _read_point(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == dims_of(n) else "<u4")


def overlap_bound(p: np.ndarray, q: np.ndarray) -> int:
    """The sum of the coordinate minima, in the dimensions of the smaller point."""
    dims = min(len(p), len(q))
    p, q = (x if len(x) == dims else fold(x, dims) for x in (p, q))
    return int(np.minimum(p, q).sum(dtype=np.int64))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose summed coordinate minima allow a link."""
    for batch in batches:
        keep = []
        for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("point_a", "point_b", "n_a", "n_b")), strict=True):
            keep.append(links(overlap_bound(_read_point(a, n), _read_point(b, m)), n, m))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose texts are similar enough. Rows come sorted by a, whose set is kept."""
    last, mine = None, None
    for batch in batches:
        keep = []
        for a, t, u in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if a != last:
                last, mine = a, shingles(t)
            other = shingles(u)
            keep.append(links(len(np.intersect1d(mine, other, assume_unique=True)), len(mine), len(other)))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])


class RTree:
    """Points packed into leaves of LEAF, in order of set size and then of folded coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        tall = max(1, math.isqrt(max(1, len(points) // LEAF)))
        order = np.argsort(sizes, kind="stable")
        lead = points.reshape(len(points), min(4, points.shape[1]), -1).sum(2)
        slabs = [s[np.lexsort(lead[s].T)] for s in np.array_split(order, tall)]
        self.order = np.concatenate(slabs)
        self.points, self.sizes = points[self.order], sizes[self.order]
        cut = np.arange(0, len(points), LEAF)
        self.cut = np.append(cut, len(points))
        self.high = np.maximum.reduceat(self.points, cut, axis=0)
        self.low_size = np.minimum.reduceat(self.sizes, cut)
        self.high_size = np.maximum.reduceat(self.sizes, cut)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays (i, j), of pairs that the bound leaves; every unordered pair at most once."""
        for k in range(len(self.cut) - 1):
            own = slice(self.cut[k], self.cut[k + 1])
            # Box against box, from this one on.
            bound = np.minimum(self.high[k], self.high[k:]).sum(1)
            fits = np.flatnonzero(_may_link(bound, self.low_size[k], self.low_size[k:]) & (100 * self.high_size[k:] >= PERCENT * self.low_size[k]) & (100 * self.high_size[k] >= PERCENT * self.low_size[k:])) + k
            for j in fits:
                other = slice(self.cut[j], self.cut[j + 1])
                over = np.minimum(self.points[own, None, :], self.points[None, other, :]).sum(2)
                x, y = np.nonzero(_may_link(over, self.sizes[own, None], self.sizes[None, other]))
                x, y = x + self.cut[k], y + self.cut[j]
                keep = x < y
                yield self.order[x[keep]], self.order[y[keep]]


def _may_link(overlap, a, b):
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def _tile_pairs(tile: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile block that may link, are in different components and share no smaller tile."""
    ids, comps, sizes, raw, tokens = zip(*rows, strict=True)
    points = [_read_point(p, n) for p, n in zip(raw, sizes, strict=True)]
    smaller = [frozenset(t for t in x if t < tile) for x in tokens]
    ids, comps, sizes = np.array(ids), np.array(comps), np.array(sizes)
    out = []
    # Sets of similar size have points of the same or the neighbouring number of dimensions.
    dims = np.array([dims_of(n) for n in sizes.tolist()])
    for d in np.unique(dims):
        for lower in (d, d // 2) if d > DIMS_LEAST else (d,):
            at = np.flatnonzero((dims == d) | (dims == lower))
            if len(at) < 2 or (lower != d and not (dims[at] == lower).any()) or comps[at].min() == comps[at].max():
                continue
            tree = RTree(np.stack([fold(points[i], max(16, int(lower) // FOLD)) for i in at]), sizes[at])
            for i, j in tree.pairs():
                i, j = at[i], at[j]
                keep = comps[i] != comps[j]
                if lower != d:
                    keep &= dims[i] != dims[j]
                for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                    if smaller[x].isdisjoint(smaller[y]) and links(overlap_bound(points[x], points[y]), sizes[x], sizes[y]):
                        out.append((ids[x], ids[y]) if ids[x] < ids[y] else (ids[y], ids[x]))
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and block; each block is joined when its last row has come."""
    now, rows = None, []

    def flush():
        a, b = _tile_pairs(now[0], rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for t, k, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "block", "rep", "comp", "n", "point", "tokens")), strict=True):
            if (t, k) != now:
                if len(rows) > 1:
                    yield flush()
                now, rows = (t, k), []
            rows.append(row)
    if len(rows) > 1:
        yield flush()


def _check(pairs: DataFrame, reps: DataFrame, texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The pairs (a, b) that really link: first by their points, then by their whole texts."""
    one = reps.select("rep", "n", "point")
    near = pairs.join(one.toDF("a", "n_a", "point_a"), "a").join(one.toDF("b", "n_b", "point_b"), "b")
    near = scratch.save(near.where(f"100 * n_a >= {PERCENT} * n_b and 100 * n_b >= {PERCENT} * n_a").mapInArrow(_bounded, "a long, b long"))
    full = near.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return scratch.save(full.sortWithinPartitions("a").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), drop=[near], free=True)


def join(documents: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows without words (null or empty texts) have no shingles and are their own
    component, as is a row with a null doc_id, whose component is null. Equal
    texts, also of repeated rows, are linked. Rows that share a doc_id but not
    their text are documents of their own, each with its own links. An empty table
    gives an empty result; extra columns are not read.
    """
    return classes(documents, scratch).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and tid, which tells texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))


def classes(documents: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, tid, n, component_id and class of every row; rows of one class are linked, and component_id is its smallest doc_id.

    ``class`` is null for rows without words or doc_id.
    """
    spark = common.session(documents)
    scratch = scratch or common.Scratch(spark)
    docs = _keyed(documents)
    heavy = heavy_groups(docs)
    prepared = scratch.save(prepare(docs, heavy))
    used = prepared.where("n > 0 and doc_id is not null")
    # Equal sets are one node, named by its smallest document; where a doc_id has several sets, a hash names the others.
    same = used.groupBy("key").agg(F.min(F.struct("doc_id", "tid")).alias("first")).select("key", F.col("first.doc_id").alias("least"), F.col("first.tid").alias("tid"))
    place = F.row_number().over(Window.partitionBy("least").orderBy("key"))
    same = scratch.save(same.select("key", "least", "tid", F.when(place == 1, F.col("least")).otherwise(F.xxhash64("key")).alias("rep")))
    reps = used.join(same.select("key", F.col("least").alias("doc_id"), "tid", "rep"), ["key", "doc_id", "tid"])
    tokens = scratch.save(reps.dropDuplicates(["key"]).select("rep", "n", F.explode("tokens").alias("tile")), free=True)
    shared = tokens.groupBy("tile").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    tiled = scratch.save(tokens.join(shared, "tile").select("tile", "rep", "n", "members"), drop=[tokens], free=True)
    # Members of large tiles have kept most of what their group has in common, so they make good pivots.
    weight = tiled.groupBy("rep").agg(F.sum("members").alias("weight"))
    tiled = scratch.save(tiled.join(weight, "rep"), drop=[tiled], free=True)
    # Texts are read again only for nodes that share a tile.
    sharing = same.join(tiled.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), "tid")
    texts = scratch.save(docs.join(sharing, ["doc_id", "tid"]).select("rep", "text").dropDuplicates(["rep"]), free=True)
    reps = scratch.save(nodes(texts, heavy))

    tested = None
    comps = tiled.select("rep", F.col("rep").alias("comp")).limit(0)
    for k in range(STAR_ROUNDS):
        rows = _labelled(tiled, comps)
        draw = F.pmod(F.xxhash64("rep", F.lit(k)), F.lit(1024)) / 10240 if k else F.lit(0.0)
        best = F.max(F.struct((F.col("weight") * (1 + draw)).alias("w"), (-F.col("rep")).alias("r"), F.col("n").alias("n"), F.col("comp").alias("comp")))
        pivots = _mixed(rows, best.alias("pivot"))
        star = rows.join(pivots, "tile").where(f"comp <> pivot.comp and 100 * n >= {PERCENT} * pivot.n and 100 * pivot.n >= {PERCENT} * n")
        star = star.select(F.least("rep", -F.col("pivot.r")).alias("a"), F.greatest("rep", -F.col("pivot.r")).alias("b")).distinct()
        star = scratch.save(star if tested is None else star.join(tested, ["a", "b"], "left_anti"))
        tested = star if tested is None else tested.unionByName(star)
        linked = _check(star, reps, texts, scratch)
        # Components of the round before stand for their members.
        comps = scratch.save(common.components(comps.toDF("a", "b").unionByName(linked), scratch).toDF("rep", "comp"), drop=[comps])

    rows = scratch.save(_labelled(tiled, comps), drop=[tiled])
    mixed = _mixed(rows, F.max_by("comp", F.struct("weight", -F.col("rep"))).alias("core"))
    rows = rows.join(mixed, "tile")
    strays = rows.groupBy("tile").agg(F.sum((F.col("comp") != F.col("core")).cast("long")).alias("strays"))
    rows = rows.join(strays, "tile").withColumn("blocks", _blocks()).withColumn("block", F.explode("blocks"))
    rows = rows.select("tile", "block", "rep", "comp").join(reps, "rep").select("tile", "block", "rep", "comp", "n", "point", "tokens")
    dealt = rows.repartition("tile", "block").sortWithinPartitions("tile", "block")
    pairs = scratch.save(dealt.mapInArrow(_tiles, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), free=True)
    more = _check(pairs, reps, texts, scratch)
    final = common.components(comps.toDF("a", "b").unionByName(more), scratch)

    comp = same.join(final.toDF("rep", "found"), "rep", "left").select("key", "least", F.coalesce("found", "rep").alias("class"))
    comp = scratch.save(comp)
    comp = comp.join(comp.groupBy("class").agg(F.min("least").alias("smallest")), "class").select("key", "class", "smallest")
    out = prepared.select("doc_id", "tid", "n", "key").join(comp, "key", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "tid", "n", F.when(linked, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("class")).alias("class"))


def _labelled(tiled: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of the tiles with the component of their node; a node without links is its own."""
    return tiled.join(comps.withColumnRenamed("comp", "found"), "rep", "left").withColumn("comp", F.coalesce("found", "rep")).drop("found")


def _mixed(rows: DataFrame, value) -> DataFrame:
    """Tiles whose members are in different components, with an aggregate ``value`` of their rows."""
    tiles = rows.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), value)
    return tiles.where("low < high").drop("low", "high")


def keep_one(documents: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The documents without near-duplicates, with all their columns: of each class the smallest doc_id stays, once.

    Rows without words or doc_id stay, once for each doc_id and text where there is a doc_id.
    Where a doc_id has several texts in a class, the one of the smallest hash stays.
    """
    found = scratch.save(classes(documents, scratch).where("doc_id is not null").select("doc_id", "tid", "class"))
    kept = found.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "tid")).alias("k")).select("k.*")
    kept = kept.unionByName(found.where("class is null").select("doc_id", "tid").distinct()).select(F.col("doc_id").alias("__kept"), F.col("tid").alias("__tid"))
    named = documents.where("doc_id is not null")
    mine = named.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__kept"), F.xxhash64(F.col("text").cast("string")).alias("__tid"))
    one = mine.join(kept, ["__kept", "__tid"], "left_semi").dropDuplicates(["__kept", "__tid"]).select("__row.*")
    return one.unionByName(documents.where("doc_id is null"))


def _blocks():
    """Blocks that a row of a mixed tile goes to.

    Up to BLOCK members are one block. Beyond it, members of the pivot's
    component are dealt to blocks and all others go to each of them; the others
    among themselves are dealt to slots, with a block for each pair of slots.
    """
    expr = f"""
        case when members <= {BLOCK} then array(cast(0 as long))
             when comp = core then array(pmod(xxhash64(rep), div_core))
             else concat(sequence(cast(0 as long), div_core - 1),
                         transform(sequence(cast(0 as long), div_stray - 1), j -> div_core + least(slot, j) * div_stray + greatest(slot, j)))
        end
    """
    for name, value in (("div_core", f"cast(ceil((members - strays) / {BLOCK // 2}) as long)"), ("div_stray", f"cast(greatest(1, ceil(strays / {BLOCK // 2})) as long)"), ("slot", f"pmod(xxhash64(rep), cast(greatest(1, ceil(strays / {BLOCK // 2})) as long))")):
        expr = expr.replace(name, value)
    return F.expr(expr)
