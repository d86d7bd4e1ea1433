"""Removal of repeated byte strings by longest-previous-factor arrays.

In suffix order, the previous and the next suffix of a smaller position are the
best earlier matches of a suffix; the longer of the two common prefixes is its
longest previous factor (LPF). A byte is a later copy if a suffix whose LPF
reaches LENGTH covers it. The longest next factor, the same with larger
positions, tells what a later position matches, so that every copy of strings of
``reach`` bytes can be told in the same go. Matches never cross documents.

One suffix array over all texts would be a single global sort of every byte, so
suffixes are first dealt to buckets by content: the smallest hash among the
substrings of ANCHOR bytes in the first bytes of a suffix depends on these bytes
only, so equal strings meet in the same bucket. Consecutive suffixes of one
bucket form a run, and equal runs are aggregated before anything is compared: all
but the first are later copies from end to end, and the first stands for them.
Runs that share a bucket with different ones (the edges of repeated passages)
are compared byte by byte, by suffix and LPF arrays of their buckets.

A run of more than ``length`` suffixes holds its anchor several times, so it may
repeat itself over and over. Of equal strings of one run the first alone is sorted;
for the others it is the earlier match that reaches.

A bucket of more than HOT different runs is dealt on with the longest anchors there
are, the whole strings. Such a bucket holds copies of one string alone: its
suffix order is the order of positions, every common prefix is the whole, and so
is the LPF of all but the smallest position, which an aggregate finds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Strings of which no copy is left in the digest.
LENGTH = 400
#: Repeated passages: fewer bytes than any 51 words take in the documents at hand (225), so none of more than fifty words stays.
PASSAGE, ANCHOR = 200, 70
#: Longest strings that can be told.
REACH_MOST = 4096
#: Suffixes of one step over a long text.
SEGMENT = 1 << 18
#: Suffixes sorted at once; each takes the bytes of the longest string.
SORT_AT_ONCE = 30_000
#: Beyond so many different runs a bucket is dealt on by its whole strings, over all tasks.
HOT = 4096
_LUT = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=7) | 1 for i in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, SEGMENT + REACH_MOST + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + REACH_MOST + 1)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LUT[data] * _POWER[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of each substring of ``size`` bytes."""
    n = len(sums) - size
    return common.mix((sums[size:] - sums[:n]) * _INVERSE[:n])


def _sliding(h: np.ndarray, width: int, ufunc) -> np.ndarray:
    """ufunc over each window of ``width`` elements (van Herk)."""
    if width == 1:
        return h
    n = len(h)
    pad = -n % width
    fill = np.full(pad, h[-1], h.dtype)
    blocks = np.concatenate([h, fill]).reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, starts: int, length: int, anchor: int, reach: int):
    """(bucket, short, long, start, count) of the runs of the first ``starts`` suffixes, and starts that repeat among them.

    ``short`` is a hash of the strings of ``length`` bytes of a run, ``long`` of
    those of ``reach`` bytes, as far as ``data`` goes.
    """
    sums = _sums(data)
    h = _hashes(sums[: starts + length], anchor)
    width = length - anchor + 1
    low = _sliding(h, width, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, starts))
    short, long = (common.mix((sums[end] - sums[first]) * _INVERSE[first] + (end - first).astype(np.uint64)) for end in (first + count + length - 1, np.minimum(first + count + reach - 1, len(data))))
    # A run can only repeat one of its own strings where its smallest anchor stands in it twice.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    chosen = int((_sliding(padded, width, np.maximum) == h).sum())
    again = np.zeros(0, np.int64)
    if chosen != len(first):
        _, back, times = np.unique(_hashes(sums[: starts + length], length), return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
    return low[first], short, long, first, count, again


def segments(raw: bytes, length: int, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(offset, suffix starts, bytes) of overlapping parts of a text; each suffix start is in one part."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        starts = min(SEGMENT, len(data) - length + 1 - at)
        yield at, starts, data[at : at + starts + reach - 1]


RUNS = "did long, tid long, bucket long, short long, long long, start int, count int, own boolean"


def text_runs(docs: DataFrame, length: int, anchor: int, reach: int) -> DataFrame:
    """The runs of (did, tid, text); ``own`` marks starts that repeat within the same part of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, tid, text in zip(*(batch.column(c).to_pylist() for c in ("did", "tid", "text")), strict=True):
                for at, starts, data in segments(text.encode("utf-8", "surrogatepass"), length, reach):
                    bucket, short, long, first, count, again = runs(data, starts, length, anchor, reach)
                    out.append((did, tid, bucket, short, long, first + at, count, np.zeros(len(first), bool)))
                    if len(again):
                        edge = np.flatnonzero(np.diff(again, prepend=-2) != 1)
                        size = np.diff(np.append(edge, len(again)))
                        zero = np.zeros(len(edge), np.uint64)
                        out.append((did, tid, np.full(len(edge), tid, np.int64).view(np.uint64), zero, zero, again[edge] + at, size, np.ones(len(edge), bool)))
            if out:
                size = [len(x[2]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.repeat([x[k] for x in out], size), pa.int64()) for k in (0, 1)),
                        *(pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (2, 3, 4)),
                        *(pa.array(np.concatenate([x[k] for x in out]).astype(np.int32)) for k in (5, 6)),
                        pa.array(np.concatenate([x[7] for x in out])),
                    ],
                    ["did", "tid", "bucket", "short", "long", "start", "count", "own"],
                )

    return docs.mapInArrow(run, RUNS)


def suffix_order(data: np.ndarray, starts: np.ndarray, left: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by (group, first ``length`` bytes, position), and the common prefix with the one before, up to ``length``.

    ``left`` is how many bytes a suffix has; ``data`` goes on for at least ``length``.
    """
    window = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    window[np.arange(length) >= left[:, None]] = 0
    text = window.view(f"S{length}").ravel()
    # What ends comes before what goes on with a zero.
    order = np.argsort(left.clip(max=length), kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    common_prefix = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        differ = window[a] != window[b]
        common_prefix[1:] = np.where(differ.any(1), differ.argmax(1), length)
        common_prefix[1:] = np.minimum(common_prefix[1:], np.minimum(left[a], left[b]))
        common_prefix[1:][group[a] != group[b]] = 0
    return order, common_prefix


def _nearest_smaller(p: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it, in suffix order, of a smaller position; 0 without one.

    ``p`` are the positions in suffix order, ``edge`` the common prefix of each
    with the one before. Tables of the minima of 1, 2, 4, ... neighbours let all
    suffixes step back over larger positions at once, the widest step first.
    """
    n = len(p)
    lows, edges, width = [p], [edge], 1
    while 2 * width < n:
        low, least = lows[-1], edges[-1]
        lows.append(np.minimum(low[width:], low[:-width]))  # of the elements i .. i + 2 * width - 1
        edges.append(np.minimum(least[width:], least[:-width]))
        width *= 2
    at = np.arange(n)  # everything in at .. i - 1 is larger
    best = np.full(n, np.iinfo(np.int64).max)
    for low, least in zip(reversed(lows), reversed(edges), strict=True):
        i = np.flatnonzero(at >= width)
        i = i[low[at[i] - width] > p[i]]
        # Leaving ``at`` for the one before crosses its edge.
        best[i] = np.minimum(best[i], least[at[i] - width + 1])
        at[i] -= width
        width //= 2
    found = at > 0
    return np.where(found, np.minimum(best, edge[at]), 0)


def longest_previous_factor(position: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """LPF of each suffix: the longest common prefix with a suffix of a smaller position.

    ``position`` ranks the suffixes, ``order`` is their suffix order and
    ``shared`` the common prefix of each with the one before it in that order.
    The previous and the next smaller position in suffix order are the best of
    all; the common prefix with them is the least one on the way. For the
    longest next factor, give the negative positions.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n > 1:
        p = position[order]
        back = np.concatenate([[0], shared[:0:-1]])  # as met from the other end
        out[order] = np.maximum(_nearest_smaller(p, shared), _nearest_smaller(p[::-1], back)[::-1])
    return out


def factors(rows: list[tuple], length: int, reach: int) -> list[tuple]:
    """(did, tid, start, count, later, every) of suffix starts that repeat. rows: (bucket, did, tid, start, count, bytes), whole buckets.

    ``later``: the longest previous factor reaches ``length``; ``every``: it or
    the longest next factor reaches ``reach``. Suffixes are sorted in parts by the hash of
    ``length`` bytes, so that equal strings share a part and memory stays bounded.
    """
    data = np.frombuffer(b"".join([*(r[5] for r in rows), bytes(reach)]), np.uint8)
    size = np.array([len(r[5]) for r in rows])
    at = np.cumsum(size) - size
    count = np.array([r[4] for r in rows])
    owner = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1][owner]
    # Positions run on through the texts in order of did, tid and offset.
    place = np.lexsort((np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])))
    rank = np.empty(len(rows), np.int64)
    rank[place] = np.arange(len(rows))
    position = rank[owner] * (SEGMENT + 1) + offset
    state = np.zeros(len(owner), np.int8)  # 1: later, 2: every
    first = np.ones(len(owner), bool)
    base = np.cumsum(count) - count
    for k in np.flatnonzero(count > length):
        _, again, first_again = repeats_within(rows[k][5], int(count[k]), reach)
        state[base[k] + again], first[base[k] + again] = 3, False
        state[base[k] + first_again] = 2
    some = np.flatnonzero(first)
    parts = -(-len(some) // SORT_AT_ONCE)
    share = np.concatenate([string_hashes(r[5], r[4], length) for r in rows])[some] % np.uint64(parts) if parts > 1 else None
    for p in range(parts):
        part = some[share == p] if parts > 1 else some
        order, shared = suffix_order(data, at[owner[part]] + offset[part], size[owner[part]] - offset[part], group[part], reach)
        previous = longest_previous_factor(position[part], order, shared)
        following = longest_previous_factor(-position[part], order, shared)
        state[part] |= ((previous >= length) + 2 * (np.maximum(previous, following) >= reach)).astype(np.int8)
    hit = np.flatnonzero(state)
    if not len(hit):
        return []
    edge = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(owner[hit], prepend=-1) != 0) | (np.diff(state[hit], prepend=0) != 0))
    n = np.diff(np.append(edge, len(hit)))
    return [(rows[owner[h]][1], rows[owner[h]][2], int(rows[owner[h]][3] + offset[h]), int(k), bool(state[h] & 1), bool(state[h] & 2)) for h, k in zip(hit[edge], n, strict=True)]


def string_hashes(raw: bytes, starts: int, length: int) -> np.ndarray:
    """The hash of each of the first ``starts`` strings of ``length`` bytes."""
    return np.concatenate([_hashes(_sums(data), length) for _, _, data in segments(raw[: starts + length - 1], length, length)])


def repeats_within(raw: bytes, starts: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings of ``reach`` bytes of a run, the starts of those that the run holds before, and of the first of these."""
    full = min(starts, len(raw) - reach + 1)
    if full <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = string_hashes(raw, full, reach)
    _, at, times = np.unique(h, return_index=True, return_counts=True)
    again = np.ones(full, bool)
    again[at] = False
    return h, np.flatnonzero(again), at[times > 1]


REPEATS = "did long, tid long, start int, count int, later boolean, every boolean"
CONTEXTS = "bucket long, did long, tid long, start int, count int, bytes binary"


def _batch(found: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*found, strict=True)) if found else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])


def compare_buckets(contexts: DataFrame, length: int, reach: int) -> DataFrame:
    """Repeats within the buckets of rows of CONTEXTS, sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, taken, now = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if taken >= SORT_AT_ONCE:
                        yield _batch(factors(rows, length, reach), REPEATS)
                        rows, taken = [], 0
                    now = row[0]
                rows.append(row)
                taken += row[4]
        if rows:
            yield _batch(factors(rows, length, reach), REPEATS)

    return contexts.mapInArrow(run, REPEATS)


def keys(documents: DataFrame) -> DataFrame:
    """did and tid tell rows apart by doc_id and text; a null doc_id has a did of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return documents.withColumn("text", text).withColumn("did", did).withColumn("tid", F.xxhash64(text))


_SPAN = "array<struct<start:int,end:int>>"
#: Sorted spans put together where they touch.
_MERGED = f"""aggregate({{}}, cast(array() as {_SPAN}), (acc, x) ->
    case when size(acc) > 0 and x.start <= element_at(acc, -1).end
         then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
         else concat(acc, array(x)) end)"""


def find_repeats(documents: DataFrame, scratch: common.Scratch, length: int = PASSAGE, anchor: int = ANCHOR, reach: int | None = None) -> DataFrame:
    """(did, tid, text, later, every) of the texts with a repeat, a scratch table.

    ``later``: sorted disjoint spans (start, end) of the bytes of all copies of
    strings of ``length`` bytes but the first by (did, tid, start); ``every``: of all
    copies of strings of ``reach`` bytes (none without ``reach``), which must not be
    less. Rows with equal did and tid are one document for ``later``.
    """
    if not 0 < anchor <= length <= (reach or length) <= REACH_MOST:
        raise ValueError(f"anchor, length and reach must not fall, nor exceed {REACH_MOST}")
    common.session(documents)
    look = reach or length
    docs = keys(documents).where(F.octet_length("text") >= length).select("did", "tid", "text")
    found = text_runs(docs, length, anchor, look)
    # Buckets of one run need nothing; that is most of them.
    often = scratch.save(found.where("not own").groupBy("bucket").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("bucket", F.lit(True).alias("often")), free=True)
    found = scratch.save(found.join(often, "bucket", "left").where("own or often").drop("often"), drop=[often], free=True)
    shared = found.where("not own").groupBy("bucket", "short", "long").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("did", "tid", "start")).alias("first"))
    shared = scratch.save(shared, free=True)
    in_short = shared.groupBy("bucket", "short").agg(F.min("first").alias("short_first"), F.sum("times").alias("short_times"))
    mixed = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("contexts"))
    shared_rows = shared.join(mixed.where("contexts > 1"), "bucket", "left").join(in_short, ["bucket", "short"])
    shared_rows = shared_rows.select("bucket", "short", "long", "times", "first", "short_first", "short_times", F.coalesce("contexts", F.lit(1)).alias("contexts"))
    shared_rows = scratch.save(shared_rows, drop=[shared], free=True)
    hits = found.join(shared_rows, ["bucket", "short", "long"], "left").where("own or times is not null")
    here = F.struct("did", "tid", "start")
    later = ~F.col("own") & (F.col("short_times") > 1) & (here != F.col("short_first"))
    every = ~F.col("own") & (F.col("times") > 1) & F.lit(reach is not None)
    # Strings that repeat within one part of a text: the part is compared with itself.
    detail = F.col("own") | (F.col("contexts") > 1) & (here == F.col("first"))
    flagged = hits.select("did", "tid", "bucket", "start", "count", *(F.coalesce(c, F.lit(False)).alias(n) for c, n in ((later, "later"), (every, "every"), (detail, "detail"), (F.col("contexts") > HOT, "hot"))))
    # Sets: rows of equal did and tid say the same.
    flagged = flagged.where("later or every or detail").groupBy("did", "tid").agg(
        F.collect_set(F.when(F.col("later") | F.col("every"), F.struct("start", "count", "later", "every"))).alias("equal"),
        F.collect_set(F.when(F.col("detail"), F.struct("bucket", "start", "count", "hot"))).alias("detail"),
    )
    work = scratch.save(docs.join(flagged, ["did", "tid"]).dropDuplicates(["did", "tid"]), drop=[shared_rows, found], free=True)
    detailed = work.where("size(detail) > 0").select("did", "tid", "text", "detail")
    dealt = cut_contexts(detailed, look).repartition("bucket").sortWithinPartitions("bucket", "did", "tid", "start")
    compared = compare_buckets(dealt, length, look).unionByName(compare_hot(detailed.where("exists(detail, d -> d.hot)"), length, look, scratch))
    whole = work.select("did", "tid", F.octet_length("text").alias("size"), F.explode("equal").alias("g"))
    whole = whole.select("did", "tid", "g.start", "g.count", "g.later", "g.every", "size")
    # Near the end of a text, what reaches ``length`` may not reach ``reach``.
    fits = F.least(F.col("count"), F.coalesce("size", F.col("start") + F.col("count") + look) - look - F.col("start") + 1)
    span = lambda size, count: F.struct("start", (F.col("start") + count + size - 1).alias("end"))
    spans = compared.withColumn("size", F.lit(None).cast("int")).unionByName(whole)
    spans = spans.groupBy("did", "tid").agg(
        F.array_sort(F.collect_list(F.when(F.col("later"), span(length, F.col("count"))))).alias("later_spans"),
        F.array_sort(F.collect_list(F.when(F.col("every") & (fits > 0) & F.lit(reach is not None), span(look, fits)))).alias("every_spans"),
    )
    merged = work.select("did", "tid", "text").join(spans, ["did", "tid"]).select("did", "tid", "text", *(F.expr(_MERGED.format(f"{n}_spans")).alias(n) for n in ("later", "every")))
    return scratch.save(merged, drop=[work], free=True)


def cut_contexts(work: DataFrame, look: int) -> DataFrame:
    """Rows of CONTEXTS, with ``look`` bytes for each suffix as far as the text goes, of runs in buckets that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, tid, text, detail in zip(*(batch.column(c).to_pylist() for c in ("did", "tid", "text", "detail")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(d["bucket"], did, tid, d["start"], d["count"], raw[d["start"] : d["start"] + d["count"] + look - 1]) for d in detail if not d["hot"]]
            yield _batch(out, CONTEXTS)

    return work.mapInArrow(run, CONTEXTS)


def compare_hot(work: DataFrame, length: int, look: int, scratch: common.Scratch) -> DataFrame:
    """Repeats within hot buckets, which are dealt on with anchors of ``length`` and of ``look`` bytes.

    A bucket that holds a large share of all rows is too much for one task; equal
    strings of it meet in partial aggregates and a join that can be split. The
    smallest position of a string has no previous factor, all others reach it.
    """
    schema = "bucket long, did long, tid long, start int, short long, long long, twice boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, tid, text, detail in zip(*(batch.column(c).to_pylist() for c in ("did", "tid", "text", "detail")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for d in detail:
                    if d["hot"]:
                        n = d["count"]
                        bytes_ = raw[d["start"] : d["start"] + n + look - 1]
                        short = string_hashes(bytes_, n, length).view(np.int64)
                        long, again, first_again = repeats_within(bytes_, n, look)
                        null, twice = np.zeros(n, bool), np.zeros(n, bool)
                        null[again], twice[first_again] = True, True  # what the run itself holds before meets nothing
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(np.full(n, v, np.int64)) for v in (d["bucket"], did, tid)), pa.array(np.arange(d["start"], d["start"] + n, dtype=np.int32)), pa.array(short, mask=null),
                             pa.concat_arrays([pa.array(long.view(np.int64), mask=null[: len(long)]), pa.nulls(n - len(long), pa.int64())]), pa.array(twice)],
                            ["bucket", "did", "tid", "start", "short", "long", "twice"],
                        )

    rows = work.mapInArrow(run, schema)
    first = rows.where("short is not null").groupBy("bucket", "short").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("did", "tid", "start")).alias("first")).where("times > 1").drop("times")
    again = rows.where("long is not null").groupBy("bucket", "long").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "long", F.lit(True).alias("every"))
    found = rows.join(scratch.save(first), ["bucket", "short"], "left").join(scratch.save(again), ["bucket", "long"], "left")
    later = F.col("short").isNull() | F.coalesce(F.struct("did", "tid", "start") != F.col("first"), F.lit(False))
    every = F.col("short").isNull() | F.col("twice") | F.coalesce("every", F.lit(False))
    return found.select("did", "tid", "start", F.lit(1).alias("count"), later.alias("later"), every.alias("every")).where("later or every")


def _kept(raw: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]])


def _kept_text(text: str, spans: list[dict]) -> str:
    """The characters of which no byte is in a span."""
    raw = text.encode("utf-8", "surrogatepass")
    continued = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    wide, at = [], 0
    for s in spans:
        start, end = s["start"], s["end"]
        while continued(start):
            start -= 1
        while continued(end):
            end += 1
        wide.append({"start": max(start, at), "end": end})
        at = end
    return _kept(raw, wide).decode("utf-8", "surrogatepass")


def digest(documents: DataFrame, scratch: common.Scratch | None = None, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of every row.

    The digest is of what is left without any copy of strings of ``length`` bytes
    that repeat. ``text`` is the text without passages of ``passage`` bytes that
    an earlier document, or the text itself before, holds: the first copy stays.
    Null texts are empty; repeated rows are copies of each other and lose all in
    the digest, and are one document for ``text``. Extra columns are not read; an
    empty table gives an empty result.
    """
    scratch = scratch or common.Scratch(documents.sparkSession)
    found = find_repeats(documents, scratch, passage, passage * ANCHOR // PASSAGE, length)
    schema = "did long, tid long, n_removed long, n_spans long, sha string, left_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for did, tid, text, later, every in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha = hashlib.sha256(_kept(text.encode("utf-8", "surrogatepass"), every)).hexdigest() if every else None
                got.append((did, tid, sum(s["end"] - s["start"] for s in every), len(every), sha, _kept_text(text, later) if later else None))
            yield _batch(got, schema)

    rows = keys(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "did", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), "text")
    out = rows.join(found.mapInArrow(run, schema), ["did", "tid"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("left_text", "text").alias("text"))


def remove_later_copies(documents: DataFrame, scratch: common.Scratch, length: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """The documents, each text without strings of ``length`` bytes that an earlier one (by doc_id, then offset) holds.

    Characters of which a byte is removed go as a whole. Documents of which no
    word is left go. All columns stay; n_chars, where there is one, follows the text.
    """
    found = find_repeats(documents, scratch, length, anchor).where("size(later) > 0").select("did", "tid", "text", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(did, tid, _kept_text(text, later)) for did, tid, text, later in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch([(d, i, t if common.words_of(t) else "") for d, i, t in got], "did long, tid long, left_text string")

    changed = scratch.save(found.mapInArrow(run, "did long, tid long, left_text string"), free=True)
    rows = keys(documents.select(F.struct("*").alias("__row"), "doc_id", "text")).select("__row", "did", "tid")
    out = rows.join(changed, ["did", "tid"], "left").where("left_text is null or left_text <> ''")
    text = F.coalesce("left_text", F.col("__row.text"))
    fields = {"text": text} | ({"n_chars": F.when(F.col("left_text").isNull(), F.col("__row.n_chars")).otherwise(F.length("left_text")).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return out.select(*(fields.get(c, F.col(f"__row.`{c}`")).alias(c) for c in documents.columns))
