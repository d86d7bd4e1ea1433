"""Language-model scoring with a log-bilinear model.

The model gives each token a distribution over all words from the two tokens
before it: the context vector is the sum of their embeddings, one set for each
place, and its products with output embeddings are the scores. To keep the
normalisation cheap the words stand in about sqrt(V) classes: the scores of all
classes give a distribution over classes, those of the words of one class a
distribution within it, each by one matrix product for many tokens. Their product
is normalised over the vocabulary.

Own embeddings have the words with a share of at least 1 / OWN_SHARE of the training
tokens (and OWN_LEAST occurrences). All others share SHARED embeddings by
their ending, and of the probability of theirs a word has its add-one share, one
for words that training hasn't seen.

The parameters are fitted in numpy by noise-contrastive estimation on every
training token (once, but for small corpora), by Adagrad, in ROUNDS rounds of growing folds of the
documents. In a round each task fits a replica on its part of the fold; the
changes of an embedding are averaged over the replicas by how often they
changed it, block by block on the executors. So the steps and what they send
grow with the input, and the parameters, at most OWN_SHARE + SHARED + 1 rows of
3 * DIMS + 4 numbers, don't.

Word counts cover all training documents. Frequent words, at most FREQUENT, go to
the scoring tasks; the counts of all others come by a join on the word's hash.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Collection, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 7, 2
SHARED, OWN_SHARE, OWN_LEAST = 64, 1 << 16, 10
DIMS, NOISE, NOISE_WITHIN, BATCH, RATE, SEED = 24, 32, 2, 1024, 0.1, 5
#: Eighths of the training documents that each round learns from; together every document once.
ROUNDS = (1, 2, 5)
#: Passes over the tokens of a small corpus: as many as make LEAST_TOKENS, PASSES_MOST at most; a larger one has one.
LEAST_TOKENS, PASSES_MOST = 1_500_000, 4
#: A replica sees at least about so many tokens.
REPLICA_TOKENS = 1_000_000
#: Items whose changes are sent as one row; tokens that are scored at once, and of these by one product.
BLOCK, SCORE_AT_ONCE, PRODUCT = 1024, 1 << 16, 1 << 12
#: A word is frequent from 1 / FREQUENT of all training tokens on, so there are at most so many.
FREQUENT = 500_000
#: Words whose counts a task holds at once.
HOLD = 1_000_000
END = b""  # no word is empty
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END)).view(np.int64).item()


def held_out(doc_id: int | None) -> bool:
    """The fold by crc32 of doc_id as text; a null counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class _Endings(dict):
    """Class by the last two bytes: 1 to SHARED, and 0 for no word."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = found = 1 + xxhash.xxh32_intdigest(ending) % SHARED if ending else 0
        return found


_ENDINGS = _Endings()


def ending_classes(words: Collection[bytes]) -> np.ndarray:
    return np.fromiter((_ENDINGS[w[-2:]] for w in words), np.int64, len(words))


def signed_hashes(words: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


class Tokens(NamedTuple):
    """The tokens of some texts, one text after the other: ``codes`` point into ``hashes`` and ``endings`` of distinct words, of which the end of a text is the last."""

    codes: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    endings: np.ndarray


def _elements(column: pa.Array) -> list[bytes]:
    """The elements of a binary column without nulls, cut from its buffer at once."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def tokens_of(texts: pa.Array) -> Tokens:
    """Words and end of each text, by Arrow's splitting and dictionary encoding; a null text is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.values, lists.offsets.to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    sizes = before[offsets[1:]] - before[offsets[:-1]] + 1
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    words = _elements(encoded.dictionary.cast(pa.binary()))
    codes = np.full(int(sizes.sum()), len(words), np.int64)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = encoded.indices.to_numpy()
    words.append(END)
    return Tokens(codes, sizes, signed_hashes(words), ending_classes(words))


def count_words(documents: DataFrame) -> DataFrame:
    """(h, class, n) of the words of training documents, the end of a text (class 0) included; class: by ending."""

    def merged(parts: list[tuple]) -> tuple:
        hashes, endings, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        hashes, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        return hashes, endings[at], np.bincount(back, n, len(hashes)).astype(np.int64)

    def rows(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["h", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            t = tokens_of(batch.column("text").filter(pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()], pa.bool_())))
            n = np.bincount(t.codes, minlength=len(t.hashes))
            parts.append((t.hashes[n > 0], t.endings[n > 0], n[n > 0]))
            if sum(len(p[0]) for p in parts) > HOLD:
                parts = [merged(parts)]
                if len(parts[0][0]) > HOLD // 2:
                    yield rows(parts.pop())
        if parts:
            yield rows(merged(parts))

    return documents.mapInArrow(run, "h long, class int, n long").groupBy("h", "class").agg(F.sum("n").alias("n"))


def look_up(x: np.ndarray, keys: np.ndarray, values: np.ndarray, other) -> np.ndarray:
    """The value of each element by sorted ``keys``, or else ``other``."""
    if not len(keys):
        return np.full(len(x), other, values.dtype)
    at = keys.searchsorted(x).clip(max=len(keys) - 1)
    return np.where(keys[at] == x, values[at], other)


class Numbering:
    """Numbers of the items of the model: the end of a text, words of their own and shared endings, those of equal endings together."""

    def __init__(self, hashes: np.ndarray, endings: np.ndarray, times: np.ndarray, shared: np.ndarray, ends: int):
        """Own words by hash with their ending and count; counts of the other words by ending (from 1 on), and of the end."""
        kind = np.concatenate([[0], np.arange(1, SHARED + 1), endings]).astype(np.int64)
        n = np.concatenate([[ends], shared, times]).astype(np.float64)
        tie = np.concatenate([np.zeros(SHARED + 1, np.int64), hashes])
        order = np.lexsort((tie, -n, kind))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.counts = n[order]
        self.end, self.by_ending = int(number[0]), number[: SHARED + 1]
        by_hash = np.argsort(hashes)
        self.own, self.own_items = hashes[by_hash], number[SHARED + 1 :][by_hash]
        self.ending = np.zeros(len(order), np.int64)  # of the shared items, else 0
        self.ending[number[1 : SHARED + 1]] = np.arange(1, SHARED + 1)

    def items(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Items of words by hash and ending; an ending of 0 is the end of a text."""
        own = look_up(hashes, self.own, self.own_items, -1)
        return np.where((own < 0) | (endings == 0), self.by_ending[endings], own)


def contexts(items: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's item with those of the two before it, (two before, one before, token); before a text stand two ends.

    Texts follow each other and close with an end, so only the first token of a text has a stranger two before it.
    """
    padded = np.concatenate([[end, end], items])
    x = padded[: len(items)].copy()
    x[np.cumsum(sizes) - sizes] = end
    return x, padded[1 : len(items) + 1], items


class LogBilinear:
    """log p(z | x, y) = log softmax over classes + log softmax within the class of z, of (first[x] + second[y]) times output embeddings."""

    TABLES = ("first", "second", "out")

    def __init__(self, counts: np.ndarray, seed: int = SEED):
        """``counts`` of the items; neighbours share a class. Without output embeddings the model gives their smoothed frequencies."""
        rng = np.random.default_rng(seed)
        v = len(counts)
        classes = math.ceil(math.sqrt(v))
        self.edge = np.linspace(0, v, classes + 1).round().astype(np.int64)
        self.class_of = np.repeat(np.arange(classes), np.diff(self.edge))
        p = (counts + 1.0) / (counts + 1.0).sum()
        self.cumulative = np.concatenate([[0.0], np.cumsum(p)])
        self.class_share = np.add.reduceat(p, self.edge[:-1])
        self.class_share /= self.class_share.sum()
        self.class_cumulative = self.class_share.cumsum()
        self.class_cumulative /= self.class_cumulative[-1]
        self.log_class = np.log(NOISE * self.class_share).astype(np.float32)
        self.log_within = np.log(NOISE_WITHIN * p / self.class_share[self.class_of]).astype(np.float32)
        self.first, self.second, self.out, self.top = (rng.normal(0, 0.1, (n, DIMS)).astype(np.float32) for n in (v, v, v, classes))
        self.out_bias, self.top_bias = (self.log_within - np.float32(math.log(NOISE_WITHIN))), (self.log_class - np.float32(math.log(NOISE)))
        self.seen = {k: np.full(classes if k == "top" else v, 1e-3, np.float32) for k in (*self.TABLES, "top")}
        self.used = np.zeros(v, np.int64)

    def context(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.first[x] + self.second[y]

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Adagrad by row: the gradients of equal rows are summed. The different rows and how often each occurs."""
        order = np.argsort(rows)
        ordered = rows[order]
        start = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        g, row = np.add.reduceat(gradient[order], start, axis=0), ordered[start]
        seen = self.seen[name][row] + np.einsum("rd,rd->r", g, g) / np.float32(DIMS)
        self.seen[name][row] = seen
        rate = np.float32(RATE) / np.sqrt(seen)
        if bias is not None:
            getattr(self, name + "_bias")[row] -= np.add.reduceat(bias[order], start) * rate
        g *= rate[:, None]
        getattr(self, name)[row] -= g
        return row, np.diff(start, append=len(rows))

    def learn(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> None:
        """A step of noise-contrastive estimation: classes against NOISE classes for all tokens, words against NOISE_WITHIN words of their class each."""
        ctx, c = self.context(x, y), self.class_of[z]
        w = self.class_cumulative.searchsorted(rng.random(NOISE), side="right")
        top, noise_top = self.top[c], self.top[w]
        d_true = 1 / (1 + np.exp((self.log_class - self.top_bias)[c] - np.einsum("bd,bd->b", ctx, top))) - 1
        d_false = ctx @ -noise_top.T
        d_false += self.log_class[w] - self.top_bias[w]
        np.exp(d_false, out=d_false)
        d_false += 1
        np.reciprocal(d_false, out=d_false)
        top *= d_true[:, None]
        d_ctx = d_false @ noise_top
        d_ctx += top
        low, high = self.edge[c], self.edge[c + 1]
        drawn = self.cumulative[low, None] + rng.random((len(z), NOISE_WITHIN)) * (self.cumulative[high] - self.cumulative[low])[:, None]
        noise = (np.searchsorted(self.cumulative, drawn, side="right") - 1).clip(low[:, None], high[:, None] - 1)
        rows = np.concatenate([z[:, None], noise], axis=1)
        out = self.out[rows]
        d = 1 / (1 + np.exp(-np.einsum("bd,bkd->bk", ctx, out) - self.out_bias[rows] + self.log_within[rows]))
        d[:, 0] -= 1
        d_ctx += np.einsum("bk,bkd->bd", d, out)
        row, times = self._step("out", rows.ravel(), (d[:, :, None] * ctx[:, None, :]).reshape(-1, DIMS), d.ravel())
        self.used[row] += times
        self._step("top", np.concatenate([c, w]), np.concatenate([d_true[:, None] * ctx, d_false.T @ ctx]), np.concatenate([d_true, d_false.sum(0)]))
        self._step("first", x, d_ctx)
        self._step("second", y, d_ctx)

    def fit(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, rng: np.random.Generator, passes: int = 1) -> LogBilinear:
        """Passes over the tokens, each in a random order."""
        for _ in range(passes):
            order = rng.permutation(len(z))
            for at in range(0, len(z), BATCH):
                i = order[at : at + BATCH]
                self.learn(x[i], y[i], z[i], rng)
        return self

    def log10(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """log10 p(z | x, y) of each token: one matrix product with all classes, and one with the words of each class that occurs."""
        ctx, c = self.context(x, y), self.class_of[z]
        # A one beside each context takes the biases into the products.
        ctx = np.concatenate([ctx, np.ones((len(ctx), 1), np.float32)], axis=1)
        top, words = (np.concatenate([v, b[:, None]], axis=1) for v, b in ((self.top, self.top_bias), (self.out, self.out_bias)))
        longest = _longest(ctx)
        safe = longest * _longest(top) < 80
        out = np.concatenate([_log_softmax(ctx[k : k + PRODUCT] @ top.T, c[k : k + PRODUCT], safe) for k in range(0, len(c), PRODUCT)] or [np.zeros(0)])
        safe = longest * _longest(words) < 80
        order = np.argsort(c, kind="stable")
        cut = np.searchsorted(c[order], np.arange(len(self.top) + 1))
        for k in np.flatnonzero(np.diff(cut)):
            own = slice(self.edge[k], self.edge[k + 1])
            for at in np.array_split(order[cut[k] : cut[k + 1]], -(-(cut[k + 1] - cut[k]) // PRODUCT)):
                out[at] += _log_softmax(ctx[at] @ words[own].T, z[at] - self.edge[k], safe)
        return out / math.log(10)

    def _columns(self) -> np.ndarray:
        """A row an item: embeddings, bias and what Adagrad has seen."""
        return np.concatenate([self.first, self.second, self.out, self.out_bias[:, None], *(self.seen[k][:, None] for k in self.TABLES)], axis=1)

    def _top_columns(self) -> np.ndarray:
        return np.concatenate([self.top, self.top_bias[:, None], self.seen["top"][:, None]], axis=1)

    def changes(self, since: LogBilinear) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, width, rows, weights, change) of what differs; block -1 holds the classes."""
        change, used = self._columns() - since._columns(), self.used - since.used
        for block in range(-(-len(used) // BLOCK)):
            rows = np.flatnonzero(used[block * BLOCK : (block + 1) * BLOCK])
            if len(rows):
                yield block, change.shape[1], rows, used[block * BLOCK + rows], change[block * BLOCK + rows]
        top = self._top_columns() - since._top_columns()
        yield -1, top.shape[1], np.arange(len(top)), np.full(len(top), max(1, int(used.sum()))), top

    def change(self, block: int, by: np.ndarray) -> None:
        """Adds a mean change of a block."""
        if block < 0:
            self.top += by[:, :DIMS]
            self.top_bias += by[:, DIMS]
            self.seen["top"] += by[:, DIMS + 1]
            return
        at = slice(block * BLOCK, block * BLOCK + len(by))
        for k, name in enumerate(self.TABLES):
            getattr(self, name)[at] += by[:, k * DIMS : (k + 1) * DIMS]
            self.seen[name][at] += by[:, 3 * DIMS + 1 + k]
        self.out_bias[at] += by[:, 3 * DIMS]


def _longest(rows: np.ndarray) -> float:
    return math.sqrt(np.einsum("rd,rd->r", rows, rows).max(initial=0.0))


def _log_softmax(scores: np.ndarray, at: np.ndarray, safe: bool = False) -> np.ndarray:
    """The log of the softmax of each row at its element ``at``; overwrites the scores. ``safe``: none is beyond 80, up or down."""
    if not safe and (scores.max() > 80 or scores.min() < -80):  # only then could a sum of exponentials overflow, or vanish
        scores -= scores.max(1)[:, None]
    own = scores[np.arange(len(at)), at]
    return own - np.log(np.exp(scores, out=scores).sum(1)).astype(np.float64)


def eighth(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) // FOLDS % sum(ROUNDS)


_CHANGES = "block int, width int, rows binary, weights binary, change binary"


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each block, weighted by row; a block is in one partition."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, width, rows, weights, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, weights = np.frombuffer(rows, np.int32), np.frombuffer(weights, np.float64)
            n = int(rows.max()) + 1
            sums, by = total.get(block, (np.zeros(0), np.zeros((0, width))))
            if len(sums) < n:
                sums, by = np.concatenate([sums, np.zeros(n - len(sums))]), np.concatenate([by, np.zeros((n - len(by), width))])
                total[block] = sums, by
            sums[rows] += weights
            by[rows] += weights[:, None] * np.frombuffer(change, np.float16).reshape(len(rows), width)
    for block, (sums, by) in total.items():
        mean = (by / np.maximum(sums, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.shape[1]], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "width", "change"])


def train(docs: DataFrame, numbering: Numbering, tokens: int) -> LogBilinear:
    """The model fitted on the training documents of (doc_id, text), which hold so many tokens."""
    spark, model = docs.sparkSession, LogBilinear(numbering.counts)
    if not tokens:
        model.out[:], model.top[:] = 0, 0
    parts = docs.coalesce(max(1, -(-tokens // REPLICA_TOKENS)))
    passes = min(PASSES_MOST, max(1, -(-LEAST_TOKENS // max(1, tokens))))
    done = 0
    for number, eighths in enumerate(ROUNDS if tokens else ()):
        bits = ((1 << eighths) - 1) << done
        done += eighths
        sent = spark.sparkContext.broadcast((model, numbering))  # bounded by OWN_SHARE

        def run(batches: Iterator[pa.RecordBatch], sent=sent, bits=bits, number=number) -> Iterator[pa.RecordBatch]:
            start, numbered = sent.value
            replica = copy.deepcopy(start)
            rng = np.random.default_rng((SEED, number, TaskContext.get().partitionId()))
            for batch in batches:
                mine = pa.array([not held_out(i) and bits >> eighth(i) & 1 == 1 for i in batch.column("doc_id").to_pylist()], pa.bool_())
                t = tokens_of(batch.column("text").filter(mine))
                replica.fit(*contexts(numbered.items(t.hashes, t.endings)[t.codes], t.sizes, numbered.end), rng, passes)
            if (replica.used != start.used).any():
                for block, width, rows, weights, change in replica.changes(start):
                    half = change.clip(-6e4, 6e4).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), weights.astype(np.float64), half))],
                        ["block", "width", "rows", "weights", "change"],
                    )

        mean = parts.mapInArrow(run, _CHANGES).repartition("block").mapInArrow(_mixed, "block int, width int, change binary").toArrow()
        for block, width, change in zip(*(c.to_pylist() for c in mean.columns), strict=True):
            model.change(block, np.frombuffer(change, np.float32).reshape(-1, width))
        sent.destroy()
    return model


def score(documents: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text is empty and has its end alone; a null doc_id is in the training
    part. Repeated rows count and are scored each by itself. With no training
    document all counts are 0 and the model gives the end and the SHARED endings
    the same probability each. Extra columns are not read.
    """
    spark = common.session(documents)
    scratch = scratch or common.Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = scratch.save(count_words(docs), free=True)
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("class") == 0, F.col("n"))), F.lit(0))).first()
    top = counts.where("class <> 0").where(F.col("n") >= F.lit(total / FREQUENT)).toArrow()
    hashes, endings, times = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "class", "n"))
    least = max(OWN_LEAST, total / OWN_SHARE)
    own = times >= least
    # What the words of a shared ending add up to, with one for words that are not known.
    others = counts.where("class <> 0").where(F.col("n") < F.lit(least)).groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("z")).toArrow()
    shared, weight = np.zeros(SHARED + 1), np.ones(SHARED + 1)
    shared[others.column("class").to_numpy()] = others.column("n").to_numpy()
    weight[others.column("class").to_numpy()] += others.column("z").to_numpy()
    numbering = Numbering(hashes[own], endings[own], times[own], shared[1:], ends)
    model = train(docs, numbering, int(total))
    hashes, times = np.append(hashes, END_HASH), np.append(times, ends)
    order = np.argsort(hashes)
    log_weight = np.log10(weight)[numbering.ending]
    # At most FREQUENT hashes and logs, and the parameters: sizes that do not depend on the input.
    sent = spark.sparkContext.broadcast((model, numbering, hashes[order], np.log10(times[order] + 1.0), log_weight))
    end_known = int(total > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, numbered, hashes, logs, log_weight = sent.value
        for batch in batches:
            t = tokens_of(batch.column("text"))
            found = look_up(t.hashes, hashes, logs, math.nan)  # nan: not among the frequent words
            items, rare = numbered.items(t.hashes, t.endings), np.isnan(found)
            in_shared, log = numbered.ending[items] > 0, np.where(rare, 0.0, found)
            every, size = t.codes, t.sizes
            at = np.cumsum(size) - size
            x, y, z = contexts(items[every], size, numbered.end)
            model_log = np.concatenate([lm.log10(x[k : k + SCORE_AT_ONCE], y[k : k + SCORE_AT_ONCE], z[k : k + SCORE_AT_ONCE]) for k in range(0, len(z), SCORE_AT_ONCE)] or [np.zeros(0)]) - log_weight[z]

            def summed(values: np.ndarray, at=at) -> np.ndarray:
                return np.add.reduceat(values, at) if len(at) else values[:0]

            # The words of each text that are not frequent.
            at_rare = np.flatnonzero(rare[every])
            pairs, times = np.unique(np.repeat(np.arange(len(size)), size)[at_rare] * (len(rare) + 1) + every[at_rare], return_counts=True)
            text, word = pairs // (len(rare) + 1), pairs % (len(rare) + 1)
            cut = np.searchsorted(text, np.arange(len(size) + 1))
            unknown = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(t.hashes[word]), pa.array(times.astype(np.int64))], ["h", "n"]))
            known = summed((~rare[every]).astype(np.int64)) - (1 - end_known)
            columns = [pa.array(size, pa.int64()), pa.array(known, pa.int64()), *(pa.array(summed(v), pa.float64()) for v in (log[every], np.where(in_shared[every], log[every], 0.0), model_log))]
            columns.append(unknown)
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held_out(i) for i in ids], pa.bool_()), *columns], ["doc_id", "held_out", "n_tokens", "frequent_known", "frequent_log", "shared_log", "model_log", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, frequent_known long, frequent_log double, shared_log double, model_log double, rare array<struct<h:long,n:long>>"
    scored = scratch.save(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), free=True)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    known = counts.select("h", F.col("n").alias("c"))
    logs = rare.join(known, "h").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known"))
    out = scored.drop("rare").join(logs, "row", "left").na.fill({"rare_log": 0.0, "rare_known": 0})
    denominator = math.log10(total + distinct + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("frequent_known") + F.col("rare_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("frequent_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("model_log") + F.col("shared_log") + F.col("rare_log")).alias("score"),
    )
