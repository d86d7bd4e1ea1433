"""A quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Their votes
are counted by pattern, and expectation-maximisation over the patterns (at most
3^L of them, whatever the input) estimates how often each heuristic votes for a
class and with it the posterior of every pattern, without labels. Posterior
labels train a linear scorer on hashed features of the words' shapes. The scorer
is fitted on a bounded sample: the TRAIN_ROWS documents with the smallest hash
of their id. Every document is voted on, counted and scored.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 6000
FEATURES = 1 << 12
EM_STEPS, EPOCHS, RATE, DECAY = 200, 60, 0.5, 1e-4
#: Score of a text without words, which has no features.
NO_WORDS = -20.0
#: Share of documents with a good posterior that the cutoff may reject.
REJECT = 0.002

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on was be as with by this from are or at an et de la le les des un une que qui dans pour pas sur au par est en du il elle der die das und ist von zu den mit sich auf ein eine nicht es im dem auch el los las y del se por con para su lo".split()
)

_SHAPE = [(re.compile(r"[^\W\d_]*[^\W\d_a-zß-öø-ÿ][^\W\d_]+"), "W"), (re.compile(r"[^\W\d_]+"), "w"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w])\1+"), r"\1\1")]
_ENDS = re.compile(rb"[.?!](?=[\x20\x09-\x0D]|\Z)")
_SPACE, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER[0x41:0x5B] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
#: Words whose shapes a task keeps.
HOLD = 300_000


def shape_of(word: str) -> str:
    """A word's shape: case, digits and runs of other characters, up to eight of them."""
    if word.isalpha():
        return "w" if word.islower() else "W" if word.isupper() and len(word) > 1 else "Ww"
    for pattern, to in _SHAPE:
        word = pattern.sub(to, word)
    return word[:8]


def hashed(feature) -> int:
    return xxhash.xxh32_intdigest(repr(feature)) % FEATURES


class Shapes(dict):
    """Codes of the words that a task meets: twice the number of the shape, one more for a function word."""

    def __init__(self):
        self.names = [""]
        self.numbers = {"": 0}
        self.single: list[int] = [hashed("")]
        self.pairs: dict[int, int] = {}

    def __missing__(self, word: bytes) -> int:
        shape = shape_of(word.decode("utf-8", "surrogatepass"))
        n = self.numbers.setdefault(shape, len(self.names))
        if n == len(self.names):
            self.names.append(shape)
            self.single.append(hashed(shape))
        self[word] = code = 2 * n + (word.strip(b".,;:!?").lower().decode("utf-8", "surrogatepass") in FUNCTION_WORDS)
        return code

    def pair(self, key: int) -> int:
        if key not in self.pairs:
            self.pairs[key] = hashed((self.names[key >> 32], self.names[key & 0xFFFFFFFF]))
        return self.pairs[key]

    def trim(self) -> None:
        if len(self) + len(self.pairs) > HOLD:
            self.clear()
            self.__init__()


HEURISTICS = ("symbols", "repeats", "shouting", "prose", "word_length", "length")


def measure(text: str | None, shapes: Shapes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """One vote a heuristic (1 good, -1 bad, 0 none), and the hashed features with their values.

    Features are the shares of word shapes, of their pairs, of repeated words and of function words.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if n == 0:
        return (0,) * (len(HEURISTICS) - 1) + (-1,), np.zeros(0, np.int64), np.zeros(0)
    data = np.frombuffer(raw, np.uint8)
    chars = int(_LEAD[data].sum() - _SPACE[data].sum())
    codes = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    number, function = codes >> 1, int((codes & 1).sum())
    again = sum(map(operator.eq, words, words[1:]))
    upper = int(_UPPER[data].sum()) + int(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).sum())
    symbols, marks = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) / chars, raw.count(b"!") / n
    same, common_words, capitals, ends, mean = again / n, function / n, upper / chars, len(_ENDS.findall(raw)) / n, chars / n

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    found = (
        vote(symbols > 0.05, False),
        vote(same > 0.1, False),
        vote(capitals > 0.4 or marks > 0.2, False),
        vote(n >= 20 and common_words < 0.02, common_words > 0.05 and 0.01 < ends < 0.3),
        vote(mean > 12 or mean < 2.5, 3.5 < mean < 8),
        vote(n < 3, n >= 20),
    )
    one, k = np.unique(number, return_counts=True)
    two, m = np.unique((np.concatenate([np.zeros(1, np.int64), number[:-1]]) << 32) | number, return_counts=True)
    at = [shapes.single[x] for x in one.tolist()] + [shapes.pair(x) for x in two.tolist()]
    value = [k, m]
    for name, times in (("again", again), ("function", function)):
        if times:
            at.append(hashed(name))
            value.append(np.array([times]))
    return found, np.array(at, np.int64), np.concatenate(value) / n


def pattern_of(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


class LabelModel:
    """Naive-Bayes label model with two classes, bad and good, fitted by EM on counted vote patterns."""

    def fit(self, votes_: np.ndarray, n: np.ndarray, steps: int = EM_STEPS) -> LabelModel:
        """votes_: patterns by heuristics, in -1, 0, 1; n: documents of each."""
        k = votes_.shape[1]
        hot = np.stack([votes_ == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, heuristic, vote
        # Which class is which: to start with, a document is bad if any heuristic says so.
        q = np.where((votes_ < 0).any(1), 0.1, 0.95)
        for _ in range(steps):
            w = np.stack([(1 - q) * n, q * n])
            self.prior = (w.sum(1) + 1) / (w.sum() + 2)
            self.table = (np.einsum("cp,phv->chv", w, hot) + 0.5) / (w.sum(1)[:, None, None] + 1.5)
            # A vote speaks for the class that it names, or for none: the heuristics are better than chance.
            for vote, own in ((0, 0), (2, 1)):
                flat = self.table[:, :, vote].mean(0)
                wrong = self.table[own, :, vote] < self.table[1 - own, :, vote]
                self.table[:, wrong, vote] = flat[wrong]
            self.table /= self.table.sum(2, keepdims=True)
            new = self.posterior(votes_)
            if np.abs(new - q).max() < 1e-10:
                break
            q = new
        assert self.table.shape == (2, k, 3)
        return self

    def posterior(self, votes_: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + sum(np.log(self.table[:, h, votes_[:, h] + 1]) for h in range(votes_.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Of each heuristic: how often a vote agrees with the class."""
        right = self.prior[0] * self.table[0, :, 0] + self.prior[1] * self.table[1, :, 2]
        wrong = self.prior[0] * self.table[0, :, 2] + self.prior[1] * self.table[1, :, 0]
        return right / (right + wrong)


def pattern_votes(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 - 1 for i in range(len(HEURISTICS))], 1)


def vote_table(documents: DataFrame) -> DataFrame:
    """doc_id and pattern of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            shapes.trim()
            got = [pattern_of(measure(t, shapes)[0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.int64())], ["doc_id", "pattern"])

    return documents.mapInArrow(run, "doc_id long, pattern long")


def train(sample: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by gradient steps over the whole sample with per-feature rates."""
    w, b = np.zeros(FEATURES), 0.0
    if not sample:
        return w, b
    row = np.repeat(np.arange(len(sample)), [len(a) for a, _ in sample])
    at, value = np.concatenate([a for a, _ in sample]), np.concatenate([v for _, v in sample])
    past, past_b = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(row, value * w[at], len(sample)) + b
        off = (1 / (1 + np.exp(-z)) - target) / len(sample)
        g = np.bincount(at, value * off[row], FEATURES) + DECAY * w
        past += g * g
        past_b += off.sum() ** 2
        w -= RATE * g / np.sqrt(past)
        b -= RATE * off.sum() / np.sqrt(past_b)
    return w, b


def classify(documents: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, pattern, posterior (of good, by the label model), score (log-odds of the scorer) and kept.

    Null texts are empty; texts without words are never kept. Repeated
    rows count and are scored each by itself. With an empty table the result is
    empty. Extra columns are not read.
    """
    spark = common.session(documents)
    scratch = scratch or common.Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted = scratch.save(vote_table(docs))
    counts = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toArrow()
    patterns, n = counts.column("pattern").to_numpy(), counts.column("n").to_numpy().astype(np.float64)
    model = LabelModel().fit(pattern_votes(patterns), n) if len(patterns) else None
    posterior = dict(zip(patterns.tolist(), model.posterior(pattern_votes(patterns)).tolist(), strict=True)) if model else {}

    # The sample counts texts, not rows: one of a million equal rows is one.
    keyed = docs.withColumn("tid", F.xxhash64("text"))
    chosen = keyed.select("doc_id", "tid").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "tid").limit(TRAIN_ROWS)
    texts = keyed.join(F.broadcast(chosen), ["doc_id", "tid"], "left_semi").dropDuplicates(["doc_id", "tid"])  # at most TRAIN_ROWS

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            shapes.trim()
            got = [measure(t, shapes) for t in batch.column("text").to_pylist()]
            p = [posterior.get(pattern_of(v), 0.5) for v, _, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(p, pa.float64()), pa.array([a for _, a, _ in got], pa.list_(pa.int64())), pa.array([x for _, _, x in got], pa.list_(pa.float64()))], ["doc_id", "tid", "p", "at", "value"])

    sample = texts.mapInArrow(featured, "doc_id long, tid long, p double, at array<long>, value array<double>").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("tid", "ascending")])  # reruns agree
    sample = {c: [np.asarray(x) for x in sample.column(c).to_pylist()] if c in ("at", "value") else sample.column(c).to_numpy() for c in ("p", "at", "value")}
    weights, bias = train([(np.asarray(a, np.int64), np.asarray(v)) for a, v in zip(sample["at"], sample["value"], strict=True)], sample["p"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            shapes.trim()
            got = [measure(t, shapes) for t in batch.column("text").to_pylist()]
            v = [pattern_of(x) for x, _, _ in got]
            s = [float(value @ weights[at]) + bias if len(at) else NO_WORDS for _, at, value in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(v, pa.int64()), pa.array([posterior.get(x, 0.5) for x in v], pa.float64()), pa.array(s, pa.float64())], ["doc_id", "pattern", "posterior", "score"])

    scores = scratch.save(docs.mapInArrow(scored, "doc_id long, pattern long, posterior double, score double"))
    # The cutoff loses at most REJECT of the documents that the label model holds to be good, and is never above even odds.
    low = scores.where(f"posterior >= 0.9 and score > {NO_WORDS}").agg(F.percentile_approx("score", F.lit(REJECT), F.lit(10000))).first()[0]
    cutoff = max(min(0.0, low), NO_WORDS + 1) if low is not None else 0.0
    return scores.withColumn("kept", F.col("score") >= F.lit(float(cutoff)))
