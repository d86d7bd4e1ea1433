"""Quality rules with risk-controlled thresholds.

Every rule turns a text into a score that is higher for worse texts. A labelled
holdout then decides how strict the rules may be in each stratum (language):
sets of cutoffs are tried in a sequence from the loosest to the strictest, and a
set is accepted while the exact (Clopper-Pearson) upper bound of the share of good
documents that it rejects, by any rule, stays below the limit. Testing ends with
the first set that isn't accepted, so it needs no correction within a stratum; the
Bonferroni correction is over tested strata. Which rule is made stricter next
follows from the labelled documents of quality 0 only, not from those of the tests.

A stratum with too few good documents to pass even without a false rejection is
pooled with the next smallest until the pool has enough (299 for one tested
stratum, 436 for four); the limit then holds over the pool. If all labelled
documents together are too few, no rule rejects, nor does one in a stratum without
labelled good documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BASE_RULE = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
#: Of good documents, at most this share may be rejected by all rules together,
#: with a probability of 1 - DELTA over all tested strata.
ALPHA, DELTA = 0.01, 0.05

#: name: (score, cutoffs from the loosest to the strictest). A document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("- word_chars / greatest(n_words, 1)", (-1.5, -2.0, -2.5, -3.0, -3.5, -4.0)),
}

_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: str | None) -> tuple[int, ...]:
    """METRICS of one text; a null counts as an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if n else []
    covered = 0
    if n > WINDOW:
        h = common.window_hashes(common.word_hashes(words), WINDOW)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count[back] > 1
        if again.any():
            step = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            covered = int((np.cumsum(step[:n]) > 0).sum())
    chars = int(_LEAD[data].sum() - _SPACE[data].sum())
    return n, chars, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), covered, len(lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([measure(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(METRICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c) for c in got.T)], ["doc_id", "lang", *METRICS])


def metrics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, METRICS and base_failed of every document; one pass, no shuffle."""
    common.session(documents)
    kept = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    out = kept.mapInArrow(_measured, "doc_id long, lang string, " + ", ".join(f"{m} long" for m in METRICS))
    return out.withColumn("base_failed", F.expr(BASE_RULE))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, exact up to rounding."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def passes(rejected: int, good: int, alpha: float, delta: float) -> bool:
    """Whether the Clopper-Pearson upper bound at 1 - delta of rejected / good is at most alpha."""
    if good == 0 or rejected > alpha * good:
        return False
    return binomial_cdf(rejected, good, alpha) <= delta


def least_good(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good documents with which a stratum passes if none is rejected, with so many tested strata."""
    return math.ceil(math.log(delta / strata) / math.log1p(-alpha))


def pools(good: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> list[list[str]]:
    """Strata that are tested together: the two smallest are joined while the smallest has too few good documents."""
    out = sorted((n, [s]) for s, n in good.items())
    while len(out) > 1 and out[0][0] < least_good(len(out), alpha, delta):
        (n, a), (m, b), *rest = out
        out = sorted([(n + m, sorted(a + b)), *rest])
    return [s for _, s in out]


def choose(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> list[int]:
    """How many of each rule's cutoffs are accepted, from the loosest on.

    ``levels`` has the number of cutoffs of each rule that the documents of a row
    exceed, ``good`` and ``bad`` how many documents these are. The next step goes to
    the rule that can still catch most bad documents, of equal ones to the one with
    the fewest steps. Once no rule can catch more of them, the sequence is left
    before the first step that rejects a further good document.
    """
    sizes = np.array([len(cuts) for _, cuts in RULES.values()])
    now, hit = np.zeros(len(sizes), np.int64), np.zeros(len(good), bool)
    while (now < sizes).any():
        gain = [int(bad[~hit & (levels[:, r] > 0)].sum()) for r in range(len(sizes))]
        r = min(np.flatnonzero(now < sizes), key=lambda r: (-gain[r], now[r], r))
        more = hit | (levels[:, r] >= sizes[r] - now[r])
        if not passes(int(good[more].sum()), int(good.sum()), alpha, delta) or (not gain[r] and good[more & ~hit].any()):
            break
        now[r] += 1
        hit = more
    return now.tolist()


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n_good, n_pool and one cutoff per rule (null: none) from labelled documents.

    Good: every label of the document has quality 1 and toxic 0; n_good counts those
    of the stratum that pass the base rule, n_pool those of the strata tested with it.
    One aggregate with partial sums counts the documents by the cutoffs that they
    exceed; only such combinations, not documents, meet in one task.
    """
    by_doc = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    rows = measured.where("not base_failed").join(by_doc.selectExpr("doc_id", "q = 1 and t = 0 as good", "q = 0 as bad").where("good or bad"), "doc_id")
    levels = [F.expr(" + ".join(f"cast({score} > {c}D as int)" for c in cuts)).alias(f"level_{name}") for name, (score, cuts) in RULES.items()]
    combined = rows.select(stratum().alias("stratum"), *levels, F.expr("cast(good as long) as good"), F.expr("cast(bad as long) as bad"))
    counts = combined.groupBy("stratum", *(f"level_{name}" for name in RULES)).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        n_good = {s: int(n) for s, n in f.groupby("stratum")["good"].sum().items() if n}
        tested, out = pools(n_good, alpha, delta), []
        for pool in tested:
            own = f[f["stratum"].isin(pool)]
            steps = choose(own[[f"level_{name}" for name in RULES]].to_numpy(), own["good"].to_numpy(), own["bad"].to_numpy(), alpha, delta / len(tested))
            cut = [cuts[k - 1] if k else None for k, (_, cuts) in zip(steps, RULES.values(), strict=True)]
            out += [(s, n_good[s], int(own["good"].sum()), *cut) for s in pool]
        return pd.DataFrame(out, columns=["stratum", "n_good", "n_pool", *RULES])

    return counts.groupBy().applyInPandas(decide, "stratum string, n_good long, n_pool long, " + ", ".join(f"{r} double" for r in RULES))


def stratum():
    """The stratum of a document: its language; documents without one form their own."""
    return F.when(F.col("lang").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("lang")))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds n_rules_failed and kept; strata without a row in ``cuts`` have no rule to fail."""
    joined = measured.withColumn("stratum", stratum()).join(cuts.select("stratum", *(F.col(r).alias(f"cut_{r}") for r in RULES)), "stratum", "left")
    failed = sum((F.expr(f"cast(coalesce({score} > cut_{name}, false) as int)") for name, (score, _) in RULES.items()), F.lit(0))
    return joined.withColumn("n_rules_failed", failed).withColumn("kept", F.expr("not base_failed and n_rules_failed = 0"))


def apply_rules(documents: DataFrame, labels: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, the metrics, base_failed, n_rules_failed and kept of every document.

    Null and empty texts have no words and fail the base rule. Repeated rows are
    judged each by itself. Extra columns of either table are not read. With an
    empty ``labels`` only the base rule rejects.
    """
    scratch = scratch or common.Scratch(documents.sparkSession)
    measured = scratch.save(metrics(documents))
    cuts = scratch.save(cutoffs(measured, labels))
    return judge(measured, cuts).select("doc_id", *METRICS[:5], "base_failed", "kept", "n_rules_failed", F.col("n_lines"))


def keep_documents(documents: DataFrame, labels: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The documents that the rules keep, with all their columns; texts are not shuffled."""
    cuts = scratch.save(cutoffs(scratch.save(metrics(documents)), labels))
    extra = [f"__{m}" for m in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([measure(x) for x in batch.column("text").cast(pa.string()).to_pylist()], np.int64).reshape(-1, len(METRICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in got.T)], [*batch.schema.names, *extra])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(m, T.LongType()) for m in extra)])
    rows = documents.mapInArrow(run, schema).select(F.struct(*documents.columns).alias("__row"), *(F.col(f"__{m}").alias(m) for m in METRICS))
    rows = rows.withColumn("lang", F.col("__row.lang").cast("string")).withColumn("base_failed", F.expr(BASE_RULE))
    return judge(rows, cuts).where("kept").select("__row.*")
