"""Evaluation of blocking by counts, against all pairs of the samples."""

import random
import tracemalloc

import numpy as np
import pytest

from sievework.operators import evaluate, lsh, paircounts, sampling

GRID = ((12, 1), (6, 2), (3, 4))


@pytest.fixture(scope="module")
def products(spark):
    """Copies, near copies, products of one word, of none and without a model, and models of several contents."""
    rng = random.Random(4)
    rows = []
    for pid in range(400):
        words = [[], ["a"]][pid % 2] if pid % 11 == 0 else rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 6))
        rows.append((pid, None if pid % 13 == 0 else f"m{rng.randint(0, 60)}", sorted(words)))
    rows += [(1000 + k, *rows[k % 5][1:]) for k in range(100)]
    return spark.createDataFrame(rows, "pid long, model_id string, words array<string>")


@pytest.mark.parametrize("hot", [1, 8, 256])
def test_counts_are_those_of_all_pairs(spark, products, monkeypatch, hot):
    monkeypatch.setattr(paircounts, "HOT", hot)
    monkeypatch.setattr(paircounts, "EXPANDED", 50)
    monkeypatch.setattr(paircounts, "AT_ONCE", 7)
    # No row a pair.
    monkeypatch.setattr(lsh, "candidates", None)
    monkeypatch.setattr(lsh, "true_pairs", None)
    got = {(r["boot_id"], r["bands"], r["rows"]): (r["tp"], r["fp"], r["fn"], r["fraction"]) for r in evaluate.evaluate_lsh(products, lambda p: sampling.bootstrap(p, 0.9, 2), GRID).collect()}
    signs = {r["pid"]: np.array(r["signature"]) for r in lsh.signatures(products, 12).collect()}
    want = {}
    for boot in (0, 1):
        sample = sampling.bootstrap(products, 0.9, 2).where(f"boot_id = {boot}").collect()
        for b, r in GRID:
            tp = found = true = 0
            for k, x in enumerate(sample):
                for y in sample[:k]:
                    same = x["model_id"] is not None and x["model_id"] == y["model_id"]
                    met = (signs[x["source_pid"]] == signs[y["source_pid"]]).reshape(b, r).all(1).any()
                    tp, found, true = tp + (same and met), found + met, true + same
            want[boot, b, r] = (tp, found - tp, true - tp, pytest.approx(found / (len(sample) * (len(sample) - 1) / 2)))
    assert got == want


def test_no_products(spark):
    none = spark.createDataFrame([], "pid long, model_id string, words array<string>")
    assert evaluate.evaluate_lsh(none, lambda p: sampling.bootstrap(p, 0.9, 2), GRID).count() == 0


def test_minima_of_many_words_take_little_memory():
    rng = np.random.default_rng(5)
    at = np.cumsum([0, 0, 3, 9_000, 1, 0, 200, 12_000, 70_000, 0])
    every = rng.integers(0, 1 << 28, at[-1])
    a, c = (np.array(x, np.int64)[:, None] for x in zip(*lsh.coefficients(600), strict=True))
    every[0], every[1] = 0, (1 << 28) - 1
    tracemalloc.start()
    got = lsh.minima(at, every, a, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for h in range(0, 600, 37):
        values = [(int(a[h, 0]) * x + int(c[h, 0])) % lsh.PRIME for x in every.tolist()]
        assert got[:, h].tolist() == [min(values[i:j], default=0) for i, j in zip(at, at[1:])]
    assert peak < 8 << 20  # 91,204 words by 600 functions at once would take 438 MB
