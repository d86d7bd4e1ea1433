"""What keeps scoring and training of the language model short leaves their results as they are."""

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import lm_score


def test_elements_of_a_column():
    column = pa.array([b"a", b"", b"\xff\x00b", b"cc"], pa.binary())
    assert lm_score._elements(column) == column.to_pylist() and lm_score._elements(column[1:3]) == [b"", b"\xff\x00b"]
    assert lm_score._elements(column[:0]) == [] and lm_score._elements(pa.array([b""], pa.binary())) == [b""]


@pytest.mark.parametrize("scale", [0.1, 30.0])
def test_scores_are_log_probabilities(scale):
    """With scores beyond 80 as well, where exponentials could overflow."""
    rng = np.random.default_rng(2)
    model = lm_score.LogBilinear(rng.integers(1, 50, 90).astype(float))
    for name in (*model.TABLES, "top"):
        setattr(model, name, rng.normal(0, scale, getattr(model, name).shape).astype(np.float32))
    x, y, z = rng.integers(0, 90, (3, 500))
    ctx, c = (model.first[x] + model.second[y]).astype(float), model.class_of[z]
    want = np.empty(500)
    for k in range(500):
        own = slice(model.edge[c[k]], model.edge[c[k] + 1])
        parts = ((model.top @ ctx[k] + model.top_bias, c[k]), (model.out[own] @ ctx[k] + model.out_bias[own], z[k] - own.start))
        want[k] = sum(v[at] - v.max() - np.log(np.exp(v - v.max()).sum()) for v, at in parts) / np.log(10)
    assert model.log10(x, y, z) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_products_take_the_biases(monkeypatch):
    """No pass over all scores for their range where lengths tell that none is beyond 80."""
    model = lm_score.LogBilinear(np.arange(1.0, 91))
    seen = []
    run = lm_score._log_softmax
    monkeypatch.setattr(lm_score, "_log_softmax", lambda scores, at, *safe: (seen.append(safe), run(scores, at, *safe))[1])
    model.log10(*np.random.default_rng(3).integers(0, 90, (3, 100)))
    assert seen and set(seen) == {(True,)}


def test_a_step_tells_how_often_it_used_a_row():
    model = lm_score.LogBilinear(np.arange(1.0, 91))
    row, times = model._step("first", np.array([3, 1, 3, 3]), np.ones((4, lm_score.DIMS), np.float32))
    assert row.tolist() == [1, 3] and times.tolist() == [1, 3]
    rng = np.random.default_rng(4)
    model.fit(*rng.integers(0, 90, (3, 2000)), rng)
    assert model.used.sum() == 2000 * (1 + lm_score.NOISE_WITHIN)
