"""Pairs of offers that LSH finds, made by blocks, against the SQL."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from sievework.operators import classes, closeness, lsh, msm
from sievework.plans import catalogue

from .test_class_clusters import repeated  # noqa: F401
from .test_entry import rows


@pytest.mark.parametrize("name", ["q_lsh_msm_edges", "q_lsh_msm_edges_truncated", "q_lsh_title_sim", "q_lsh_components", "q_lsh_block_pairs", "q_lsh_value_sim"])
def test_repeated_offers_agree_with_sql(spark, repeated, monkeypatch, name):  # noqa: F811
    folder, con = repeated
    # Small blocks, members of a class in several, and neither rows of candidate pairs nor of pairs of words.
    for module, limit, value in ((closeness, "OFFERS", 7), (closeness, "EXPANDED", 50), (classes, "BLOCK", 2)):
        monkeypatch.setattr(module, limit, value)
    for module, step in ((lsh, "candidates"), (msm, "title_similarity"), (msm, "value_similarities")):
        monkeypatch.setattr(module, step, None)
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert len(want) > 100 and rows(catalogue.QUERIES[name](spark, folder).toPandas()) == rows(want)


def test_rounding_is_half_up():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.random(2000), rng.integers(-4096, 4096, 2000) / 4096, rng.integers(-99999, 99999, 2000) / 1e7, [0.0, -0.0, 1.0, -1.0]])
    for digits in (6, 9):
        want = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        assert closeness.rounded(values, digits).tolist() == want
