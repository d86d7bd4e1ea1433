"""Queries over LSH candidates, against the SQL of the known pairs with the candidates in their place."""

import hashlib
import os

import duckdb
import pytest

from sievework.operators import lsh
from sievework.plans import catalogue
from sievework.plans import oracle as O  # noqa: E741

from .test_entry import SF, rows


@pytest.fixture(scope="module")
def candidates(spark):
    """Pairs that share a band of minima, hash by hash over all pairs."""
    clean = catalogue._cleaned(spark, SF).select("pid", "words").collect()
    signs = {}
    for r in clean:
        ids = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in r["words"]]
        signs[r["pid"]] = [min(((a * x + c) % lsh.PRIME for x in ids), default=0) for a, c in lsh.coefficients(catalogue.BANDS * catalogue.ROWS)]
    parts = {p: [tuple(s[k : k + catalogue.ROWS]) for k in range(0, len(s), catalogue.ROWS)] for p, s in signs.items()}
    return [(i, j) for i in parts for j in parts if i < j and any(x == y for x, y in zip(parts[i], parts[j], strict=True))]


@pytest.fixture(scope="module")
def sql(candidates):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    con.execute("CREATE TABLE cand (i BIGINT, j BIGINT)")
    con.executemany("INSERT INTO cand VALUES (?, ?)", candidates)
    return con


@pytest.mark.parametrize("name", ["block_pairs", "value_sim", "title_sim", "msm_edges", "msm_edges_truncated", "components"])
def test_query_agrees_with_sql_over_candidates(spark, sql, name):
    text = catalogue.ORACLE_SQL[f"q_{name}"]
    assert O.TRUE_OFFERS in text
    got = catalogue.QUERIES[f"q_lsh_{name}"](spark, SF).toPandas()
    assert rows(got) == rows(sql.sql(text.replace(O.TRUE_OFFERS, "pairs AS (SELECT i, j FROM cand)")).df())


def test_tuning_counts_false_positives(spark, candidates):
    clean = {r["pid"]: r["model_id"] for r in catalogue._cleaned(spark, SF).select("pid", "model_id").collect()}
    clustered = catalogue.q_clusters(spark, SF).collect()
    tuned = catalogue.q_tuning(spark, SF).collect()
    assert any(r["fp"] for r in tuned)
    true = sum(clean[i] == clean[j] for i, j in candidates)
    for r in tuned:
        name = {c["pid"]: c["cluster_id"] for c in clustered if c["eps"] == r["eps"]}
        inside = [(i, j) for i, j in candidates if i in name and name[i] == name.get(j)]
        tp = sum(clean[i] == clean[j] for i, j in inside)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, len(inside) - tp, true - tp)


def test_series_of_baseline_and_clustering_are_their_own(spark, monkeypatch):
    assert catalogue.evaluate.GRID[0] == (300, 2) and len(catalogue.evaluate.GRID) == 10 and catalogue.FULL_SAMPLES == 5
    grid, seen = ((30, 2), (6, 10)), []
    monkeypatch.setattr(catalogue.evaluate, "GRID", grid)
    monkeypatch.setattr(catalogue, "FULL_SAMPLES", 2)
    sample = catalogue.sampling.bootstrap
    monkeypatch.setattr(catalogue.sampling, "bootstrap", lambda p, ratio, number: seen.append(number) or sample(p, ratio, number))
    got = {}
    for r in catalogue.q_plot_series_full(spark, SF).collect():
        got.setdefault((r["series"], r["metric"]), set()).add((r["x"], r["y"]))
    assert set(got) == {*((s, m) for s in ("improved", "baseline") for m in ("pc", "pq", "f1_star")), ("improved", "f1")} and seen == [2, 2, 2]
    for series, products in (("improved", catalogue._cleaned(spark, SF)), ("baseline", catalogue.words.clean_products_baseline(catalogue.products.offers(spark, SF)))):
        rows = [r.asDict() for r in sample(products.select("pid", "model_id", "words"), catalogue.RATIO, 2).collect()]
        # The coarse configuration by brute force.
        shares, n = [], len(rows) // 2
        for boot in (0, 1):
            signs = []
            for r in (r for r in rows if r["boot_id"] == boot):
                ids = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in r["words"]]
                signs.append([min(((a * x + c) % lsh.PRIME for x in ids), default=0) for a, c in lsh.coefficients(60)])
            shares.append(sum(any(x[k : k + 2] == y[k : k + 2] for k in range(0, 60, 2)) for k0, x in enumerate(signs) for y in signs[:k0]) / (n * (n - 1) / 2))
        assert max(x for x, _ in got[series, "pq"]) == pytest.approx(sum(shares) / 2, abs=1e-6)
    assert got["improved", "f1_star"] != got["baseline", "f1_star"] and got["improved", "f1"] != got["improved", "f1_star"]


def test_series_of_blocking_spread_the_offers(spark, monkeypatch):
    offers, seen = catalogue.products.offers, []
    monkeypatch.setattr(catalogue.products, "offers", lambda spark, sf_dir, spread=False: seen.append(spread) or offers(spark, sf_dir, spread))
    catalogue.q_plot_series(spark, SF)
    assert seen == [True, True]
