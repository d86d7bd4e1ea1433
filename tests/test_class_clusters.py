"""Clusters by classes of offers, against the SQL and the dense form of complete linkage."""

import duckdb
import numpy as np
import pytest

from sievework.operators import cluster, msm
from sievework.plans import catalogue

from .test_entry import SF, rows


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT p.* REPLACE (p_partkey + 200 * r AS p_partkey) FROM '{SF}/part.parquet' p, range(3) t(r)) TO '{folder}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["q_clusters", "q_cluster_violations", "q_tuning", "q_tuning_best"])
def test_repeated_offers_agree_with_sql(spark, repeated, monkeypatch, name):
    folder, con = repeated
    # Neither pairs of offers nor a distance of every two of a component.
    monkeypatch.setattr(msm, "block", None)
    monkeypatch.setattr(cluster, "complete_linkage", None)
    assert rows(catalogue.QUERIES[name](spark, folder).toPandas()) == rows(con.sql(catalogue.ORACLE_SQL[name]).df())


def test_linkage_is_complete_linkage():
    rng = np.random.default_rng(0)
    for trial in range(200):
        kinds, n = rng.integers(1, 8), rng.integers(1, 25)
        classes, shops = rng.integers(0, kinds, n), rng.integers(0, (3, 50)[trial % 2], n)
        pairs = [(a, b) for a in range(kinds) for b in range(a, kinds) if rng.random() < 0.7] or [(0, 0)]
        i, j = np.array(pairs).T
        distance = rng.integers(1, 100 if trial % 3 else 4, len(i)) / 100
        known = {frozenset(p): d for p, d in zip(pairs, distance, strict=True)}
        every = [[known.get(frozenset((classes[x], classes[y])), np.inf) if shops[x] != shops[y] else np.inf for y in range(n)] for x in range(n)]
        linked, merges = cluster.linkage(classes, shops, i, j, distance)
        assert sorted(merges) == sorted(cluster.complete_linkage(np.array(every)))
        assert (linked == np.isfinite(every).any(1)).all()


def test_violations_are_seen(spark, repeated):
    found, scored = catalogue._class_edges(spark, repeated[0])
    clustered = catalogue.classes.clusters(scored, found, (0.9,))
    assert catalogue.classes.violations(clustered, scored, found).count() == 0
    one = clustered.withColumn("cluster_id", catalogue.F.lit(0).cast("long"))
    assert catalogue.classes.violations(one, scored, found).count() > 0
