"""Offers that repeat under other keys: scored once a pair of contents, with the results of the SQL."""

import duckdb
import pytest

from sievework.operators import msm
from sievework.plans import catalogue

from .test_entry import SF, rows

TIMES = 8


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT p.* REPLACE (p_partkey + 200 * r AS p_partkey) FROM '{SF}/part.parquet' p, range({TIMES}) t(r)) TO '{folder}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["q_msm_edges", "q_msm_edges_truncated", "q_value_sim", "q_components", "q_avg_levenshtein", "q_title_sim", "q_block_pairs"])
def test_repeated_offers_agree_with_sql(spark, repeated, monkeypatch, name):
    folder, con = repeated
    seen = {}
    # The work is over pairs of contents, fewer than the pairs that result.
    for step in ("block", "value_similarities", "title_similarity"):
        run = getattr(msm, step)
        monkeypatch.setattr(msm, step, lambda first, *rest, step=step, run=run: (seen.update({step: first.count()}), run(first, *rest))[1])
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert len(want) > 100 and rows(got) == rows(want)
    blocked = con.sql(f"SELECT count(*) FROM ({catalogue.ORACLE_SQL['q_block_pairs']})").fetchall()[0][0]
    assert "block" not in seen and all(n < blocked / 2 for n in seen.values())
