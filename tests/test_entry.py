"""The registered queries against their SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAST = ["q_drop_column", "q_title_clean", "q_map_backfill", "q_brand_fill", "q_model_words", "q_minhash", "q_bootstrap", "q_qgram", "q_msm_edges", "q_components", "q_plot_series"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    tidy = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(map(tidy, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = sql.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_queries_without_the_training_data_part(tmp_path, also):
    """A copy without the subpackage, with and without the pipeline's file, keeps all other queries."""
    top = Path(entry.__file__).parent
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if f not in also and (top / f).exists():
            shutil.copy(top / f, tmp_path)
    shutil.copytree(top / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "sievework/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), *sorted({x.split('_')[0] for x in e.queries()}), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(sum(x.startswith("q_") for x in entry.queries())), "q", "True"]
