"""Blocking, similarity, clustering and evaluation on small fixtures, against brute force where there is one."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import cluster, evaluate, lookup, lsh, msm, sampling, store
from sievework.sources import products

ROWS = "pid long, shop string, brand string, model_id string, title string, words array<string>, features map<string,string>"


def make(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_signature_prefix_gives_the_same_buckets(spark):
    df = make(spark, [(i, "s", "b", "m", "t", w, {}) for i, w in enumerate([["a", "b"], ["a", "b"], ["c"], []])])
    few = lsh.candidates(lsh.bands(lsh.signatures(df, 10), 5, 2))
    assert [(r["i"], r["j"]) for r in few.collect()] == [(0, 1)]
    signed = {r["pid"]: r["signature"] for r in lsh.signatures(df, 10).collect()}
    assert signed[0] == signed[1] and signed[3] == [0] * 10
    assert lsh.bands(lsh.signatures(df, 10), 5, 2, "drop").where("pid = 3").count() == 0


def test_last_band_takes_the_rest(spark):
    df = make(spark, [(0, "s", "b", "m", "t", ["a"], {})])
    assert lsh.bands(lsh.signatures(df, 7), 3, 2).count() == 3


def test_blocking_treats_missing_brands_as_equal(spark):
    df = make(spark, [(0, "x", None, "m", "t", [], {}), (1, "y", None, "m", "t", [], {}), (2, "y", "b", "m", "t", [], {}), (3, "x", None, "m", "t", [], {})])
    got = msm.block(lsh.true_pairs(df), df)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(0, 1), (1, 3)]


def test_edges_of_equal_and_contradicting_products(spark):
    f = {"brand": "lg", "size class": "55inch"}
    df = make(
        spark,
        [(0, "x", "lg", "m", "a", ["55inch"], f), (1, "y", "lg", "m", "a", ["55inch"], f), (2, "z", "lg", "m", "lg 46 led", ["46inch"], {"brand": "lg"}), (3, "w", "lg", "m", "lg 55 led", [], {"brand": "lg"}), (4, "v", "lg", "n", "", [], {})],
    )
    pairs = spark.createDataFrame([(0, 1), (2, 3), (3, 4)], "i long, j long")
    got = {(r["i"], r["j"]): r["dist"] for r in msm.edges(pairs, df).collect()}
    # One shared word over lengths 1 and 1 is above alpha: certain, all attributes match.
    assert got[0, 1] == pytest.approx(0.0)
    # Numbers contradict each other: 0.5 * 1 + 0.5 * -1 for one matched attribute of one.
    assert got[2, 3] == pytest.approx(1 - (0.5 * 1 + 0 * 0 + 0.5 * -1))
    assert got[3, 4] == pytest.approx(1.0)
    cut = {(r["i"], r["j"]): r["dist"] for r in msm.edges(pairs, df, truncate_distances=True).collect()}
    assert cut[0, 1] == 0 and cut[2, 3] == 1


def test_complete_linkage_against_naive():
    rng = np.random.default_rng(0)
    for n in (2, 5, 9):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        groups = [{i} for i in range(n)]
        heights = []
        while len(groups) > 1:
            w, a, b = min((max(d[x, y] for x in groups[a] for y in groups[b]), a, b) for a, b in itertools.combinations(range(len(groups)), 2))
            heights.append(w)
            groups[a] |= groups.pop(b)
        assert [m[0] for m in cluster.complete_linkage(d)] == pytest.approx(heights)


def test_clusters_are_cliques_and_partition(spark):
    rng = random.Random(1)
    rows = [(i, j, rng.random() * 1.2) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.6]
    edges = spark.createDataFrame(rows, "i long, j long, dist double")
    got = store.written(cluster.clusters(edges, (0.3, 0.9)))
    assert cluster.violations(got, edges).count() == 0
    assert got.groupBy("eps", "pid").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        cluster.clusters(edges, (1.5,))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "i long, j long")
    got = {r["pid"]: r["component"] for r in cluster.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_samples(spark):
    df = make(spark, [(i * 10, "s", "b", "m", "t", [], {}) for i in range(50)])
    df = df.drop("features")
    s = sampling.bootstrap(df, 0.5, 3).cache()
    assert s.groupBy("boot_id").count().collect()[0]["count"] == 25 and s.count() == 75
    assert s.exceptAll(sampling.bootstrap(df, 0.5, 3)).count() == 0
    assert s.exceptAll(sampling.bootstrap(df, 0.5, 3, seed=1)).count() > 0
    left = sampling.out_of_bag(df, s)
    assert left.join(s.select("boot_id", F.col("source_pid").alias("pid")), ["boot_id", "pid"]).count() == 0
    parts = {r["part"]: r["count"] for r in sampling.split(df).groupBy("part").count().collect()}
    assert sum(parts.values()) == 50 and parts["train"] > parts["test"]
    assert [r["position"] for r in sampling.with_position(df).orderBy("pid").collect()] == list(range(50))


def test_scores_and_best_threshold(spark):
    rows = spark.createDataFrame([(0.1, 4, 2, 2, 2, 10), (0.9, 4, 2, 2, 2, 10), (0.5, 0, 0, 0, 4, 10)], "eps double, found long, tp long, fp long, fn long, n long")
    got = evaluate.best(evaluate.scored(rows)).first()
    assert got["eps"] == 0.9 and got["f1_star"] == pytest.approx(0.5) and got["fraction"] == pytest.approx(4 / 45)
    assert evaluate.scored(rows).where("eps = 0.5").first()["f1_star"] == 0


def test_lookups(spark):
    df = make(spark, [(3, "x", None, "m", "t", [], {"b": "2", "a": "2"}), (1, "y", None, "m", "t", [], {})])
    assert lookup.pid_by_title(df, "t") == 1
    with pytest.raises(ValueError):
        lookup.pid_by_title(df, "none")
    row = df.where("pid = 3").select(lookup.value_set(F.col("features")), F.transform(F.map_entries("features"), lookup.entry_key)).first()
    assert row[0] == ["2"] and sorted(row[1]) == ["a", "b"]


def test_json_source(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"k": [{"modelID": "m1", "shop": "a", "title": "T", "url": "u", "featuresMap": {"Brand": "LG"}}], "l": [{"modelID": "m2", "shop": "b"}, {"modelID": "m0"}]}')
    got = products.read_json(spark, str(tmp_path / "p.json")).orderBy("pid").collect()
    assert [(r["pid"], r["model_id"]) for r in got] == [(0, "m0"), (1, "m1"), (2, "m2")] and got[1]["features"] == {"Brand": "LG"}
