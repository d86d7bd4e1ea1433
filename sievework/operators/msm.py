"""Multi-component similarity of candidate pairs: attributes, remaining words, titles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import similarity as S
from sievework.functions import text as T


@dataclass(frozen=True)
class Parameters:
    gamma: float = 0.7
    alpha: float = 0.5
    beta: float = 0.2
    mu: float = 0.5
    delta: float = 0.6
    epsilon: float = 0.0


def block(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs with both products, of different shops and the same brand (a missing brand equals a missing one)."""
    columns = [c for c in products.columns if c != "pid"]
    a = products.select(F.col("pid").alias("i"), *(F.col(c).alias(f"{c}_i") for c in columns))
    b = products.select(F.col("pid").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    joined = pairs.select("i", "j").join(a, "i").join(b, "j")
    return joined.where((F.col("shop_i") != F.col("shop_j")) & F.col("brand_i").eqNullSafe(F.col("brand_j")))


def key_similarities(products: DataFrame, gamma: float) -> DataFrame:
    """(key_i, key_j, key_sim) of similar attribute names; computed once over distinct names, not for every pair.

    Names that share a 3-gram meet in an equi-join. Without one, the similarity is
    the share of what a name has more characters than 3-grams (2, or all of a short
    name) in all characters; it exceeds gamma only if the excess of one name over
    gamma times its length makes up for the lack of the other.
    """
    keys = products.select(F.explode(F.map_keys("features")).alias("key")).distinct()
    gram = keys.select("key", F.explode(F.array_distinct(S.grams(F.col("key")))).alias("gram"))
    met = gram.withColumnRenamed("key", "key_i").join(gram.withColumnRenamed("key", "key_j"), "gram").select("key_i", "key_j")
    lack = keys.select("key", (gamma * F.length("key") - (F.length("key") - F.size(S.grams(F.col("key"))))).alias("lack")).withColumn("step", F.floor("lack").cast("long"))
    least = lack.agg(F.min("step").alias("least"))
    over = lack.where("lack < 0").join(F.broadcast(least)).select("key", "lack", F.explode(F.sequence(F.col("least"), F.floor(-F.col("lack")).cast("long"))).alias("step"))  # one row
    odd = over.select(F.col("key").alias("key_i"), F.col("lack").alias("lack_i"), "step").join(lack.withColumnRenamed("key", "key_j"), "step").where("lack_i + lack < 1e-9")
    odd = odd.select(F.explode(F.array(F.struct("key_i", "key_j"), F.struct(F.col("key_j").alias("key_i"), F.col("key_i").alias("key_j")))).alias("p")).select("p.*")
    both = met.unionByName(odd).distinct()
    return both.withColumn("key_sim", S.qgram_similarity(F.col("key_i"), F.col("key_j"))).where(F.col("key_sim") > gamma)


def value_similarities(blocked: DataFrame, products: DataFrame, gamma: float) -> DataFrame:
    """(i, j, mk_sim, nmk_sim, matches) of blocked pairs.

    Attributes with similar names are matched, many to many; what the others
    hold counts by the model words in it.
    """
    left = blocked.select("i", "j", F.explode_outer("features_i").alias("key_i", "value_i"))
    # All keys of the other side stand beside each key, so similar names are an ordinary equi-join.
    both = left.join(blocked.select("i", "j", "features_j"), ["i", "j"]).select("i", "j", "key_i", "value_i", F.explode_outer("features_j").alias("key_j", "value_j"))
    matched = both.join(key_similarities(products, gamma), ["key_i", "key_j"])
    met = matched.select("value_i", "value_j").where("value_i is not null and value_j is not null").distinct()
    matched = matched.join(met.withColumn("value_sim", S.qgram_similarity(F.col("value_i"), F.col("value_j"))), ["value_i", "value_j"], "left")  # once a pair of values
    sums = matched.groupBy("i", "j").agg(
        F.sum(F.col("key_sim") * F.coalesce("value_sim", F.lit(0.0))).alias("total"), F.sum("key_sim").alias("weight"), F.count(F.lit(1)).alias("matches"),
        F.collect_set("key_i").alias("used_i"), F.collect_set("key_j").alias("used_j"),
    )
    rows = blocked.join(sums, ["i", "j"], "left")

    def rest(side: str):
        used = F.coalesce(f"used_{side}", F.array().cast("array<string>"))
        values = F.map_values(F.map_filter(f"features_{side}", lambda k, v: ~F.array_contains(used, k) & v.isNotNull()))
        return F.filter(F.array_distinct(F.col(f"words_{side}")), lambda w: F.exists(values, lambda v: F.contains(v, w)))

    return rows.withColumn("mk_sim", S.ratio(F.col("total"), F.col("weight"))).withColumn("nmk_sim", S.jaccard(rest("i"), rest("j"))).withColumn("matches", F.coalesce("matches", F.lit(0))).drop("total", "weight", "used_i", "used_j")


def title_similarity(rows: DataFrame, p: Parameters) -> DataFrame:
    """Adds title_sim: 1 for near-equal titles, -1 for titles whose numbers contradict each other, else a blend."""

    def words(side: str):
        return F.transform(T.tokens(F.col(f"title_{side}")), lambda w: F.struct(w.alias("w"), T.numeric_part(w).alias("num"), T.other_part(w).alias("rest")))

    keys = ["i", "j"]
    cosine = S.title_cosine(F.col("title_i"), T.tokens(F.col("title_i")), F.col("title_j"), T.tokens(F.col("title_j")))
    rows = rows.withColumn("cosine", cosine)
    open_rows = rows.where(F.col("cosine") <= p.alpha)
    pairs = open_rows.select(*keys, F.explode(words("i")).alias("a"), words("j").alias("b")).select(*keys, "a", F.explode("b").alias("b"))
    weight = F.length("a.w") + F.length("b.w")
    same_number = F.col("a.num") == F.col("b.num")
    pairs = pairs.withColumn("rest_sim", S.levenshtein_similarity(F.col("a.rest"), F.col("b.rest"))).withColumn("word_sim", S.levenshtein_similarity(F.col("a.w"), F.col("b.w"))).withColumn("weight", weight)
    near = (F.col("rest_sim") >= p.alpha) & same_number
    sums = pairs.groupBy(*keys).agg(
        F.max((F.col("rest_sim") >= 1 - p.epsilon) & ~same_number).alias("veto"),
        F.sum(F.col("word_sim") * F.col("weight")).alias("all_sum"), F.sum("weight").alias("all_weight"),
        F.sum(F.when(near, F.col("word_sim") * F.col("weight"))).alias("near_sum"), F.sum(F.when(near, F.col("weight"))).alias("near_weight"),
    )
    blend = p.beta * F.col("cosine") + (1 - p.beta) * S.ratio(F.col("all_sum"), F.col("all_weight"))
    refined = F.when(F.col("near_weight").isNotNull(), p.delta * S.ratio(F.col("near_sum"), F.col("near_weight")) + (1 - p.delta) * blend).otherwise(blend)
    score = F.when(F.col("cosine") > p.alpha, F.lit(1.0)).when(F.coalesce("veto", F.lit(False)), F.lit(-1.0)).otherwise(refined)
    return rows.join(sums, keys, "left").withColumn("title_sim", score).drop("veto", "all_sum", "all_weight", "near_sum", "near_weight")


def distance(least: Column, p: Parameters) -> Column:
    """Of matches, mk_sim, nmk_sim, title_sim and the smaller number of attributes."""
    share = F.col("matches") / F.when(least > 0, least)
    blended = (1 - p.mu) * share * F.col("mk_sim") + (1 - p.mu - (1 - p.mu) * share) * F.col("nmk_sim") + p.mu * F.col("title_sim")
    certain = share * F.col("mk_sim") + (1 - share) * F.col("nmk_sim")
    return 1 - F.when(least == 0, F.col("mk_sim")).when(F.col("title_sim") == 1, certain).otherwise(blended)


def truncated(dist: Column) -> Column:
    return F.when(dist < 0, F.ceil(dist)).otherwise(F.floor(dist)).cast("double")


def edges(pairs: DataFrame, products: DataFrame, p: Parameters | None = None, truncate_distances: bool = False) -> DataFrame:
    """(i, j, dist) of blocked candidate pairs; every other pair has distance 1."""
    p = p or Parameters()
    rows = title_similarity(value_similarities(block(pairs, products), products, p.gamma), p)
    least = F.least(F.size(F.map_keys("features_i")), F.size(F.map_keys("features_j")))
    dist = distance(least, p)
    return rows.select("i", "j", (truncated(dist) if truncate_distances else dist).alias("dist"))
