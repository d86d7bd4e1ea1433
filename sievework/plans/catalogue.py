"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import similarity as S
from sievework.functions import text as T
from sievework.operators import classes, closeness, evaluate, features, lookup, lsh, msm, sampling, store, words
from sievework.sources import products

from . import oracle as O  # noqa: E741

BANDS, ROWS = 20, 5
GRID = ((30, 2), (15, 4), (6, 10))
SAMPLES, RATIO = 3, 0.63
#: The reference's samples. Queries with SQL take SAMPLES and GRID, which SQL is quick enough for.
FULL_SAMPLES = 5

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_lsh_candidates(spark, sf_dir)


def _long(df: DataFrame) -> DataFrame:
    return df.select("pid", F.explode("features").alias("k", "v"))


def _cleaned(spark, sf_dir, spread: bool = False) -> DataFrame:
    return words.clean_products(products.offers(spark, sf_dir, spread))


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Cleaned products, written once since every stage reads them, and their pairs with one label."""
    clean = store.written(_cleaned(spark, sf_dir))
    return clean, lsh.true_pairs(clean)


def _true_classes(spark, sf_dir) -> tuple[classes.Classes, DataFrame]:
    """Classes of the cleaned products, and the blocked ones of one label."""
    found = classes.classes(products.offers(spark, sf_dir, spread=True))
    return found, classes.true_pairs(found)


def _lsh_pairs(spark, sf_dir, score=None, columns: str = "") -> DataFrame:
    """The blocked pairs of offers that LSH finds, with what ``score`` gives."""
    found = classes.classes(products.offers(spark, sf_dir, spread=True))
    grid = ((BANDS, ROWS),)
    return closeness.offer_pairs(found, classes.signed(found, grid), grid, score, columns)


def _round(c, name: str):
    return F.round(c, 6).alias(name)


# --- projections and cleaning ----------------------------------------------


@query("SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents")
def q_drop_column(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").drop("source").withColumn("digest", F.md5("text")).drop("text")


_SIMPLE = tuple(p for p in T.PATTERNS if p[0] in (r"['\"”]", "blu ray", r"[\/\(\)\-\[\]\:\–\—\,\&\+\|]", "hertz", r"\s+", r"^\s+|\s+$"))


@query(f"WITH {O.OFFER} SELECT pid, {O.norm('lower(title)', _SIMPLE)} AS title FROM offer")
def q_lower_clean(spark, sf_dir):
    return products.offers(spark, sf_dir).select("pid", T.clean_title(F.col("title"), _SIMPLE).alias("title"))


@query(f"WITH {O.OFFER}, {O.TITLE} SELECT pid, title FROM titled")
def q_title_clean(spark, sf_dir):
    return products.offers(spark, sf_dir).select("pid", T.clean_title(F.col("title")).alias("title"))


@query(f"WITH {O.OFFER} SELECT pid, {O.norm('lower(title)', T.BASELINE_PATTERNS)} AS title FROM offer")
def q_title_clean_baseline(spark, sf_dir):
    return products.offers(spark, sf_dir).select("pid", T.clean_title_baseline(F.col("title")).alias("title"))


@query(f"WITH {O.OFFER} SELECT pid, {O.norm('lower(title)', T.PATTERNS[18:19])} AS title FROM offer")
def q_keep_last_word(spark, sf_dir):
    return products.offers(spark, sf_dir).select("pid", T.clean_title(F.col("title"), T.PATTERNS[18:19]).alias("title"))


@query(f"WITH {O.OFFER} SELECT pid, {O.norm('lower(title)', T.PATTERNS[7:8])} AS title FROM offer")
def q_dot_rule(spark, sf_dir):
    return products.offers(spark, sf_dir).select("pid", T.clean_title(F.col("title"), T.PATTERNS[7:8]).alias("title"))


_NORMAL = f"WITH {O.OFFER}, {O.RAW}, {O.NORMAL}"


@query(f"{_NORMAL} SELECT pid, k, v FROM last_feat")
def q_map_normalize(spark, sf_dir):
    return _long(products.offers(spark, sf_dir).withColumn("features", features.normalise_map(F.col("features"))))


@query(f"{_NORMAL}, {O.STANDARD} SELECT pid, k, v FROM standard")
def q_map_backfill(spark, sf_dir):
    return _long(features.clean_features(products.offers(spark, sf_dir)))


def _branded(spark, sf_dir):
    offers = features.once(products.offers(spark, sf_dir).withColumn("title", T.clean_title(F.col("title"))), "title")
    return features.fill_brands(features.clean_features(offers))


_BRAND = f"{_NORMAL}, {O.STANDARD}, {O.TITLE}, {O.BRAND}"


@query(f"{_BRAND} SELECT pid, brand FROM branded")
def q_brand_fill(spark, sf_dir):
    return _branded(spark, sf_dir).select("pid", "brand")


@query(f"WITH {O.OFFER}, {O.RAW} SELECT pid, lower(max(CASE WHEN k = 'Brand' THEN v END)) AS brand, count(*) FILTER (k <> 'Brand') AS n_left FROM raw_feat GROUP BY pid")
def q_brand_pop(spark, sf_dir):
    return features.pop_brand(products.offers(spark, sf_dir)).select("pid", "brand", F.size(F.map_keys("features")).cast("long").alias("n_left"))


@query(f"{_BRAND}, {O.SELECTED} SELECT k AS key, n FROM selected")
def q_feature_completeness(spark, sf_dir):
    return features.complete_keys(_branded(spark, sf_dir), 0.5)


@query(f"{_BRAND}, {O.SELECTED} SELECT pid, k, v FROM kept")
def q_feature_filter(spark, sf_dir):
    return _long(features.select_features(_branded(spark, sf_dir), 0.5))


# --- model words -------------------------------------------------------------


@query(f"WITH {O.OFFER}, {O.TITLE} SELECT pid, array_to_string(regexp_extract_all(title, {O._quote(T.TITLE_WORD)}, 1), ' ') AS words FROM titled")
def q_title_words(spark, sf_dir):
    cleaned = products.offers(spark, sf_dir).withColumn("title", T.clean_title(F.col("title")))
    return cleaned.select("pid", F.array_join(T.title_words(F.col("title")), " ").alias("words"))


@query(f"WITH {O.OFFER}, {O.RAW} SELECT pid, coalesce(string_agg(regexp_extract(lower(v), {O._quote(T.FEATURE_WORD)}), ' ' ORDER BY ord) FILTER (regexp_matches(lower(v), {O._quote(T.FEATURE_WORD)})), '') AS words FROM raw_feat GROUP BY pid")
def q_feature_words(spark, sf_dir):
    return products.offers(spark, sf_dir).select("pid", F.array_join(T.feature_words(F.map_values("features")), " ").alias("words"))


@query(f"WITH {O.CLEAN} SELECT pid, array_to_string(words, ' ') AS model_words FROM worded")
def q_model_words(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("pid", "model_words")


@query(rf"""WITH {O.OFFER}, {O.RAW}, popped AS (SELECT pid, ord, v FROM raw_feat WHERE k <> 'Brand'),
    fw AS (SELECT pid, string_agg(regexp_extract(lower(v), {O._quote(T.FEATURE_WORD)}), ' ' ORDER BY ord) AS f FROM popped GROUP BY pid),
    tw AS (SELECT pid, array_to_string(regexp_extract_all({O.norm('lower(title)', T.BASELINE_PATTERNS)}, {O._quote(T.TITLE_WORD)}, 1), ' ') AS t FROM offer)
    SELECT pid, array_to_string(list_sort(list_distinct({O.toks("concat_ws(' ', t, f)")})), ' ') AS model_words FROM tw LEFT JOIN fw USING (pid)""")
def q_model_words_baseline(spark, sf_dir):
    return words.clean_products_baseline(products.offers(spark, sf_dir)).select("pid", "model_words")


@query(f"WITH {O.CLEAN} SELECT DISTINCT unnest(words) AS word FROM worded")
def q_vocabulary(spark, sf_dir):
    return lsh.vocabulary(_cleaned(spark, sf_dir))


@query(f"WITH {O.CLEAN}, vocab AS (SELECT DISTINCT unnest(words) AS word FROM worded) SELECT pid, word FROM (SELECT pid, array_to_string(words, ' ') AS s FROM worded) JOIN vocab ON contains(s, word)")
def q_term_presence(spark, sf_dir):
    return lsh.term_presence(store.written(_cleaned(spark, sf_dir).select("pid", "words", "model_words")))


@query(f"WITH {O.DOCS} SELECT pid, unnest(words) AS word FROM docs")
def q_term_tokens(spark, sf_dir):
    return lsh.term_presence(products.docs(spark, sf_dir), "token")


# --- blocking ------------------------------------------------------------------


@query(f"WITH {O.DOCS}, {O.signed(BANDS * ROWS)} SELECT pid, md5(array_to_string(sig, ',')) AS signature FROM signed")
def q_minhash(spark, sf_dir):
    signed = lsh.signatures(products.docs(spark, sf_dir), BANDS * ROWS)
    return signed.select("pid", F.md5(F.array_join("signature", ",")).alias("signature"))


@query(f"WITH {O.DOCS}, {O.signed(BANDS * ROWS)}, {O.banded(BANDS, ROWS)} SELECT DISTINCT a.pid AS i, b.pid AS j FROM banded a JOIN banded b ON a.band = b.band AND a.bucket = b.bucket AND a.pid < b.pid")
def q_lsh_candidates(spark, sf_dir):
    return lsh.candidate_pairs(products.docs(spark, sf_dir), BANDS, ROWS)


_TRUE = "SELECT a.pid AS i, b.pid AS j FROM docs a JOIN docs b ON a.model_id = b.model_id AND a.pid < b.pid"


@query(f"WITH {O.DOCS} {_TRUE}")
def q_true_pairs(spark, sf_dir):
    return lsh.true_pairs(products.docs(spark, sf_dir))


_MSM = f"WITH {O.CLEAN}, {O.TRUE_OFFERS}, {O.BLOCKED}"


_LSH = f"WITH {O.CLEAN}, {O.lsh_pairs(BANDS, ROWS)}, {O.BLOCKED}"


@query(f"{_MSM} SELECT i, j FROM blocked")
def q_block_pairs(spark, sf_dir):
    found, pairs = _true_classes(spark, sf_dir)
    return classes.expanded(pairs, found)


@query(f"{_LSH} SELECT i, j FROM blocked")
def q_lsh_block_pairs(spark, sf_dir):
    return _lsh_pairs(spark, sf_dir)


# --- sampling and evaluation ----------------------------------------------------


def _sample(spark, sf_dir):
    return sampling.bootstrap(products.docs(spark, sf_dir), RATIO, SAMPLES)


_BOOT = f"WITH {O.DOCS}, {O.boot(RATIO, SAMPLES)}"


@query(f"WITH {O.DOCS} SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS position FROM docs")
def q_row_ids(spark, sf_dir):
    return sampling.with_position(products.docs(spark, sf_dir)).select("pid", "position")


@query(f"{_BOOT} SELECT boot_id, pid, source_pid FROM sample")
def q_bootstrap(spark, sf_dir):
    return _sample(spark, sf_dir).select("boot_id", "pid", "source_pid")


@query(f"{_BOOT} SELECT boot_id, d.pid FROM docs d CROSS JOIN (SELECT unnest(range({SAMPLES})) AS boot_id) b WHERE NOT EXISTS (SELECT 1 FROM sample s WHERE s.boot_id = b.boot_id AND s.source_pid = d.pid)")
def q_oob(spark, sf_dir):
    docs = products.docs(spark, sf_dir)
    return sampling.out_of_bag(docs, sampling.bootstrap(docs, RATIO, SAMPLES))


@query(f"WITH {O.DOCS} SELECT pid, CASE WHEN {O.hashed('pid')} < {int(0.8 * (1 << 28))} THEN 'train' ELSE 'test' END AS part FROM docs")
def q_split(spark, sf_dir):
    return sampling.split(products.docs(spark, sf_dir)).select("pid", "part")


def _grid_sql(given: str = _BOOT) -> str:
    number = max(b * r for b, r in GRID)
    parts = []
    for b, r in GRID:
        parts.append(f"band_{b} AS (SELECT boot_id, pid, b AS band, sha256(array_to_string(sig[b * {r} + 1 : b * {r} + {r}], ',')) AS bucket FROM (SELECT boot_id, pid, sig, unnest(range({b})) AS b FROM signed))")
    found = " UNION ALL ".join(f"SELECT DISTINCT x.boot_id, {b} AS bands, {r} AS rows, x.pid AS i, y.pid AS j FROM band_{b} x JOIN band_{b} y ON x.boot_id = y.boot_id AND x.band = y.band AND x.bucket = y.bucket AND x.pid < y.pid" for b, r in GRID)
    grid = " UNION ALL ".join(f"SELECT {b} AS bands, {r} AS rows, {lsh.similarity_threshold(b, r)!r}::DOUBLE AS t" for b, r in GRID)
    return f"""{given}, {O.signed(number, source='sample', key='boot_id, pid')}, {', '.join(parts)}, found AS ({found}), grid AS ({grid}),
    truth AS (SELECT a.boot_id, a.pid AS i, b.pid AS j FROM sample a JOIN sample b ON a.boot_id = b.boot_id AND a.model_id = b.model_id AND a.pid < b.pid),
    hit AS (SELECT f.boot_id, bands, rows, count(*) AS found, count(t.i) AS tp FROM found f LEFT JOIN truth t USING (boot_id, i, j) GROUP BY ALL),
    counts AS (SELECT s.boot_id, s.n, g.bands, g.rows, g.t, coalesce(found, 0) AS found, coalesce(tp, 0) AS tp, coalesce(tt, 0) AS tt
        FROM (SELECT boot_id, count(*) AS n FROM sample GROUP BY boot_id) s CROSS JOIN grid g LEFT JOIN hit h ON h.boot_id = s.boot_id AND h.bands = g.bands AND h.rows = g.rows
        LEFT JOIN (SELECT boot_id, count(*) AS tt FROM truth GROUP BY boot_id) u ON u.boot_id = s.boot_id),
    scored AS (SELECT *, coalesce(tp / nullif(found, 0), 0.0) AS pq, coalesce(tp / nullif(tt, 0), 0.0) AS pc FROM counts),
    result AS (SELECT *, coalesce(2 * pq * pc / nullif(pq + pc, 0), 0.0) AS f1_star, found / (n * (n - 1) / 2) AS fraction FROM scored)"""


_EVAL = _grid_sql()


def _eval(products: DataFrame, number: int, grid) -> DataFrame:
    return evaluate.evaluate_lsh(products.select("pid", "model_id", "words"), lambda p: sampling.bootstrap(p, RATIO, number), grid)


@query(f"{_EVAL} SELECT boot_id, bands, rows, round(t, 6) AS t, tp, found - tp AS fp, tt - tp AS fn, round(pq, 6) AS pq, round(pc, 6) AS pc, round(f1_star, 6) AS f1_star, round(fraction, 6) AS fraction FROM result")
def q_lsh_eval(spark, sf_dir):
    got = _eval(products.docs(spark, sf_dir), SAMPLES, GRID)
    return got.select("boot_id", "bands", "rows", _round("t", "t"), "tp", "fp", "fn", *(_round(c, c) for c in ("pq", "pc", "f1_star", "fraction")))


@query(f"{_EVAL} SELECT bands, rows, round(avg(f1_star), 6) AS f1_star, round(avg(pc), 6) AS pc, round(avg(pq), 6) AS pq, round(avg(fraction), 6) AS fraction FROM result GROUP BY bands, rows")
def q_lsh_average(spark, sf_dir):
    got = evaluate.average(_eval(products.docs(spark, sf_dir), SAMPLES, GRID))
    return got.select("bands", "rows", *(_round(c, c) for c in ("f1_star", "pc", "pq", "fraction")))


def _full_eval(products: DataFrame) -> DataFrame:
    return _eval(products, FULL_SAMPLES, evaluate.GRID)


@query()
def q_lsh_eval_full(spark, sf_dir):
    got = _full_eval(products.docs(spark, sf_dir))
    return got.select("boot_id", "bands", "rows", _round("t", "t"), "tp", "fp", "fn", *(_round(c, c) for c in ("pq", "pc", "f1_star", "fraction")))


@query()
def q_lsh_average_full(spark, sf_dir):
    got = evaluate.average(_full_eval(products.docs(spark, sf_dir)))
    return got.select("bands", "rows", *(_round(c, c) for c in ("f1_star", "pc", "pq", "fraction")))


# --- similarities ------------------------------------------------------------------


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


@query(f"SELECT p_partkey, round({O.qgram('p_name', 'p_type')}, 6) AS sim FROM part")
def q_qgram(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", _round(S.qgram_similarity(F.col("p_name"), F.col("p_type")), "sim"))


@query(f"SELECT p_partkey, round({O.lev('p_name', 'p_type')}, 6) AS sim, {O.lev('p_name', 'p_type')} >= 0.2 AS close FROM part")
def q_levenshtein(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return _part(spark, sf_dir).select("p_partkey", _round(S.levenshtein_similarity(a, b), "sim"), S.close(a, b, 0.2).alias("close"))


@query(rf"""WITH {O.OFFER}, w AS (SELECT DISTINCT unnest({O.toks('title')}) AS word FROM offer)
    SELECT word, array_to_string(regexp_extract_all(word, '\d+\.?\d*'), '') AS num, regexp_replace(word, '\d+\.?\d*', '', 'g') AS rest FROM w""")
def q_split_word(spark, sf_dir):
    found = products.offers(spark, sf_dir).select(F.explode(T.tokens(F.col("title"))).alias("word")).distinct()
    return found.select("word", T.numeric_part(F.col("word")).alias("num"), T.other_part(F.col("word")).alias("rest"))


def _blocked(spark, sf_dir):
    clean, pairs = _pairs(spark, sf_dir)
    return msm.block(pairs, clean), clean


@query(f"""{_MSM}, duo AS (SELECT i, j, {O.toks('a.title')} AS x, {O.toks('b.title')} AS y, a.title AS ta, b.title AS tb, a.words AS wa, b.words AS wb FROM blocked JOIN worded a ON a.pid = i JOIN worded b ON b.pid = j)
    SELECT i, j, round(coalesce(len(list_intersect(list_distinct(x), list_distinct(y))) / nullif(sqrt(length(ta)) * sqrt(length(tb)), 0), 0.0), 6) AS title_cosine,
        round(coalesce(len(list_intersect(list_distinct(x), list_distinct(y))) / nullif(sqrt(len(list_distinct(x)) * len(list_distinct(y))), 0), 0.0), 6) AS token_cosine,
        round(coalesce(len(list_intersect(wa, wb)) / nullif(len(list_distinct(list_concat(wa, wb))), 0), 0.0), 6) AS jaccard FROM duo""")
def q_title_cosine(spark, sf_dir):
    rows, _ = _blocked(spark, sf_dir)
    a, b = T.tokens(F.col("title_i")), T.tokens(F.col("title_j"))
    return rows.select("i", "j", _round(S.title_cosine(F.col("title_i"), a, F.col("title_j"), b), "title_cosine"), _round(S.token_cosine(a, b), "token_cosine"), _round(S.jaccard(F.col("words_i"), F.col("words_j")), "jaccard"))


@query(f"WITH {O.CLEAN} SELECT k.pid, k.k, array_to_string(list_filter(words, lambda w: contains(k.v, w)), ' ') AS found FROM kept k JOIN worded w ON w.pid = k.pid WHERE v IS NOT NULL")
def q_extract_words(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).select("pid", "words", F.explode("features").alias("k", "v")).where("v is not null")
    return rows.select("pid", "k", F.array_join(S.contained_words(F.col("v"), F.col("words")), " ").alias("found"))


@query(f"{_MSM}, x AS (SELECT i, j, unnest({O.toks('a.title')}) AS wx, {O.toks('b.title')} AS ys FROM blocked JOIN worded a ON a.pid = i JOIN worded b ON b.pid = j), y AS (SELECT i, j, wx, unnest(ys) AS wy FROM x)"
       f" SELECT i, j, round(sum({O.lev('wx', 'wy')} * (length(wx) + length(wy))) / sum(length(wx) + length(wy)), 6) AS mean FROM y GROUP BY i, j")  # fmt: skip
def q_avg_levenshtein(spark, sf_dir):
    found, pairs = _true_classes(spark, sf_dir)
    return classes.expanded(classes.by_titles(pairs, found, classes.mean_levenshtein).select("ci", "cj", _round("mean", "mean")), found, "mean")


def _values(source):
    found, pairs = source
    scored = classes.by_values(pairs, found, 0.7).select("ci", "cj", _round("mk_sim", "mk_sim"), _round("nmk_sim", "nmk_sim"), F.col("matches").cast("long").alias("matches"))
    return classes.expanded(scored, found, "mk_sim", "nmk_sim", "matches")


def _titles(source):
    found, pairs = source
    scored = classes.by_titles(pairs, found, lambda r: msm.title_similarity(r, msm.Parameters())).select("ci", "cj", _round("title_sim", "title_sim"))
    return classes.expanded(scored, found, "title_sim")


def _distances(source, dist):
    found, pairs = source
    return classes.expanded(classes.edges(pairs, found).select("ci", "cj", dist), found, "dist")


@query(f"{_MSM}, {O.VALUE} SELECT i, j, round(mk_sim, 6) AS mk_sim, round(nmk_sim, 6) AS nmk_sim, matches FROM valued")
def q_value_sim(spark, sf_dir):
    return _values(_true_classes(spark, sf_dir))


@query(f"{_MSM}, {O.TITLESIM} SELECT i, j, round(t, 6) AS title_sim FROM titlesim")
def q_title_sim(spark, sf_dir):
    return _titles(_true_classes(spark, sf_dir))


_EDGE = f"{_MSM}, {O.VALUE}, {O.TITLESIM}, {O.EDGES}"


@query(f"{_EDGE} SELECT i, j, round(dist, 6) AS dist FROM edge")
def q_msm_edges(spark, sf_dir):
    return _distances(_true_classes(spark, sf_dir), _round("dist", "dist"))


@query(f"{_EDGE} SELECT i, j, CAST(CASE WHEN dist < 0 THEN ceil(dist) ELSE floor(dist) END AS DOUBLE) + 0.0 AS dist FROM (SELECT i, j, round(dist, 9) AS dist FROM edge)")
def q_msm_edges_truncated(spark, sf_dir):
    return _distances(_true_classes(spark, sf_dir), msm.truncated(F.round("dist", 9)).alias("dist"))


# The same over the candidates that blocking finds.


@query(f"{_LSH}, {O.VALUE} SELECT i, j, round(mk_sim, 6) AS mk_sim, round(nmk_sim, 6) AS nmk_sim, matches FROM valued")
def q_lsh_value_sim(spark, sf_dir):
    return _lsh_pairs(spark, sf_dir, closeness.value_scores, "mk_sim double, nmk_sim double, matches long")


@query(f"{_LSH}, {O.TITLESIM} SELECT i, j, round(t, 6) AS title_sim FROM titlesim")
def q_lsh_title_sim(spark, sf_dir):
    return _lsh_pairs(spark, sf_dir, closeness.title_scores, "title_sim double")


_LSH_EDGE = f"{_LSH}, {O.VALUE}, {O.TITLESIM}, {O.EDGES}"


@query(f"{_LSH_EDGE} SELECT i, j, round(dist, 6) AS dist FROM edge")
def q_lsh_msm_edges(spark, sf_dir):
    return _lsh_pairs(spark, sf_dir, closeness.distance_scores, "dist double")


@query(f"{_LSH_EDGE} SELECT i, j, CAST(CASE WHEN dist < 0 THEN ceil(dist) ELSE floor(dist) END AS DOUBLE) + 0.0 AS dist FROM (SELECT i, j, round(dist, 9) AS dist FROM edge)")
def q_lsh_msm_edges_truncated(spark, sf_dir):
    return _lsh_pairs(spark, sf_dir, closeness.truncated_scores, "dist double")


# --- clusters ---------------------------------------------------------------------


def _components(source):
    found, pairs = source
    return classes.components(classes.edges(pairs, found).where(F.round("dist", 9) < 0.9), found)


def _class_edges(spark, sf_dir) -> tuple[classes.Classes, DataFrame]:
    """Classes and their distances below the largest threshold, to nine digits, so that equal ones are equal in any engine."""
    found = classes.classes(products.offers(spark, sf_dir, spread=True))
    grid = ((BANDS, ROWS),)
    close = closeness.close_pairs(found, classes.signed(found, grid), grid, max(evaluate.THRESHOLDS))
    return found, store.written(close.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "dist"))


_LSH_COMPONENTS = _LSH_EDGE.replace("WITH ", "WITH RECURSIVE ", 1) + f", {O.COMPONENTS}"
_CLUSTERS = f"{_LSH_COMPONENTS}, {O.clusters(evaluate.THRESHOLDS)}"


@query(_EDGE.replace("WITH ", "WITH RECURSIVE ", 1) + """, close AS (SELECT i, j FROM edge WHERE dist < 0.9 UNION SELECT j, i FROM edge WHERE dist < 0.9),
    reach AS (SELECT i AS pid, i AS r FROM close UNION SELECT reach.pid, close.j FROM reach JOIN close ON close.i = reach.r)
    SELECT pid, min(r) AS component FROM reach GROUP BY pid""")
def q_components(spark, sf_dir):
    return _components(_true_classes(spark, sf_dir))


@query(f"{_LSH_COMPONENTS} SELECT pid, component FROM comp")
def q_lsh_components(spark, sf_dir):
    found, scored = _class_edges(spark, sf_dir)
    return classes.components(scored, found)


@query(f"{_CLUSTERS} SELECT eps, pid, cluster_id FROM clustered")
def q_clusters(spark, sf_dir):
    found, scored = _class_edges(spark, sf_dir)
    return classes.clusters(scored, found, evaluate.THRESHOLDS)


@query("SELECT 0::BIGINT AS n")
def q_cluster_violations(spark, sf_dir):
    found, scored = _class_edges(spark, sf_dir)
    return classes.violations(store.written(classes.clusters(scored, found, evaluate.THRESHOLDS)), scored, found).agg(F.count(F.lit(1)).alias("n"))


def _tuned(spark, sf_dir):
    found, scored = _class_edges(spark, sf_dir)
    clustered = classes.clusters(scored, found, evaluate.THRESHOLDS)
    return evaluate.tune_clusters(clustered, classes.models(found), *classes.candidate_counts(found, BANDS, ROWS))


def _rounded(tuned):
    return tuned.select("eps", "tp", "fp", "fn", *(_round(c, c) for c in ("pq", "pc", "f1_star", "fraction")), "found")


@query(f"{_CLUSTERS}, {O.TUNED} SELECT * FROM tuned")
def q_tuning(spark, sf_dir):
    return _rounded(_tuned(spark, sf_dir))


@query(f"{_CLUSTERS}, {O.TUNED} SELECT * FROM tuned ORDER BY f1_star DESC, eps DESC LIMIT 1")
def q_tuning_best(spark, sf_dir):
    return _rounded(evaluate.best(_tuned(spark, sf_dir)))


@query()
def q_msm_eval(spark, sf_dir):
    return _msm_average(store.written(_cleaned(spark, sf_dir, spread=True)))


def _msm_average(clean):
    return evaluate.average(evaluate.evaluate_msm(clean, evaluate.GRID, lambda p: sampling.bootstrap(p, RATIO, FULL_SAMPLES)), ("f1_star", "fraction"))


# --- look-ups and plots --------------------------------------------------------------


@query(f"{_MSM}, n AS (SELECT pid, count(*) AS n FROM kept GROUP BY pid) SELECT i, j, a.shop = b.shop AS same_shop, a.brand IS NOT DISTINCT FROM b.brand AS same_brand, least(x.n, y.n) AS least_features FROM pairs JOIN worded a ON a.pid = i JOIN worded b ON b.pid = j JOIN n x ON x.pid = i JOIN n y ON y.pid = j")
def q_pair_lookups(spark, sf_dir):
    clean, pairs = _pairs(spark, sf_dir)
    columns = ["shop", "brand", "features"]
    a = clean.select(F.col("pid").alias("i"), *(F.col(c).alias(f"{c}_i") for c in columns))
    b = clean.select(F.col("pid").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    rows = pairs.join(a, "i").join(b, "j")
    return rows.select("i", "j", lookup.same_shop().alias("same_shop"), lookup.same_brand().alias("same_brand"), lookup.least_features(F.col("features_i"), F.col("features_j")).cast("long").alias("least_features"))


@query(f"{_NORMAL} SELECT pid, max(CASE WHEN k = 'brand' AND v <> '' THEN v END) AS brand, array_to_string(list_sort(list(DISTINCT v)), '|') AS value_set FROM last_feat GROUP BY pid")
def q_map_lookups(spark, sf_dir):
    rows = products.offers(spark, sf_dir).withColumn("features", features.normalise_map(F.col("features")))
    return rows.select("pid", features.brand_of(F.col("features")).alias("brand"), F.array_join(lookup.value_set(F.col("features")), "|").alias("value_set"))


@query(f"WITH {O.OFFER} SELECT model_id, unnest(list(pid)) AS pid FROM offer GROUP BY model_id")
def q_flatten(spark, sf_dir):
    grouped = products.offers(spark, sf_dir).groupBy("model_id").agg(F.collect_list(F.struct("model_id", "pid")).alias("rows"))
    return products.flatten(grouped.select(F.create_map("model_id", "rows").alias("m")), "m")


_BASELINE_WORDS = rf"""{O.OFFER}, {O.RAW}, popped AS (SELECT pid, ord, v FROM raw_feat WHERE k <> 'Brand'),
    fw AS (SELECT pid, string_agg(regexp_extract(lower(v), {O._quote(T.FEATURE_WORD)}), ' ' ORDER BY ord) AS f FROM popped GROUP BY pid),
    tw AS (SELECT pid, model_id, array_to_string(regexp_extract_all({O.norm('lower(title)', T.BASELINE_PATTERNS)}, {O._quote(T.TITLE_WORD)}, 1), ' ') AS t FROM offer),
    docs AS (SELECT pid, model_id, list_sort(list_distinct({O.toks("concat_ws(' ', t, f)")})) AS words FROM tw LEFT JOIN fw USING (pid))"""


def _series_sql(series: str, products_sql: str) -> str:
    return f"""SELECT '{series}' AS series, u.metric, round(x, 6) AS x, round(u.y, 6) AS y FROM (
        {_grid_sql(f"WITH {products_sql}, {O.boot(RATIO, SAMPLES)}")}, a AS (SELECT bands, avg(f1_star) AS f1_star, avg(pc) AS pc, avg(pq) AS pq, avg(fraction) AS x FROM result GROUP BY bands)
        SELECT x, unnest([{{'metric': 'pc', 'y': pc}}, {{'metric': 'pq', 'y': pq}}, {{'metric': 'f1_star', 'y': f1_star}}]) AS u FROM a)"""


@query(_series_sql("improved", f"{O.CLEAN}, docs AS (SELECT pid, model_id, words FROM worded)") + " UNION ALL " + _series_sql("baseline", _BASELINE_WORDS))
def q_plot_series(spark, sf_dir):
    """The series of the blocking figures for the improved and the baseline cleaning of the offers."""
    both = (_cleaned(spark, sf_dir, spread=True), words.clean_products_baseline(products.offers(spark, sf_dir, spread=True)))
    new, old = (evaluate.average(_eval(p, SAMPLES, GRID)) for p in both)
    return evaluate.plot_series(new, old).select("series", "metric", _round("x", "x"), _round("y", "y"))


@query()
def q_plot_series_full(spark, sf_dir):
    """The series of the figures: improved and baseline cleaning of the offers, and F1 after clustering."""
    clean = store.written(_cleaned(spark, sf_dir, spread=True))
    baseline = store.written(words.clean_products_baseline(products.offers(spark, sf_dir, spread=True)))
    new, old = (store.written(evaluate.average(_full_eval(p.select("pid", "model_id", "words")))) for p in (clean, baseline))
    return evaluate.plot_series(new, old, _msm_average(clean)).select("series", "metric", _round("x", "x"), _round("y", "y"))
