"""SQL (DuckDB) for the queries of the catalogue, written independently of their plans.

RE2 has no look-around and no back-references, so the two patterns that need
them are expressed by other means: a dot between non-digits with captured
neighbours, and repeated words by a list of words. The inputs are ASCII where
that matters.
"""

from __future__ import annotations

from sievework.functions import text as T
from sievework.operators import lsh
from sievework.sources import products

DOT = r"(?<!\d)\.(?!\d|\w)"
REPEATED = r"\b(\w+)\b(?=.*\b\1\b)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(expr: str, patterns) -> str:
    """The rewrites as nested calls; the repeated-word rewrite refers to its input twice and goes through a list."""
    for pattern, to in patterns:
        if pattern == DOT:
            for _ in range(2):
                expr = rf"regexp_replace({expr}, '(^|[^0-9])\.($|[^0-9A-Za-z_])', '\1 \2', 'g')"
        elif pattern == REPEATED:
            expr = rf"""list_reduce(list_prepend('', list_transform([regexp_extract_all({expr}, '\w+|\W+')], lambda l: array_to_string(list_filter(l, lambda x, i: NOT (regexp_matches(x, '^\w+$') AND list_contains(l[i + 1:], x))), ''))), lambda a, b: a || b)"""
        else:
            pattern = pattern.replace("\\–", "–").replace("\\—", "—")  # RE2 knows no escapes of these
            expr = f"regexp_replace({expr}, {_quote(pattern)}, {_quote(to.replace('$1', chr(92) + '1'))}, 'g')"
    return expr


def _offer() -> str:
    entries = ", ".join(f"{{'key': '{k}', 'value': cast({v} as varchar)}}" for k, v in products.FEATURES)
    columns = ", ".join(f"cast({e} as {'bigint' if c == 'pid' else 'varchar'}) AS {c}" for c, e in products.OFFER.items())
    return f"offer AS (SELECT {columns}, list_filter([{entries}], lambda e: e.value IS NOT NULL) AS features FROM part)"


OFFER = _offer()
RAW = "raw_feat AS (SELECT pid, ord, f.key AS k, f.value AS v FROM (SELECT pid, unnest(features) AS f, generate_subscripts(features, 1) AS ord FROM offer))"
TITLE = f"titled AS (SELECT pid, model_id, shop, {norm('lower(title)', T.PATTERNS)} AS title FROM offer)"
NORMAL = f"""normal AS (SELECT pid, ord, trim(lower(k), ':/()[]{{}}') AS k, {norm('lower(v)', T.PATTERNS)} AS v FROM raw_feat),
last_feat AS (SELECT pid, k, arg_max(v, ord) AS v FROM normal GROUP BY pid, k)"""

_WIDE = {"mr": "maximum resolution", "ssc": "screen size class", "ss": "screen size", "ssd": "screen size (measured diagonally", "srr": "screen refresh rate", "rr": "refresh rate", "rec": "recommended resolution", "vr": "vertical resolution", "ar": "aspect ratio"}
STANDARD = (
    "wide AS (SELECT pid, " + ", ".join(f"max(CASE WHEN k = '{k}' THEN v END) AS {c}" for c, k in _WIDE.items()) + " FROM last_feat GROUP BY pid),"
    + r"""made AS (
    SELECT pid, 'maximum resolution' AS k, regexp_replace(regexp_replace(mr, '[^\d\sx]', '', 'g'), '\s*x\s*', 'x', 'g') AS v FROM wide
    UNION ALL SELECT pid, 'screen size class', regexp_replace(coalesce(nullif(ssc, ''), nullif(ss, ''), nullif(ssd, ''), ssc), '(\d+\.?\d*)\s*inch.*', '\1inch', 'g') FROM wide
    UNION ALL SELECT pid, 'screen refresh rate', regexp_replace(regexp_replace(coalesce(nullif(srr, ''), nullif(rr, ''), srr), '(\d+\.?\d*)\s*hz.*', '\1hz', 'g'), 'trumotion|clearscn|clear motion rate', '', 'g') FROM wide
    UNION ALL SELECT pid, 'recommended resolution', coalesce(nullif(rec, ''), nullif(vr, ''), rec) FROM wide
    UNION ALL SELECT pid, 'aspect ratio', regexp_replace(regexp_replace(ar, '\b(\d+)\s(\d+)\b', '\1i\2', 'g'), '\s.*$', '', 'g') FROM wide),
standard AS (
    SELECT pid, k, v FROM last_feat WHERE k NOT IN ('screen size', 'screen size (measured diagonally', 'refresh rate', 'vertical resolution', 'maximum resolution', 'screen size class', 'screen refresh rate', 'recommended resolution', 'aspect ratio')
    UNION ALL SELECT pid, k, v FROM made WHERE v IS NOT NULL)"""
)
_IN_TITLE = "CASE " + " ".join(f"WHEN contains(title, '{b}') THEN '{b}'" for b in T.BRANDS) + " END"
BRAND = f"""branded AS (SELECT t.pid, model_id, shop, title, coalesce(nullif(b.v, ''), {_IN_TITLE}, b.v) AS brand FROM titled t LEFT JOIN (SELECT pid, v FROM standard WHERE k = 'brand') b USING (pid)),
full_feat AS (SELECT pid, k, v FROM standard WHERE k <> 'brand' UNION ALL SELECT pid, 'brand', brand FROM branded)"""
SELECTED = """selected AS (SELECT k, count(*) AS n FROM full_feat GROUP BY k HAVING count(*) >= 0.5 * (SELECT count(*) FROM offer)),
kept AS (SELECT f.pid, f.k, f.v FROM full_feat f JOIN selected USING (k))"""
WORDS = f"""vals AS (SELECT o.pid, string_agg(CASE WHEN f.pid IS NULL THEN '' ELSE coalesce(f.v, 'None') END, ' ' ORDER BY s.n DESC, s.k) AS vals
    FROM offer o CROSS JOIN selected s LEFT JOIN kept f ON f.pid = o.pid AND f.k = s.k GROUP BY o.pid),
worded AS (SELECT b.pid, model_id, shop, brand, title, list_sort(list_distinct(list_filter(regexp_split_to_array(
    concat_ws(' ', array_to_string(regexp_extract_all(lower(title), {_quote(T.TITLE_WORD)}, 1), ' '), vals), '\\s+'), lambda x: x <> ''))) AS words
    FROM branded b JOIN vals USING (pid))"""
CLEAN = ",\n".join([OFFER, RAW, TITLE, NORMAL, STANDARD, BRAND, SELECTED, WORDS])


def grams(s: str) -> str:
    flat = rf"regexp_replace({s}, '\s+', ' ', 'g')"
    return f"list_transform(range(1, greatest(length({flat}) - 1, 1)), lambda g: substr({flat}, g, 3))"


def qgram(a: str, b: str) -> str:
    """By counts of each gram; 0 for two empty texts and for a null."""
    x, y = grams(a), grams(b)
    shared = f"list_sum(list_transform(list_distinct({x}), lambda d: least(len(list_filter({x}, lambda o: o = d)), len(list_filter({y}, lambda o: o = d)))))"
    n = f"(length({a}) + length({b}))"
    return f"coalesce(({n} - (len({x}) + len({y}) - 2 * coalesce({shared}, 0))) / nullif({n}, 0), 0.0)"


def lev(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"


def toks(s: str) -> str:
    return rf"list_filter(regexp_split_to_array({s}, '\s+'), lambda x: x <> '')"


TRUE_OFFERS = "pairs AS (SELECT a.pid AS i, b.pid AS j FROM worded a JOIN worded b ON a.model_id = b.model_id AND a.pid < b.pid)"
BLOCKED = "blocked AS (SELECT p.i, p.j FROM pairs p JOIN worded a ON a.pid = p.i JOIN worded b ON b.pid = p.j WHERE a.shop <> b.shop AND a.brand IS NOT DISTINCT FROM b.brand)"
VALUE = f"""keysim AS (SELECT a.k AS ki, b.k AS kj, {qgram('a.k', 'b.k')} AS s FROM (SELECT DISTINCT k FROM kept) a CROSS JOIN (SELECT DISTINCT k FROM kept) b),
matched AS (SELECT i, j, fi.k AS ki, fj.k AS kj, s, CASE WHEN fi.v IS NULL OR fj.v IS NULL THEN 0.0 ELSE {qgram('fi.v', 'fj.v')} END AS vs
    FROM blocked JOIN kept fi ON fi.pid = i JOIN kept fj ON fj.pid = j JOIN keysim ON ki = fi.k AND kj = fj.k WHERE s > 0.7),
sums AS (SELECT i, j, sum(s * vs) AS total, sum(s) AS weight, count(*) AS matches FROM matched GROUP BY i, j),
wordrow AS (SELECT pid, unnest(words) AS w FROM worded),
rest_i AS (SELECT b.i, b.j, list(DISTINCT w) AS l FROM blocked b JOIN kept f ON f.pid = b.i JOIN wordrow r ON r.pid = b.i AND contains(f.v, r.w)
    WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.i = b.i AND m.j = b.j AND m.ki = f.k) GROUP BY b.i, b.j),
rest_j AS (SELECT b.i, b.j, list(DISTINCT w) AS l FROM blocked b JOIN kept f ON f.pid = b.j JOIN wordrow r ON r.pid = b.j AND contains(f.v, r.w)
    WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.i = b.i AND m.j = b.j AND m.kj = f.k) GROUP BY b.i, b.j),
valued AS (SELECT b.i, b.j, coalesce(total / weight, 0.0) AS mk_sim, coalesce(matches, 0) AS matches,
    coalesce(len(list_intersect(coalesce(x.l, []), coalesce(y.l, []))) / nullif(len(list_distinct(list_concat(coalesce(x.l, []), coalesce(y.l, [])))), 0), 0.0) AS nmk_sim
    FROM blocked b LEFT JOIN sums USING (i, j) LEFT JOIN rest_i x USING (i, j) LEFT JOIN rest_j y USING (i, j))"""
TITLESIM = rf"""tok AS (SELECT pid, w, array_to_string(regexp_extract_all(w, '\d+\.?\d*'), '') AS num, regexp_replace(w, '\d+\.?\d*', '', 'g') AS rest FROM (SELECT pid, unnest({toks('title')}) AS w FROM worded)),
cosine AS (SELECT b.i, b.j, coalesce(len(list_intersect(list_distinct({toks('x.title')}), list_distinct({toks('y.title')}))) / nullif(sqrt(length(x.title)) * sqrt(length(y.title)), 0), 0.0) AS c
    FROM blocked b JOIN worded x ON x.pid = b.i JOIN worded y ON y.pid = b.j),
tokpair AS (SELECT b.i, b.j, {lev('x.rest', 'y.rest')} AS rs, {lev('x.w', 'y.w')} AS ws, length(x.w) + length(y.w) AS l, x.num = y.num AS same
    FROM blocked b JOIN tok x ON x.pid = b.i JOIN tok y ON y.pid = b.j),
toksum AS (SELECT i, j, bool_or(rs >= 1 AND NOT same) AS veto, sum(ws * l) / sum(l) AS mean, sum(ws * l) FILTER (rs >= 0.5 AND same) / sum(l) FILTER (rs >= 0.5 AND same) AS near FROM tokpair GROUP BY i, j),
titlesim AS (SELECT i, j, CASE WHEN c > 0.5 THEN 1.0 WHEN veto THEN -1.0 WHEN near IS NOT NULL THEN 0.6 * near + 0.4 * (0.2 * c + 0.8 * coalesce(mean, 0.0)) ELSE 0.2 * c + 0.8 * coalesce(mean, 0.0) END AS t FROM cosine LEFT JOIN toksum USING (i, j))"""
EDGES = """sizes AS (SELECT pid, count(*) AS n FROM kept GROUP BY pid),
edge AS (SELECT i, j, 1 - CASE WHEN m = 0 THEN mk_sim WHEN t = 1 THEN matches / m * mk_sim + (1 - matches / m) * nmk_sim
    ELSE 0.5 * matches / m * mk_sim + (0.5 - 0.5 * matches / m) * nmk_sim + 0.5 * t END AS dist
    FROM (SELECT v.i, v.j, mk_sim, nmk_sim, matches, t, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS m FROM valued v JOIN titlesim USING (i, j) LEFT JOIN sizes a ON a.pid = v.i LEFT JOIN sizes b ON b.pid = v.j))"""

DOCS = r"docs AS (SELECT doc_id AS pid, md5(text) AS model_id, source AS shop, lang AS brand, list_sort(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))) AS words FROM documents)"


def signed(number: int, seed: int = 42, source: str = "docs", key: str = "pid") -> str:
    family = ", ".join(f"{{'a': {a}::BIGINT, 'c': {c}::BIGINT}}" for a, c in lsh.coefficients(number, seed))
    return f"""ids AS (SELECT {key}, list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT) AS ids FROM {source}),
signed AS (SELECT {key}, list_transform([{family}], lambda f: coalesce(list_min(list_transform(ids, lambda x: (f.a * x + f.c) % {lsh.PRIME})), 0)) AS sig FROM ids)"""


def banded(bands: int, rows: int, key: str = "pid", name: str = "banded") -> str:
    return f"{name} AS (SELECT {key}, b AS band, sha256(array_to_string(sig[b * {rows} + 1 : CASE WHEN b = {bands - 1} THEN len(sig) ELSE b * {rows} + {rows} END], ',')) AS bucket FROM (SELECT {key}, sig, unnest(range({bands})) AS b FROM signed))"


def hashed(value: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}-' || {value}), 1, 7))::BIGINT"


def boot(ratio: float, number: int, seed: int = 42) -> str:
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS position FROM docs),
total AS (SELECT count(*) AS n FROM docs),
draws AS (SELECT boot_id, draw, {hashed("boot_id || '-' || draw", seed)} % n AS position FROM (SELECT boot_id, n, unnest(range(round(n * {ratio})::BIGINT)) AS draw FROM (SELECT unnest(range({number})) AS boot_id) b CROSS JOIN total)),
sample AS (SELECT boot_id, draw AS pid, p.pid AS source_pid, model_id, words FROM draws JOIN placed p USING (position))"""


def lsh_pairs(bands: int, rows: int) -> str:
    """The candidate pairs of the cleaned offers."""
    return f"""{signed(bands * rows, source="worded")}, {banded(bands, rows)},
pairs AS (SELECT DISTINCT a.pid AS i, b.pid AS j FROM banded a JOIN banded b ON a.band = b.band AND a.bucket = b.bucket AND a.pid < b.pid)"""


# Distances to nine digits, so that equal ones are equal in any engine.
COMPONENTS = """edged AS MATERIALIZED (SELECT i, j, round(dist, 9) AS dist FROM edge), close AS MATERIALIZED (SELECT i, j, dist FROM edged WHERE dist < 0.9),
both_ways AS (SELECT i AS a, j AS b FROM close UNION SELECT j, i FROM close),
reach AS (SELECT a AS pid, a AS r FROM both_ways UNION SELECT reach.pid, b FROM reach JOIN both_ways ON a = r),
comp AS (SELECT pid, min(r) AS component FROM reach GROUP BY pid)"""


def clusters(thresholds) -> str:
    """Complete linkage: a step merges the closest clusters of each component; what only one of them is close to is close to neither.

    Rows of ``link`` are the links left (a, b, d) and the merges (target, gone, height).
    """
    return f"""link AS (SELECT component, i AS a, j AS b, dist AS d, NULL::BIGINT AS target, NULL::BIGINT AS gone, NULL::DOUBLE AS height FROM close JOIN comp ON pid = i
  UNION ALL (WITH best AS (SELECT component, arg_min(a, (d, a, b)) AS x, arg_min(b, (d, a, b)) AS y, min(d) AS h FROM link WHERE a IS NOT NULL GROUP BY component),
    moved AS (SELECT component, CASE WHEN a = y THEN x ELSE a END AS a, CASE WHEN b = y THEN x ELSE b END AS b, d, a IN (x, y) OR b IN (x, y) AS touched FROM link JOIN best USING (component) WHERE a IS NOT NULL AND NOT (a = x AND b = y))
    SELECT component, least(a, b), greatest(a, b), max(d), NULL, NULL, NULL FROM moved GROUP BY component, least(a, b), greatest(a, b), touched HAVING NOT touched OR count(*) = 2
    UNION ALL SELECT component, NULL, NULL, NULL, x, y, h FROM best)),
named AS (SELECT eps, pid, pid AS c FROM comp CROSS JOIN (SELECT unnest([{", ".join(map(str, thresholds))}]::DOUBLE[]) AS eps) UNION ALL SELECT eps, pid, target FROM named JOIN link ON gone = c AND height < eps),
clustered AS (SELECT eps, pid, min(c) AS cluster_id FROM named GROUP BY eps, pid)"""


TUNED = """truth AS (SELECT p.i, p.j FROM pairs p JOIN worded a ON a.pid = p.i JOIN worded b ON b.pid = p.j WHERE a.model_id = b.model_id),
inside AS (SELECT a.eps, p.i, p.j FROM pairs p JOIN clustered a ON a.pid = p.i JOIN clustered b ON b.pid = p.j AND b.eps = a.eps AND b.cluster_id = a.cluster_id),
counts AS (SELECT eps, coalesce(found, 0) AS found, coalesce(tp, 0) AS tp, (SELECT count(*) FROM truth) AS possible, (SELECT count(*) FROM pairs) AS number, (SELECT count(*) FROM worded) AS n
    FROM (SELECT DISTINCT eps FROM clustered) LEFT JOIN (SELECT eps, count(*) AS found, count(t.i) AS tp FROM inside LEFT JOIN truth t USING (i, j) GROUP BY eps) USING (eps)),
scored AS (SELECT *, coalesce(tp / nullif(found, 0), 0.0) AS pq, coalesce(tp / nullif(possible, 0), 0.0) AS pc FROM counts),
tuned AS (SELECT eps, tp, found - tp AS fp, possible - tp AS fn, round(pq, 6) AS pq, round(pc, 6) AS pc, round(coalesce(2 * pq * pc / nullif(pq + pc, 0), 0.0), 6) AS f1_star, round(number / (n * (n - 1) / 2), 6) AS fraction, found FROM scored)"""
