"""SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers

from .suffix_dedup import LENGTH, PASSAGE

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingle p JOIN shingle q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
    JOIN size m ON m.doc_id = x.a JOIN size n ON n.doc_id = x.b WHERE 100 * c >= 75 * (m.n + n.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM documents d LEFT JOIN size USING (doc_id)
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v WHERE list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN least_of ON a = vec_id
"""

# The tokenizer's white space, and a mark that no text holds. Before the last white space of a run that something follows, the
# mark does what the pattern's look-ahead does: the run ends there, and its last character goes with what follows or by itself.
_BLANK = r"\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARK = "﷐"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}{_MARK}]+|[{_BLANK}]+".replace("'", "''")
OP5 = rf"""
WITH RECURSIVE vocabulary AS (SELECT hex(from_base64(t)) AS h, id FROM read_csv('{public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}', delim = ' ', header = false, quote = '', columns = {{'t': 'VARCHAR', 'id': 'BIGINT'}})),
split AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{_BLANK}])([^{_BLANK}])', '{_MARK}\1\2', 'g'), '{_PIECE}') AS pieces FROM documents),
piece AS (SELECT doc_id, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS pos FROM split),
step AS (
    SELECT p, regexp_extract_all(hex(p), '..') AS tokens, true AS live FROM (SELECT DISTINCT p FROM piece)
  UNION ALL
    (WITH pair AS (SELECT p, unnest(list_zip(tokens[:-2], tokens[2:])) AS ab, generate_subscripts(tokens[2:], 1) AS pos FROM step WHERE live AND len(tokens) > 1),
     best AS (SELECT p, arg_min(pos, (id, pos)) AS pos, arg_min(h, (id, pos)) AS h FROM pair JOIN vocabulary ON h = ab[1] || ab[2] GROUP BY p)
     SELECT p, CASE WHEN pos IS NULL THEN tokens ELSE tokens[:pos - 1] || [h] || tokens[pos + 2:] END, pos IS NOT NULL FROM step LEFT JOIN best USING (p) WHERE live)
),
token AS (SELECT p, k, h, id FROM (SELECT p, unnest(tokens) AS h, generate_subscripts(tokens, 1) AS k FROM step WHERE NOT live) JOIN vocabulary USING (h)),
done AS (SELECT doc_id, count(*) AS n, string_agg(substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2), '' ORDER BY pos, k) AS ids, string_agg(h, '' ORDER BY pos, k) AS raw
    FROM (SELECT doc_id, pos, k, h, printf('%08x', id) AS x FROM piece JOIN token USING (p)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_tokens, sha256(unhex(coalesce(ids, ''))) AS ids_sha256, sha256(unhex(coalesce(raw, ''))) AS decoded_sha256 FROM documents d LEFT JOIN done USING (doc_id)
"""

# Bytes are two hex digits each, so plain string functions serve; texts are cut up first, since these count from a string's start. A character ends before the next byte that doesn't continue one.
OP8 = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
part AS (SELECT doc_id, 512 * k AS base, substr(h, 1024 * k + 1, 1024 + 2 * {LENGTH}) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1024 + 1)) AS k FROM d)),
win AS (SELECT doc_id, base + o AS i, md5(substr(h, 2 * o + 1, 2 * {PASSAGE})) AS p, CASE WHEN 2 * o + 2 * {LENGTH} <= length(h) THEN md5(substr(h, 2 * o + 1, 2 * {LENGTH})) END AS s
    FROM (SELECT doc_id, base, h, unnest(range(0, least(512, length(h) // 2 - {PASSAGE} + 1))) AS o FROM part WHERE length(h) >= 2 * {PASSAGE})),
flag AS (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) > 1 AS later, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS every FROM win),
hit AS (SELECT doc_id, i, max(CASE WHEN later THEN i END) OVER w AS p, max(CASE WHEN every THEN i END) OVER w AS s FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
byte AS (SELECT doc_id, base + o AS i, substr(h, 2 * o + 1, 2) AS x FROM (SELECT doc_id, base, h, unnest(range(0, least(512, length(h) // 2))) AS o FROM part)),
cut AS (SELECT b.doc_id, b.i, x, coalesce(b.i < p + {PASSAGE}, false) AS later, coalesce(b.i < s + {LENGTH}, false) AS every
    FROM byte b ASOF LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.i <= b.i),
letter AS (SELECT *, sum((x < '80' OR x >= 'C0')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c, every AND NOT coalesce(lag(every) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cut),
whole AS (SELECT *, max(later) OVER (PARTITION BY doc_id, c) AS gone FROM letter),
got AS (SELECT doc_id, count(*) FILTER (every) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT every) AS kept, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS left_text FROM whole GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, decode(unhex(coalesce(left_text, ''))) AS text FROM d LEFT JOIN got USING (doc_id)
"""
