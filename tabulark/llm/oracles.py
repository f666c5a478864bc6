"""DuckDB SQL for the queries whose results SQL can express, over whole tables."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_WHITE = r"[\x20\x09-\x0D]"


def near_duplicates(table: str, width: int, percent: int) -> str:
    """``doc_id, n_shingles, component_id, kept`` from ``table`` (doc_id, text)."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE nd_words AS (SELECT doc_id, regexp_extract_all({lower}, '{_WORD}') AS w FROM {table}),
nd_sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS s
  FROM nd_words),
nd_rows AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM nd_sets),
nd_common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM nd_rows a JOIN nd_rows b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
nd_links AS MATERIALIZED (SELECT a, b FROM nd_common WHERE 100 * c >= {percent} * (na + nb - c)),
nd_reach(a, b) AS (SELECT a, b FROM nd_links UNION SELECT r.a, l.b FROM nd_reach r JOIN nd_links l ON r.b = l.a),
nd_least AS (SELECT a, min(b) AS b FROM nd_reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) AS kept
FROM nd_sets s LEFT JOIN nd_least l ON s.doc_id = l.a"""


def quality(table: str, gram: int = 5) -> str:
    """The quality columns of ``table`` (doc_id, text)."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    base = " OR ".join(r.text() for r in RULES if r.base)
    rules = " OR ".join(r.text() for r in RULES)
    return f"""
WITH q_words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM {table}),
q_lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l,
  list_transform(range(1, len(w) - {gram - 2}), lambda i: array_to_string(w[i:i + {gram - 1}], ' ')) AS g FROM q_words),
q_grams AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM q_lines),
q_again AS (SELECT doc_id, i FROM q_grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
q_gaps AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM q_again),
q_repeat AS (SELECT doc_id, sum(least({gram}, coalesce(j - i, {gram}))) AS n FROM q_gaps GROUP BY doc_id),
q_counts AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  CAST(coalesce(q_repeat.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
  FROM q_lines LEFT JOIN q_repeat USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({rules}) AS kept, n_lines, n_stop_words, n_capitals
FROM q_counts"""


def phrase_dedup(table: str, width: int = 13) -> str:
    """Words covered by windows that also start in a smaller document of ``table`` (doc_id, text)."""
    return f"""
WITH p_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM {table}),
p_windows AS (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM p_words),
p_text AS (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM p_windows),
p_hit AS (SELECT doc_id, i FROM p_text QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
p_gone AS (SELECT DISTINCT doc_id, i + k AS i FROM p_hit, range({width}) r(k)),
p_lists AS (SELECT doc_id, list(i) AS gone FROM p_gone GROUP BY doc_id),
p_kept AS (SELECT doc_id, p.i, p.x FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM p_words) p ANTI JOIN p_gone USING (doc_id, i)),
p_joined AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM p_kept GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM p_words LEFT JOIN p_lists USING (doc_id) LEFT JOIN p_joined USING (doc_id)"""


def bytes_dedup(table: str, width: int = 100) -> str:
    """Bytes covered by strings that also start earlier in ``table`` (doc_id, text)."""
    return f"""
WITH b_hex AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM {table}),
b_starts AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {width - 1}))) AS i FROM b_hex),
b_keys AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * width})) AS g FROM b_starts),
b_hit AS (SELECT doc_id, i FROM b_keys QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
b_step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS opens FROM b_hit),
b_runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b_step),
b_spans AS (SELECT doc_id, min(i) AS a, max(i) + {width} AS b FROM b_runs GROUP BY doc_id, run),
b_lists AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb FROM b_spans GROUP BY doc_id),
b_kept AS (SELECT doc_id, h, coalesce(n, 0) AS n, coalesce(gone, 0) AS gone, CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2),
  lambda k: substr(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE bb[k - 1] END) + 1, 2 * ((CASE WHEN k = n + 1 THEN length(h) // 2 ELSE aa[k] END) - (CASE WHEN k = 1 THEN 0 ELSE bb[k - 1] END)))), '') END AS k
  FROM b_hex LEFT JOIN b_lists USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM b_kept"""


WARC = """
WITH w_pages AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
w_first AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS response FROM w_pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    ('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM w_first"""

def collocations(least: int = 10, cover: int = 50, top: int = 2000) -> str:
    """Collocations of two and three words in ``documents``, from lists of all phrases."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = " || ".join(f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (1, 2, 3))
    cut = lambda left, right: f"""SELECT c.*, {1 if left == 'w1' else 2} AS k, x.f AS l, y.f AS r, CAST((1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM c_cand c JOIN c_f x ON x.lang = c.lang AND x.g = {left} JOIN c_f y ON y.lang = c.lang AND y.g = {right}"""  # noqa: E731
    return f"""
WITH c_piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
c_words AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM c_piece),
c_grams AS (SELECT lang, unnest({runs}) AS g FROM c_words),
c_f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM c_grams GROUP BY ALL),
c_n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM c_words GROUP BY lang),
c_cand AS MATERIALIZED (SELECT lang, g, f AS a, len(s) AS d, s[1] AS w1, s[1] || ' ' || s[2] AS w12, array_to_string(s[2:], ' ') AS rest, s[3] AS w3
  FROM (SELECT *, string_split(g, ' ') AS s FROM c_f WHERE f >= {least}) WHERE len(s) > 1),
c_cut AS ({cut("w1", "rest")} UNION ALL {cut("w12", "w3")} AND d = 3),
c_low AS (SELECT * FROM c_cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
c_long AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, w12 AS g, a AS f FROM c_cand WHERE d = 3 UNION ALL SELECT lang, rest, a FROM c_cand WHERE d = 3) GROUP BY lang, g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM c_low LEFT JOIN c_long USING (lang, g) JOIN c_n USING (lang) WHERE coalesce(100 * c_long.f, 0) < {cover} * a QUALIFY rank <= {top}"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Product codes of ``embeddings`` after plain Lloyd rounds over all pairs of parts and entries."""
    sql = f"""
WITH v_rows AS (SELECT row_number() OVER () AS row, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v_parts AS MATERIALIZED (SELECT row, vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM v_rows, range({parts}) r(p)),
v_book0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e FROM v_parts) WHERE e < {entries})"""
    near = lambda k: f"""
v_near{k} AS MATERIALIZED (SELECT row, a.p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT row, a.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v_parts a JOIN v_book{k} b ON a.p = b.p) a GROUP BY row, a.p)"""  # noqa: E731
    for k in range(rounds):
        sql += f""",{near(k)},
v_mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, CAST(floor(sum(y)::DECIMAL(38, 0) / count(*)) AS BIGINT) AS m FROM (
    SELECT n.p, n.e, unnest(x) AS y, unnest(range(len(x))) AS i FROM v_near{k} n JOIN v_parts a ON n.row = a.row AND n.p = a.p) GROUP BY p, e, i) GROUP BY p, e),
v_book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM v_book{k} b LEFT JOIN v_mean{k} m ON b.p = m.p AND b.e = m.e)"""
    return f"""{sql},{near(rounds)},
v_code AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM v_near{rounds} GROUP BY row),
v_hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM v_book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM v_code JOIN (SELECT DISTINCT row, vec_id, label FROM v_parts) USING (row), v_hash"""


ORACLES: dict[str, str] = {
    "op2_near_duplicates": near_duplicates("documents", 4, 80),
    "op4_quality_rules": quality("documents"),
    "op5_phrase_automata": phrase_dedup("documents"),
    "op7_warc": WARC,
    "op10_suffix_dedup": bytes_dedup("documents"),
    "op12_collocations": collocations(),
    "op13_vector_codes": vector_codes(),
}
