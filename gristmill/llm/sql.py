"""DuckDB statements for the queries of this package that SQL can express."""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup(documents: str = "documents", least: int = 10) -> str:
    return f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM {documents}),
lines AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM parts),
keyed AS (SELECT doc_id, i, line, translate(trim(line, {BLANKS}), {LETTERS}) AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS f FROM keyed WHERE length(key) >= {least}
           GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id > f.f, false) AS gone FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def substring_dedup(documents: str = "documents", window: int = 50) -> str:
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM {documents}),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p : p + {window} - 1], ' ')) AS h
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS p FROM w)),
firsts AS (SELECT h, min(doc_id) AS f FROM wins GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT DISTINCT wins.doc_id, p + unnest(range(0, {window})) AS i FROM wins JOIN firsts USING (h) WHERE wins.doc_id > f),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT each.doc_id, count(*) AS n, count(hits.i) AS gone,
         string_agg(word, ' ' ORDER BY each.i) FILTER (WHERE hits.i IS NULL) AS t
         FROM each LEFT JOIN hits ON each.doc_id = hits.doc_id AND each.i = hits.i GROUP BY each.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def license_scan(documents: str = "documents") -> str:
    from gristmill.llm.licenses import COVER, SHIFT, STRETCH, WORD, places

    values = ", ".join(f"({k}, '{label}', {phrase}, {size}, {i}, '{gram}')" for k, label, phrase, size, i, gram in places())
    return f"""
WITH t(template, label, phrase, size, place, gram) AS (VALUES {values}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORD}') AS w FROM {documents}),
g AS (SELECT r, unnest(range(0, len(w) - 1)) AS i, w FROM w WHERE len(w) > 1),
hits AS (SELECT r, i, template, label, phrase, size, place FROM (SELECT r, i, w[i + 1] || ' ' || w[i + 2] AS gram FROM g) JOIN t USING (gram)),
diagonals AS (SELECT r, template, label, phrase, size, i - place AS d, list(DISTINCT place) AS met, min(i) AS lo, max(i) + 1 AS hi
              FROM hits GROUP BY ALL HAVING count(DISTINCT place) >= CASE WHEN phrase THEN size - 1 ELSE 2 END),
steps AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) <= {SHIFT} THEN NULL ELSE d END AS fresh FROM diagonals WHERE NOT phrase),
chains AS (SELECT *, max(fresh) OVER (PARTITION BY r, template ORDER BY d ROWS UNBOUNDED PRECEDING) AS start FROM steps),
spans AS (SELECT r, label, len(list_distinct(flatten(list(met))))::DOUBLE / (size - 1) AS score
          FROM (SELECT *, (d - start) // ({STRETCH - 1} * size) AS part FROM chains) GROUP BY r, template, label, size, start, part),
marks AS (SELECT r, label, d AS start, true AS base, 1.0::DOUBLE AS score FROM diagonals WHERE phrase
          UNION ALL SELECT r, label, NULL, false, score FROM spans),
result AS (SELECT r, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR score >= {COVER}) AS labels, max(score) AS score
           FROM marks GROUP BY r)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN result ON w.r = result.r"""


def ranked_search(items: str = "benchmark", documents: str = "documents", top: int = 10) -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM {items}),
d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM {documents}),
total AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
v AS (SELECT DISTINCT term FROM q),
c AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) JOIN v USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), total),
m AS (SELECT r, doc_id, 10 + (90 * len(t)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM c JOIN w USING (term) JOIN m USING (r) JOIN q USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
WHERE rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": substring_dedup(), "op8_license_scan": license_scan(), "op10_line_dedup": line_dedup(), "op13_ranked_search": ranked_search()}
