"""SQL, for DuckDB, that must give the rows of those queries that SQL can express."""

from __future__ import annotations

from ledgerline.llm import quality, queries, secrets
from ledgerline.llm.embedding_dedup import LEAST

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def url_filter() -> str:
    return rf"""WITH rules(h, p, v) AS ({values(queries.URL_RULES)}), blocked(h) AS ({values([(h,) for h in queries.BLOCKED_HOSTS])}),
x AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
y AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM x),
f AS (SELECT y.page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.v, length(rules.h || rules.p)) AS v FROM y JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT y.page_id, host, path, rule, coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE host = b.h OR ends_with(host, '.' || b.h)) THEN 'block' ELSE 'allow' END) AS verdict FROM y LEFT JOIN f USING (page_id)"""


def embeddings() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS a, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT p.a, q.a AS b FROM v p JOIN v q ON p.label = q.label AND p.a <> q.a AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= {LEAST}),
n AS (SELECT vec_id AS a FROM embeddings),
walk(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM walk w JOIN l ON l.a = w.b),
c AS (SELECT a, min(b) AS c FROM walk GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT n.a AS vec_id, coalesce(k.n, 0) AS n_links, least(n.a, coalesce(c.c, n.a)) AS component_id, n.a <= coalesce(c.c, n.a) AS kept FROM n LEFT JOIN c USING (a) LEFT JOIN k USING (a)"""


def minhash() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
walk(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM walk w JOIN l ON l.a = w.b),
c AS (SELECT a, min(b) AS c FROM walk GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.c, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""


def quality_rules(max_loss: float = 0.5, short_line: int = 8, heavy_punctuation: float = 0.6) -> str:
    bare = lambda text, chars: f"translate({text}, {quoted(chars)}, '')"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM d),
starts AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i : i + 7])) AS k FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS at FROM starts, range(8) t(j) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), real AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) + length(regexp_replace(line, {quoted(quality.UNSPACED)}, '', 'g')) // 2 AS n FROM lines WHERE regexp_matches(line, '{WORD}')),
judged AS (SELECT *, length(line) - length({bare("line", quality.MARKS)}) AS marks, length(line) - length({bare("line", quality.SEPARATORS)}) AS seps FROM real),
good AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(length(translate(line, {blanks}, ''))) FILTER (NOT ((n < {short_line} AND NOT regexp_matches(line, {quoted(quality.CLOSING)})) OR (n >= 5 AND marks > {heavy_punctuation} * n) OR (seps >= 2 AND n - seps <= 4 * seps) OR (n < {quality.LONG_LINE} AND regexp_matches(lower(line), {quoted(quality.PHRASES)})))), 0) AS kept_chars FROM judged GROUP BY 1),
base AS (SELECT w.doc_id, len(w) AS n_words, length(translate(text, {blanks}, '')) AS word_chars, length(text) - length({bare("text", quality.SYMBOLS)}) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars FROM w LEFT JOIN again USING (doc_id) LEFT JOIN good USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars - kept_chars <= {max_loss} * word_chars AS kept FROM f"""


def substring_dedup() -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: sha256(array_to_string(w[i : i + 19], ' ')))) AS k FROM w WHERE len(w) >= 20),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS at FROM r, range(20) t(j)), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
left_ AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.at) AS text FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS at FROM w) u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.at = u.at WHERE g.at IS NULL GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(l.text, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN left_ l USING (doc_id)"""


def secret_scan() -> str:
    parts = []
    for order, rule in enumerate([*secrets.BASE_RULES, *secrets.MORE_RULES]):
        p = quoted(rule.pattern)
        parts.append(
            f"SELECT doc_id, {order} AS o, {quoted(rule.kind)} AS kind, unnest(regexp_extract_all(text, {p}, 0)) AS m, unnest(regexp_extract_all(text, {p}, {rule.group})) AS v, unnest(string_split_regex(text, {p})[1 : len(regexp_extract_all(text, {p}, 0))]) AS gap, "
            f"unnest(range(len(regexp_extract_all(text, {p}, 0)))) AS k, {rule.least} AS least FROM d WHERE regexp_matches(text, {p})"
        )
    found = " UNION ALL ".join(parts)
    joined = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER ({where}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
g AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY k) AS BIGINT) AS stop FROM f), s AS (SELECT doc_id, o, kind, stop - length(m) AS start, stop FROM g WHERE length(v) >= least),
t AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {joined(f"o < {len(secrets.BASE_RULES)}")} AS base, {joined("true")} AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter(), "op4_embedding_dedup": embeddings(), "op5_minhash": minhash(), "op6_quality_rules": quality_rules(),
        "op7_substring_dedup": substring_dedup(), "op10_secret_scan": secret_scan(),
    }
