"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# White space runs to one space, then plain grouping.
EXACT_DEDUP = r"""
WITH plain AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM plain
"""

# What the archives must give back.
WARC = """
WITH page AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), first AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS of_equals FROM page
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = of_equals THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> of_equals THEN of_equals END AS refers_to
FROM first
"""

# Entries become intervals; every capture meets those of its keys that hold its time.
URL_FILTER = r"""
WITH url AS (
    SELECT page_id, url, epoch_us(TIMESTAMP '2024-01-01') // 1000000 + (page_id * 997 % 43200) * 60 AS fetched_at,
           nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '') AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
    FROM pages
), entry AS (
    SELECT event_type AS list, epoch_us(ts::TIMESTAMP) AS moment, event_id % 2 = 0 AS listed,
           CASE event_id % 3 WHEN 0 THEN host
                WHEN 1 THEN CASE WHEN len(string_split(host, '.')) > 3 THEN regexp_replace(host, '^[^.]+[.]', '') ELSE host END
                ELSE concat_ws('/', host, string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/')[2]) END AS key
    FROM events JOIN url ON user_id = page_id
), once AS (
    SELECT list, key, moment, max(listed) AS listed FROM entry WHERE key IS NOT NULL AND moment IS NOT NULL GROUP BY ALL
), turn AS (
    SELECT *, lag(listed) OVER (PARTITION BY list, key ORDER BY moment) AS earlier FROM once
), span AS (
    SELECT *, lead(moment) OVER (PARTITION BY list, key ORDER BY moment) AS upto
    FROM turn WHERE (earlier IS NULL AND listed) OR earlier <> listed
), asked AS (
    SELECT page_id, fetched_at, string_split(host, '.') AS labels, host,
           list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM url WHERE host IS NOT NULL
), probe AS (
    SELECT DISTINCT page_id, fetched_at, unnest(list_concat(
        list_transform(range(1, greatest(len(labels), 2)), lambda k: array_to_string(labels[k:], '.')),
        list_transform(range(1, len(parts) + 1), lambda k: host || '/' || array_to_string(parts[:k], '/')))) AS key
    FROM asked
), hit AS (
    SELECT page_id, count(DISTINCT list) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
           string_agg(DISTINCT key, ',' ORDER BY key) AS keys
    FROM probe JOIN span USING (key)
    WHERE listed AND fetched_at * 1000000 >= moment AND (upto IS NULL OR fetched_at * 1000000 < upto) GROUP BY page_id
)
SELECT page_id, url, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_lists,
       coalesce(lists, '') AS lists, coalesce(keys, '') AS keys
FROM url LEFT JOIN hit USING (page_id)
"""

# Every distance to every entry, two rounds.
VECTOR_CODES = """
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS (
    SELECT rid, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(16)) AS w(p)
), first AS (
    SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < 64
), c0 AS (
    SELECT p, e, x AS c FROM first JOIN part USING (rid)
), a0 AS (
    SELECT rid, p, arg_min(e, far * 64 + e) AS e, min(far) AS far FROM (
        SELECT rid, p, e, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))::BIGINT AS far
        FROM part JOIN c0 USING (p)) GROUP BY rid, p
), m0 AS (
    SELECT p, e, k, sum(x[k])::BIGINT AS s, count(*) AS n
    FROM a0 JOIN part USING (rid, p), unnest(range(1, len(x) + 1)) AS w(k) GROUP BY ALL
), n0 AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM m0 GROUP BY p, e
), c1 AS (
    SELECT p, e, coalesce(n0.c, c0.c) AS c FROM c0 LEFT JOIN n0 USING (p, e)
), a1 AS (
    SELECT rid, p, arg_min(e, far * 64 + e) AS e, min(far) AS far FROM (
        SELECT rid, p, e, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))::BIGINT AS far
        FROM part JOIN c1 USING (p)) GROUP BY rid, p
), m1 AS (
    SELECT p, e, k, sum(x[k])::BIGINT AS s, count(*) AS n
    FROM a1 JOIN part USING (rid, p), unnest(range(1, len(x) + 1)) AS w(k) GROUP BY ALL
), n1 AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM m1 GROUP BY p, e
), c2 AS (
    SELECT p, e, coalesce(n1.c, c1.c) AS c FROM c1 LEFT JOIN n1 USING (p, e)
), a2 AS (
    SELECT rid, p, arg_min(e, far * 64 + e) AS e, min(far) AS far FROM (
        SELECT rid, p, e, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))::BIGINT AS far
        FROM part JOIN c2 USING (p)) GROUP BY rid, p
), book AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
), code AS (
    SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM code JOIN kept USING (rid), book
"""

# Every passage of 400 bytes, as hex digits; islands of covered bytes and what is between them.
SUFFIX_DEDUP = """
WITH doc AS (
    SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), size AS (
    SELECT rid, doc_id, h, length(h) // 2 AS n FROM doc
), passage AS (
    SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM size, unnest(range(0, n - 399)) AS w(i) WHERE n >= 400
), hit AS (
    SELECT rid, i FROM passage QUALIFY count(*) OVER (PARTITION BY m) > 1
), turn AS (
    SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 400, true)::INT AS new FROM hit
), island AS (
    SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM turn
), span AS (
    SELECT rid, k, min(i) AS a, max(i) + 400 AS b FROM island GROUP BY rid, k
), cut AS (
    SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e
    FROM span GROUP BY rid
), piece AS (
    SELECT rid, doc_id, n, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           list_concat([0], coalesce(e, [])) AS s, list_concat(coalesce(s, []), [n]) AS e
    FROM size LEFT JOIN cut USING (rid)
)
SELECT doc_id, n AS n_bytes, n_removed, n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(s) + 1), lambda k: substr(h, 2 * s[k] + 1, 2 * (e[k] - s[k]))), ''))) AS kept_sha256
FROM piece
"""

# Every document against every order, by sets of failed filters.
FILTER_AUDIT = r"""
WITH word AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), mark AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), verdict AS (
    SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
                  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM word LEFT JOIN mark USING (doc_id)
), pattern AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM verdict GROUP BY part, fails
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), sequence AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), step AS (
    SELECT filter_order, k AS step, strpos('ABCDE', filter_order[k]) AS f,
           list_transform(range(1, k), lambda i: strpos('ABCDE', filter_order[i])) AS earlier
    FROM sequence, unnest(range(1, 6)) AS w(k)
), met AS (
    SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS own,
           len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
           len(list_filter(fails, lambda x: x)) = 1 AS alone
    FROM pattern, step
), told AS (
    SELECT part, filter_order, step, f,
           sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN own AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""

ORACLE: dict[str, str] = {
    "op1_warc": WARC,
    "op5_url_filter": URL_FILTER,
    "op8_exact_dedup": EXACT_DEDUP,
    "op11_vector_codes": VECTOR_CODES,
    "op12_suffix_dedup": SUFFIX_DEDUP,
    "op13_filter_audit": FILTER_AUDIT,
}
