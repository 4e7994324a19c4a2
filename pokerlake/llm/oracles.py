"""SQL counterparts of the corpus queries that SQL can express, by plain definition."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
         windows AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 34), ' ') AS win
                     FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS s FROM w) x),
         often AS (SELECT win FROM windows GROUP BY win HAVING COUNT(*) > 1),
         gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(s, s + 34)) AS p FROM windows SEMI JOIN often USING (win)) x),
         words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
         marked AS (SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS is_gone FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p),
         kept AS (SELECT doc_id, COUNT(*) FILTER (WHERE is_gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT is_gone) AS text FROM marked GROUP BY 1)
    SELECT w.doc_id, len(ws) AS n_words, COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

EMBEDDING_LINKS = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                         WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
         links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
         reach(id, other) AS (SELECT a, b FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
         component AS (SELECT id, MIN(other) AS smallest FROM reach GROUP BY 1),
         degree AS (SELECT a, COUNT(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, COALESCE(n, 0) AS n_links, LEAST(vec_id, COALESCE(smallest, vec_id)) AS component_id, vec_id <= COALESCE(smallest, vec_id) AS kept
    FROM embeddings LEFT JOIN degree ON a = vec_id LEFT JOIN component ON id = vec_id"""

NEAR_DUPLICATES = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
         runs AS (SELECT doc_id, array_to_string(list_slice(ws, s, s + 4), ' ') AS run
                  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS s FROM w) x),
         weighted AS (SELECT doc_id, run, 1 + floor(log2(COUNT(*))) AS weight FROM runs GROUP BY 1, 2),
         total AS (SELECT doc_id, SUM(weight) AS total FROM weighted GROUP BY 1),
         shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.weight AS x, b.weight AS y, COUNT(*) AS n
                    FROM weighted a JOIN weighted b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
         met AS (SELECT a, b, SUM(n) AS n, SUM(n * x) AS x, SUM(n * y) AS y FROM shared GROUP BY 1, 2),
         terms AS (SELECT s.a, s.b, s.n / ((ta.total - met.x) / s.x + (tb.total - met.y) / s.y + SUM(o.n * greatest(o.x / s.x, o.y / s.y))) AS term
                   FROM shared s JOIN met ON met.a = s.a AND met.b = s.b JOIN shared o ON o.a = s.a AND o.b = s.b
                   JOIN total ta ON ta.doc_id = s.a JOIN total tb ON tb.doc_id = s.b
                   GROUP BY s.a, s.b, s.x, s.y, s.n, ta.total, tb.total, met.x, met.y),
         alike AS (SELECT a, b FROM terms GROUP BY a, b HAVING SUM(term) >= 0.8 - 1e-12),
         links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
         reach(id, other) AS (SELECT a, b FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
         component AS (SELECT id, MIN(other) AS smallest FROM reach GROUP BY 1)
    SELECT doc_id, LEAST(doc_id, COALESCE(smallest, doc_id)) AS class_id, doc_id <= COALESCE(smallest, doc_id) AS kept FROM documents LEFT JOIN component ON id = doc_id"""

HOST_REPUTATION = r"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
         h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
         p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
         outcome AS (SELECT doc_id, MAX(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
         hosts AS (SELECT host, COUNT(bad) AS n, COALESCE(SUM(bad), 0) AS k, list_last(string_split(host, '.')) AS suffix,
                          array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain
                   FROM p LEFT JOIN outcome ON TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) AS BIGINT) = doc_id GROUP BY 1),
         total AS (SELECT (SUM(k) + 0.5) / (SUM(n) + 1.0) AS m0 FROM hosts),
         s AS (SELECT suffix, SUM(n) AS n, SUM(k) AS k, ANY_VALUE(m0) AS m FROM hosts, total GROUP BY 1),
         s_strength AS (SELECT 1 / least(greatest(COALESCE((SUM((k - n * m) ** 2) - SUM(n * m * (1 - m))) / NULLIF(SUM((n - 1) * n * m * (1 - m)), 0), 1.0 / 3), 1.0 / 1001), 1.0 / 3) - 1 AS w FROM s),
         d AS (SELECT x.*, (s.k - x.k + w * m0) / (s.n - x.n + w) AS m
               FROM (SELECT suffix, domain, SUM(n) AS n, SUM(k) AS k FROM hosts GROUP BY 1, 2) x JOIN s ON s.suffix = x.suffix, s_strength, total),
         d_strength AS (SELECT 1 / least(greatest(COALESCE((SUM((k - n * m) ** 2) - SUM(n * m * (1 - m))) / NULLIF(SUM((n - 1) * n * m * (1 - m)), 0), 1.0 / 3), 1.0 / 1001), 1.0 / 3) - 1 AS w FROM d),
         x AS (SELECT host, hosts.n, hosts.k, (d.k - hosts.k + w * d.m) / (d.n - hosts.n + w) AS m
               FROM hosts JOIN d ON d.suffix = hosts.suffix AND d.domain = hosts.domain, d_strength),
         x_strength AS (SELECT 1 / least(greatest(COALESCE((SUM((k - n * m) ** 2) - SUM(n * m * (1 - m))) / NULLIF(SUM((n - 1) * n * m * (1 - m)), 0), 1.0 / 3), 1.0 / 1001), 1.0 / 3) - 1 AS w FROM x),
         posterior AS (SELECT host, n, m * w + k AS a, (1 - m) * w + n - k AS b FROM x, x_strength),
         scaled AS (SELECT *, ln(a / b) AS u0, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS sd FROM posterior),
         cells AS (SELECT host, n, a, b, u0, sd, u0 + sd * i / 20 AS u FROM scaled, (SELECT unnest(generate_series(-400, 400)) AS i) g),
         dense AS (SELECT host, n, least(greatest(u / (sd / 20) + 0.5, 0), 1) AS share,
                          exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - (a * u0 - (a + b) * (greatest(u0, 0) + ln(1 + exp(-abs(u0)))))) AS f FROM cells),
         tail AS (SELECT host, n, SUM(share * f) / SUM(f) AS p_bad FROM dense GROUP BY 1, 2),
         ruled AS (SELECT page_id, host, path,
                          CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                               WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                               WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                               WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN p_bad >= 0.95 THEN 'block' ELSE 'allow' END AS verdict,
           n AS n_labelled, round(p_bad, 6) AS p_bad
    FROM ruled JOIN tail USING (host)"""

MERKLE_MANIFEST = r"""
    WITH RECURSIVE parts AS (
             SELECT doc_id, lang, n_chars, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                           CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
                    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
                    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS n,
                    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS more FROM documents),
         hashed AS (SELECT doc_id, lang, sha256(concat(head, n, tail)) AS leaf, sha256(concat(head, more, tail)) AS changed FROM parts),
         leaves AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS n FROM hashed),
         tree(lang, lvl, pos, h, n) AS (
             SELECT lang, 0, pos, leaf, n FROM leaves
             UNION ALL
             SELECT lang, ANY_VALUE(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (ANY_VALUE(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, pos // 2),
         subroots AS (SELECT lang, h, lvl, ROW_NUMBER() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS n FROM tree WHERE n = 1),
         top(lvl, pos, h, n) AS (
             SELECT 0, pos, h, n FROM subroots
             UNION ALL
             SELECT ANY_VALUE(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (ANY_VALUE(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY pos // 2),
         start AS (SELECT l.doc_id, l.lang, leaf, l.pos, s.h AS subroot, s.pos AS place, ROW_NUMBER() OVER () AS nr, CASE WHEN {crc} % 7 = 0 THEN changed ELSE leaf END AS first
                   FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang),
         up(nr, lang, lvl, pos, folded, proof) AS (
             SELECT nr, lang, 0, pos, first, '' FROM start
             UNION ALL
             SELECT up.nr, up.lang, up.lvl + 1, up.pos // 2, sha256(CASE WHEN s.h IS NULL THEN folded WHEN s.pos < up.pos THEN s.h || folded ELSE folded || s.h END), proof || COALESCE(s.h, '')
             FROM up JOIN tree me ON me.lang IS NOT DISTINCT FROM up.lang AND me.lvl = up.lvl AND me.pos = up.pos AND me.n > 1
                  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM up.lang AND s.lvl = up.lvl AND s.pos = xor(up.pos, 1)),
         below AS (SELECT up.nr, up.folded, up.proof, start.place FROM up JOIN start USING (nr) JOIN subroots s ON s.lang IS NOT DISTINCT FROM up.lang AND s.lvl = up.lvl),
         high(nr, lvl, pos, folded, proof) AS (
             SELECT nr, 0, place, folded, proof FROM below
             UNION ALL
             SELECT high.nr, high.lvl + 1, high.pos // 2, sha256(CASE WHEN s.h IS NULL THEN folded WHEN s.pos < high.pos THEN s.h || folded ELSE folded || s.h END), proof || COALESCE(s.h, '')
             FROM high JOIN top me ON me.lvl = high.lvl AND me.pos = high.pos AND me.n > 1 LEFT JOIN top s ON s.lvl = high.lvl AND s.pos = xor(high.pos, 1)),
         root AS (SELECT lvl, h FROM top WHERE n = 1)
    SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
    FROM high JOIN root ON root.lvl = high.lvl JOIN start USING (nr)""".replace(
    "{crc}",
    "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), "
    "lambda c, ch: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, ch)), 4294967295))",
)

PERIODIC_RUNS = r"""
    WITH w AS (SELECT ROW_NUMBER() OVER () AS nr, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                      xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
                          lambda c, ch: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, ch)), 4294967295)) AS h FROM documents),
         seeded AS (SELECT nr, doc_id, ws, len(ws) AS n, COALESCE(h % 10 = 0, FALSE) AND len(ws) > 0 AS plant, h // 10 AS g FROM w),
         planted AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM seeded),
         items AS (SELECT nr, n, i, ws[1 + CASE WHEN plant AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM planted) x),
         pairs AS (SELECT x.nr, x.i, y.i - x.i AS q FROM items x JOIN items y ON y.nr = x.nr AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
         stretches AS (SELECT nr, q, MIN(i) AS start, COUNT(*) + q AS length FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY nr, q ORDER BY i) AS block FROM pairs) x
                       GROUP BY nr, q, block HAVING COUNT(*) + q >= greatest(6, 4 * q)),
         runs AS (SELECT nr, start, length, MIN(q) AS period FROM stretches GROUP BY 1, 2, 3),
         best AS (SELECT * FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY nr ORDER BY length / period DESC, start, period) = 1),
         listed AS (SELECT nr, COUNT(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS text FROM runs GROUP BY 1),
         gone AS (SELECT DISTINCT nr, unnest(range(start + period, start + length)) AS i FROM runs),
         kept AS (SELECT nr, string_agg(word, ' ' ORDER BY i) AS text FROM items ANTI JOIN gone USING (nr, i) GROUP BY 1)
    SELECT w.doc_id, COALESCE(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
           sha256(COALESCE(listed.text, '')) AS runs_sha256, sha256(COALESCE(kept.text, '')) AS collapsed_sha256
    FROM w LEFT JOIN best USING (nr) LEFT JOIN listed USING (nr) LEFT JOIN kept USING (nr)"""
