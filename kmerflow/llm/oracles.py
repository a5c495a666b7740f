"""DuckDB SQL for the queries that SQL can express in full. The others are tested against brute force."""

from __future__ import annotations

from .license_scan import DECIDING, PHRASES, TEMPLATES, THRESHOLD


def license_sql() -> str:
    """Every block of every text that holds enough of a template's words, by lists."""
    values = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    deciding = ", ".join(f"'{w}'" for w in sorted(DECIDING))
    def places(phrase):
        own = phrase.split()
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(own))
        return f"list_filter(range(1, len(w) - {len(own)} + 2), lambda i: {same})"
    base = ", ".join(f"{places(p)} AS p{k}" for k, p in enumerate(PHRASES))
    every = "list_concat(list_concat(p0, p1), p2)"
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    return rf"""
WITH tpl AS MATERIALIZED (
    SELECT label, len(t) AS step, own, list_filter(own, lambda x: regexp_full_match(x, '[0-9]+') OR x IN ({deciding})) AS must, CAST(ceil({THRESHOLD} * len(own) - 1e-9) AS BIGINT) AS need
    FROM (SELECT label, string_split(text, ' ') AS t, list_distinct(string_split(text, ' ')) AS own FROM (VALUES {values}) v(k, label, text))
), d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), near AS MATERIALIZED (
    SELECT r, w, label, step, own, must, need FROM d CROSS JOIN tpl WHERE len(list_intersect(own, w)) >= need
), blocks AS (
    SELECT r, label, own, must, need, w[lo + 1 : lo + 2 * step] AS b FROM (SELECT *, unnest(range(0, len(w), step)) AS lo FROM near)
), hits AS MATERIALIZED (
    SELECT r, label, CAST(len(list_intersect(own, b)) AS DOUBLE) / len(own) AS c FROM blocks WHERE len(list_intersect(own, b)) >= need AND len(list_intersect(must, b)) = len(must)
), found AS (
    SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY 1
), base AS (
    SELECT r, doc_id, w, {base} FROM d
), named AS (
    SELECT r, doc_id, len(w) AS n, {every} AS p, list_filter([{named}], lambda x: x IS NOT NULL) AS labels FROM base
)
SELECT doc_id, n AS n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word, array_to_string(list_sort(list_distinct(named.labels)), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(named.labels, coalesce(found.labels, [])))), ',') AS labels, greatest(CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END, coalesce(c, 0))::DOUBLE AS score
FROM named LEFT JOIN found USING (r)
"""


ORACLES: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op1_near_vectors": """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1
), n AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE tab AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))
), a AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), b AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 20 AS act
    FROM a, tab
), d AS (
    SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE act WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM b
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, regexp_extract_all(text, '[^\x20\x09-\x0D]') AS c FROM d
), f AS MATERIALIZED (
    SELECT *, CASE WHEN len(c) = 0 THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT c[-1] IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        substr(role, 1, 1) AS r, substr(role, 1, 1) || lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair, count(*) OVER (PARTITION BY conv_id) AS n
    FROM o
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY 1
), go AS (
    SELECT conv_id, n AS i, {'c': 0, 'e': '', 't': ['']} AS s0, {'c': 6, 'e': 'II', 't': ['user:', 'assistant:', '']} AS s1, {'c': 3, 'e': 'I', 't': ['assistant:', '']} AS s2, {'c': 0, 'e': '', 't': ['']} AS s3 FROM counts
    UNION ALL
    SELECT conv_id, i - 1, least(b0, {'c': 3 + b2.c, 'e': 'I' || b2.e, 't': list_prepend('user:', b2.t)}, {'c': 6 + b3.c, 'e': 'II' || b3.e, 't': list_concat(['user:', 'assistant:'], b3.t)}),
        least(b1, {'c': 3 + b2.c, 'e': 'I' || b2.e, 't': list_prepend('user:', b2.t)}, {'c': 6 + b3.c, 'e': 'II' || b3.e, 't': list_concat(['user:', 'assistant:'], b3.t)}),
        least(b2, {'c': 3 + b3.c, 'e': 'I' || b3.e, 't': list_prepend('assistant:', b3.t)}), least(b3, {'c': 3 + b2.c, 'e': 'I' || b2.e, 't': list_prepend('user:', b2.t)})
    FROM (
        SELECT conv_id, i,
            least({'c': 4 + s0.c, 'e': 'D' || s0.e, 't': s0.t}, {'c': CASE WHEN stay AND r = 's' THEN 0 ELSE 10000000 END + more + s1.c, 'e': 'K' || s1.e, 't': list_prepend(line, s1.t)}, {'c': CASE WHEN stay AND r = 'u' THEN 0 ELSE 10000000 END + more + s2.c, 'e': 'K' || s2.e, 't': list_prepend(line, s2.t)}, {'c': CASE WHEN stay THEN 3 ELSE 10000000 END + more + s2.c, 'e': 'R' || s2.e, 't': list_prepend('user:' || text, s2.t)}) AS b0,
            least({'c': 4 + s1.c, 'e': 'D' || s1.e, 't': s1.t}, {'c': CASE WHEN stay AND r = 'u' THEN 0 ELSE 10000000 END + more + s2.c, 'e': 'K' || s2.e, 't': list_prepend(line, s2.t)}, {'c': CASE WHEN stay THEN 3 ELSE 10000000 END + more + s2.c, 'e': 'R' || s2.e, 't': list_prepend('user:' || text, s2.t)}) AS b1,
            least({'c': 4 + s2.c, 'e': 'D' || s2.e, 't': s2.t}, {'c': CASE WHEN stay AND r = 'a' THEN 0 ELSE 10000000 END + more + s3.c, 'e': 'K' || s3.e, 't': list_prepend(line, s3.t)}, {'c': CASE WHEN stay THEN 3 ELSE 10000000 END + more + s3.c, 'e': 'R' || s3.e, 't': list_prepend('assistant:' || text, s3.t)}) AS b2,
            least({'c': 4 + s3.c, 'e': 'D' || s3.e, 't': s3.t}, {'c': CASE WHEN stay AND r = 'u' THEN 0 ELSE 10000000 END + more + s2.c, 'e': 'K' || s2.e, 't': list_prepend(line, s2.t)}, {'c': CASE WHEN stay THEN 3 ELSE 10000000 END + more + s2.c, 'e': 'R' || s2.e, 't': list_prepend('user:' || text, s2.t)}) AS b3
        FROM (SELECT g.conv_id, g.i, s0, s1, s2, s3, r, text, role || ':' || text AS line, fault IN ('', 'truncated') AS stay, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM go g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i)
    )
), best AS (
    SELECT conv_id, s0 FROM go WHERE i = 0
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.e, '') AS audit, sha256(coalesce(array_to_string(s0.t[1:-2], chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
    "op13_importance_resampling": r"""
WITH RECURSIVE tab AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))
), texts AS (
    SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark
), w AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), g AS MATERIALIZED (
    SELECT r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w
), d AS (
    SELECT DISTINCT g FROM g
), hex AS (
    SELECT g, list_transform(range(0, strlen(g)), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT)) AS b FROM d
), bucket AS MATERIALIZED (
    SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM hex, tab
), n AS (
    SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM g JOIN bucket USING (g) GROUP BY 1
), total AS (
    SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM n
), gain AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, total
), weight AS (
    SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM g JOIN bucket USING (g) JOIN gain USING (bucket) WHERE own GROUP BY 1
), scored AS MATERIALIZED (
    SELECT doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM w LEFT JOIN weight USING (r) WHERE own
), ranks AS (
    SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place, count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS draw FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM ranks
""",
}
