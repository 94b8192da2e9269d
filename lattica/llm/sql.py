"""DuckDB SQL for those operations that SQL can express over whole tables."""


def repeats(length: int) -> str:
    """Words covered by windows of this many words that start twice or more."""
    return f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
             w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
             v AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM w
                   WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)),
             twice AS (SELECT s FROM v WHERE n = {length} GROUP BY s HAVING count(*) > 1),
             m AS (SELECT v.doc_id, v.i, v.word, CASE WHEN v.n = {length} AND twice.s IS NOT NULL THEN 1 ELSE 0 END AS hit FROM v LEFT JOIN twice ON v.s = twice.s),
             c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
             k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """


ORACLES = {
    "op2_substring_dedup": repeats(35),
    "op5_jaccard_join": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
             w AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
             v AS (SELECT doc_id, total, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n, i FROM w
                   WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
             sh AS (SELECT DISTINCT doc_id, s FROM v WHERE n = 5 OR (total < 5 AND i = 1)),
             z AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
             o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM o JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN z ON z.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op6_suffix_dedup": repeats(40),
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
}
