"""DuckDB SQL for the queries that SQL can express. The other queries are tested against brute force."""

from __future__ import annotations

from weft.llm import secrets

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM words)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * common >= 4 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, c.class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM documents JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON c.a = doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = doc_id
"""

BYTE_REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substring(x, 2 * i - 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(1, n - 48)) AS i FROM d)),
low AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN low USING (s) WHERE m < w.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, p, substring(x, 2 * p - 1, 2) AS x FROM (SELECT doc_id, x, unnest(range(1, n + 1)) AS p FROM d)),
kept AS (SELECT b.doc_id, string_agg(b.x, '' ORDER BY b.p) AS x FROM bytes b ANTI JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(runs.n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

WORD_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS h FROM documents),
w AS (SELECT doc_id, i, array_to_string(h[i : i + 34], ' ') AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) - 33)) AS i FROM d)),
many AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM w SEMI JOIN many USING (s)),
words AS (SELECT doc_id, unnest(h) AS x, unnest(range(1, len(h) + 1)) AS p FROM d),
kept AS (SELECT b.doc_id, string_agg(b.x, ' ' ORDER BY b.p) AS x FROM words b ANTI JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, len(h)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

TOP_K = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS size FROM words GROUP BY ALL),
all_ AS (SELECT count(*) AS docs, (SELECT count(*) FROM words) / count(*) AS mean FROM documents),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY ALL),
scored AS (
    SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
    FROM tf q JOIN tf d ON q.w = d.w JOIN df ON df.w = d.w JOIN sizes s ON s.doc_id = d.doc_id CROSS JOIN all_ WHERE q.doc_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""

def _secrets() -> str:
    """Spans of each kind from the texts between its matches; DuckDB's expressions have no look-around and no possessive
    loops, so that a jwt is matched with the character before it, which is then taken off."""
    ours = {r.kind: r.pattern for r in secrets.RULES}
    ours["pem"] = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    ours["jwt"] = r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    group = {r.kind: (r.group, r.least) for r in secrets.RULES}
    each = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {k} AS number, {1 if kind == "jwt" else 0} AS cut, {group[kind][1]} AS least,
        list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, regexp_extract_all(t, '{p}') AS found, list_transform(regexp_extract_all(t, '{p}', {group[kind][0]}), lambda x: length(x)) AS inner_
        FROM d WHERE regexp_matches(t, '{p}')"""
        for k, (kind, p) in enumerate((kind, pattern.replace("'", "''")) for kind, pattern in ours.items())
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
each AS ({each}),
one AS (SELECT doc_id, kind, number, cut, least, unnest(range(1, len(found) + 1)) AS i, gaps, found, inner_ FROM each),
placed AS (SELECT *, list_sum(gaps[1 : i]) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) AS a, found[i] AS m FROM one WHERE inner_[i] >= least),
spans AS (SELECT doc_id, kind, number, (a + CASE WHEN cut = 1 AND m[1] <> 'e' THEN 1 ELSE 0 END)::BIGINT AS a, (a + length(m))::BIGINT AS z FROM placed),
listed AS (
    SELECT doc_id, count(*) FILTER (WHERE number = 0) AS n_assign, count(*) FILTER (WHERE number = 1) AS n_access, count(*) FILTER (WHERE number = 2) AS n_hex,
        string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, number) FILTER (WHERE number < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, number) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


ORACLES = {"op4_chosen_path_join": NEAR_DUPLICATES, "op5_suffix_dedup": BYTE_REPEATS, "op8_recompression": WORD_REPEATS, "op9_secret_scans": _secrets(), "op10_top_k": TOP_K}
