"""DuckDB SQL for those queries of this subpackage that SQL can express, over whole tables.

The others (a fitted classifier, hash-ordered blocks, frames of a video, a scored tree, merges of a
tokenizer) are held against plain Python in tests/llm.
"""

from __future__ import annotations

from .repeats import SIZE

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, least length) in the order of the kinds; the length of an assignment is that of its value.
_SECRETS = (
    ("assign", _ASSIGN, 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]+", 24),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("jwt", "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 29),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def jaccard(ngram: int = 5, per_cent: int = 80) -> str:
    """Shingle sets as lists, pairs by shared shingles, the smallest id over all links."""
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < {ngram} THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - {ngram - 2}), lambda i: array_to_string(list_slice(words, i, i + {ngram - 1}), ' '))) END AS shingles FROM w
), n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(shingles), chr(10))) AS same FROM s),
first AS (SELECT same, min(doc_id) AS rep FROM n WHERE n_shingles > 0 GROUP BY same),
t AS (SELECT doc_id, unnest(shingles) AS shingle FROM s WHERE doc_id IN (SELECT rep FROM first)),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= {per_cent} * (a.n_shingles + b.n_shingles - k)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT rep AS id, rep AS other FROM first UNION SELECT reach.id, edge.v FROM reach JOIN edge ON edge.u = reach.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT n.doc_id, n.n_shingles, coalesce(comp.component, n.doc_id) AS component_id
FROM n LEFT JOIN first ON first.same = n.same AND n.n_shingles > 0 LEFT JOIN comp ON comp.id = first.rep
"""


def warc() -> str:
    """Digests in base32, and for each payload the smallest page."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
d AS (SELECT page_id, first, octet_length(encode(p.payload)) AS n, sha1(p.payload) AS hex FROM p JOIN f ON p.payload = f.payload)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d
"""


def secrets() -> str:
    """Each kind's matches by regular expression; where they start, from the lengths of what is around them."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(x, {_quoted(p)}) AS ms, string_split_regex(x, {_quoted(p)}) AS parts FROM t"
        for k, (kind, p, least) in enumerate(_SECRETS)
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), found AS ({found}),
each AS (SELECT doc_id, k, kind, least, ms, parts, unnest(range(1, len(ms) + 1)) AS i FROM found WHERE len(ms) > 0),
placed AS (
    SELECT doc_id, k, kind, least, ms[i] AS m,
        list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS a FROM each
), kept AS (
    SELECT doc_id, k, kind, CAST(a AS BIGINT) AS a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(m) AS BIGINT) AS VARCHAR) AS span FROM placed
    WHERE length(CASE WHEN k = 0 THEN regexp_extract(m, {_quoted(_ASSIGN)}, 2) ELSE m END) >= least
), rows AS (
    SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
        string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM kept GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN rows ON rows.doc_id = t.doc_id
"""


def repeats(size: int = SIZE, piece: int = 1000) -> str:
    """Every window of every text as hexadecimal digits; texts are cut into overlapping pieces first."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
cut AS (SELECT doc_id, n, x, unnest(range(0, n - {size - 1}, {piece})) AS begin FROM t WHERE n >= {size}),
p AS (SELECT doc_id, n, begin, substr(x, 2 * begin + 1, {2 * (piece + size - 1)}) AS x FROM cut),
w AS (SELECT doc_id, begin, x, unnest(range(0, least({piece}, n - {size - 1} - begin))) AS k FROM p),
v AS (SELECT doc_id, begin + k AS pos, md5(substr(x, 2 * k + 1, {2 * size})) AS same FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY same ORDER BY doc_id, pos) AS nth FROM v),
c AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r WHERE nth > 1),
g AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT doc_id, run, min(pos) AS a, max(pos) + {size} AS z FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1),
        lambda i: substr(x, CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END,
            2 * (CASE WHEN i = len(starts) THEN n ELSE starts[i + 1] END) - CASE WHEN i = 0 THEN 0 ELSE 2 * ends[i] END)), '') END)) AS kept_sha256
FROM t LEFT JOIN l ON l.doc_id = t.doc_id
"""


ORACLE_SQL = {
    "op6_jaccard_heavy_light": jaccard(),
    "op7_warc_zstd": warc(),
    "op9_secret_automaton": secrets(),
    "op10_repeated_strings": repeats(),
}
