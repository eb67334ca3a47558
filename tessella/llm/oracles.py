"""DuckDB SQL for the queries that SQL can state: the contracts in plain terms, without the operators' methods."""

from __future__ import annotations

from . import minhash, suffixes

WORD = "[^\\x20\\x09-\\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def repeated_bytes(length: int = suffixes.LENGTH, block: int = 2000) -> str:
    """Rows of suffixes.reported(): every window of `length` bytes by its digest. Texts are cut to blocks first, as a place far into a long text is slow to reach."""
    return f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT r, b, substr(x, 2 * b + 1, 2 * ({block} + {length} - 1)) AS part FROM raw, LATERAL (SELECT unnest(range(0, CAST(len(x) // 2 AS BIGINT), {block})) AS b)),
windows AS (SELECT r, b + o AS p, md5(substr(part, 2 * o + 1, 2 * {length})) AS d FROM blocks, LATERAL (SELECT unnest(range(0, least({block}, CAST(len(part) // 2 AS BIGINT) - {length} + 1))) AS o)),
twice AS (SELECT d FROM windows GROUP BY d HAVING count(*) > 1),
hits AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -{2 * length}) > {length} AS new FROM windows SEMI JOIN twice USING (d)),
runs AS (SELECT r, min(p) AS a, max(p) + {length} AS z FROM (SELECT r, p, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY p) AS k FROM hits) GROUP BY r, k),
edges AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS prior, lead(a) OVER (PARTITION BY r ORDER BY a) AS later FROM runs),
kept AS (SELECT r, string_agg(substr(x, 2 * prior + 1, 2 * (a - prior)) || CASE WHEN later IS NULL THEN substr(x, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS x, sum(z - a) AS gone, count(*) AS spans FROM edges JOIN raw USING (r) GROUP BY r)
SELECT doc_id, CAST(len(raw.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, raw.x))) AS kept_sha256
FROM raw LEFT JOIN kept USING (r)"""


def near_duplicates(words: int = minhash.WORDS, percent: int = 75) -> str:
    """Rows of minhash.near_duplicates() for unique ids: all pairs that share a shingle, and what they reach."""
    k = words
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) - {k - 2} AS BIGINT)), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u AS doc_id, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


def interleaved(shards: int = 40, seed: str = "shards") -> str:
    """Rows of shards.shard_report() for unique ids; crc32 is worked out byte by byte (reflected polynomial 0xEDB88320)."""
    step = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda c: {step}) AS t),
b AS (SELECT doc_id, source, encode(coalesce(text, '')) AS x FROM documents),
c AS (SELECT doc_id, source, octet_length(x) + 16 AS size, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(x), '..'), lambda y: CAST('0x' || y AS BIGINT)), lambda a, y: xor(a >> 8, t.t[(xor(a, y) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
h AS (SELECT *, coalesce('s' || source, '') AS s, md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR))) AS h FROM c),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS f, count(*) OVER () AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, h, s, doc_id) - 1 AS p FROM f),
g AS (SELECT *, (p * {shards}) // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(p - (shard * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM g"""
