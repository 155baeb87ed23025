"""Checking SQL for the queries SQL can express, written the plain way over whole tables."""

from __future__ import annotations

from .decontamination import WINDOW
from .near_duplicates import PERCENT, SHINGLE
from .resampling import BUCKETS, LEAST_WORDS, PERCENT as DRAWN, POLYNOMIAL, SEED
from .topk import EVERY, K, SCALE

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f'coalesce({text}, {chr(39) * 2})')}, '{pattern}')"


# Forty bits of a digest at a time, five bits a letter.
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + "
    "((CAST('0x' || substr(digest, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1)), '')"
)
WARC = (
    "WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), "
    "hashed AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS digest, "
    "max(page_id) OVER (PARTITION BY payload) AS original FROM payloads) "
    f"SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id <> original THEN original END AS refers_to FROM hashed"
)

TOP_K = (
    f"WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings "
    "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score "
    f"FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored) "
    f"SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM ranked WHERE place <= {K}"
)

DECONTAMINATION = (
    "WITH docs AS (SELECT doc_id, {words} AS w FROM documents), items AS (SELECT item_id, {words} AS w FROM benchmark), "
    "item_windows AS (SELECT DISTINCT item_id, least({n}, len(w)) AS n, "
    "array_to_string(list_slice(w, i, i + least({n}, len(w)) - 1), ' ') AS win FROM items, unnest(range(1, len(w) - least({n}, len(w)) + 2)) t(i) WHERE len(w) > 0), "
    "sizes AS (SELECT DISTINCT n FROM item_windows), "
    "doc_windows AS (SELECT doc_id, i AS pos, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM docs, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n), "
    "found AS (SELECT doc_id, pos, n, item_id FROM doc_windows JOIN item_windows USING (n, win)), "
    "hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(pos, pos + n)) t(p) GROUP BY doc_id), "
    "names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names "
    "FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id) "
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, "
    "sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)"
).format(words=_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), n=WINDOW)

NEAR_DUPLICATES = (
    "WITH RECURSIVE docs AS (SELECT doc_id, {words} AS w FROM documents), "
    "shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {k} - 1), ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - {k} + 2, 2))) t(i) WHERE len(w) > 0), "
    "sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id), "
    "common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL), "
    "links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= {percent} * (x.n + y.n - both_)), "
    "reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), "
    "smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) "
    "SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM smallest LEFT JOIN sizes USING (doc_id)"
).format(words=_words("text", r"[^\x20\x09-\x0D]+"), k=SHINGLE, percent=PERCENT)

# The checksum a byte at a time, by the table of what eight shifts make of each byte.
_CRC_TABLE = (
    "(SELECT list(list_reduce(list_prepend(n, range(8)), "
    f"lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, {POLYNOMIAL}) ELSE x >> 1 END) ORDER BY n) AS steps FROM range(256) t(n))"
)
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INT), 2) AS BIGINT))), "
    "lambda x, b: xor(steps[CAST((xor(x, b) & 255) + 1 AS INT)], x >> 8)), 4294967295)"
)
RESAMPLING = (
    "WITH docs AS (SELECT doc_id, {words} AS w FROM documents), items AS (SELECT {words} AS w FROM benchmark), "
    "doc_features AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs), "
    "item_features AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM items), "
    "in_docs AS (SELECT doc_id, f, count(*) AS n FROM doc_features GROUP BY ALL), "
    "names AS (SELECT f, CAST({crc} % {buckets} AS BIGINT) AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM in_docs UNION ALL SELECT f FROM item_features)), {table} AS crc), "
    "source AS (SELECT bucket, sum(n) AS n FROM in_docs JOIN names USING (f) GROUP BY bucket), "
    "target AS (SELECT bucket, count(*) AS n FROM item_features JOIN names USING (f) GROUP BY bucket), "
    "gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM source) + {buckets})::DOUBLE / "
    "((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM target) + {buckets})::DOUBLE))) AS gain "
    "FROM (SELECT DISTINCT bucket FROM names) b LEFT JOIN source s USING (bucket) LEFT JOIN target t USING (bucket)), "
    "sums AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM in_docs JOIN names USING (f) JOIN gains USING (bucket) GROUP BY doc_id), "
    "scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + "
    "CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score "
    "FROM docs LEFT JOIN sums USING (doc_id)), "
    "ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {least}) "
    "SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"
).format(words=_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), crc=_CRC.format("f"), table=_CRC_TABLE, buckets=BUCKETS, least=LEAST_WORDS,
         percent=DRAWN, seed=SEED)

ORACLES = {"op2_warc": WARC, "op4_topk": TOP_K, "op6_near_duplicates": NEAR_DUPLICATES, "op10_decontamination": DECONTAMINATION,
           "op11_resampling": RESAMPLING}
