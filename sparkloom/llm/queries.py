"""The corpus queries of this subpackage and their DuckDB SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .decontamination import op2_decontamination
from .media import op6_chroma
from .minhash import op8_minhash
from .pii import op5_pii
from .quality import op4_quality
from .repeats import op1_suffix_dedup
from .sharding import op9_external_shuffle
from .toxicity import op3_toxicity
from .warc import op10_warc


#: Base32 of a SHA-1: each five hex digits of it are four of base32.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hex FROM p),
    b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM d),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM b)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last_id THEN last_id END AS refers_to FROM m"""


#: All windows of 400 bytes, by hash; runs of those that occur twice; the bytes between runs.  Words likewise, in windows of 50.
REPEATS = """WITH d AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    win AS (SELECT n, i, md5(array_slice(b, i, i + 399)) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS x(i)),
    hit AS (SELECT n, i FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
    run AS (SELECT n, i, sum(fresh) OVER (PARTITION BY n ORDER BY i) AS k FROM (SELECT n, i, CASE WHEN i - lag(i) OVER (PARTITION BY n ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hit)),
    span AS (SELECT n, min(i) AS a, max(i) + 399 AS e FROM run GROUP BY n, k),
    total AS (SELECT n, sum(e - a + 1) AS removed, count(*) AS spans, max(e) AS e FROM span GROUP BY n),
    gap AS (SELECT n, coalesce(lag(e) OVER (PARTITION BY n ORDER BY a), 0) + 1 AS start, a - 1 AS stop FROM span UNION ALL SELECT n, coalesce(e, 0) + 1, octet_length(b) FROM d LEFT JOIN total USING (n)),
    kept AS (SELECT n, sha256(unhex(string_agg(CASE WHEN stop >= start THEN hex(array_slice(b, start, stop)) ELSE '' END, '' ORDER BY start))) AS sha FROM gap JOIN d USING (n) GROUP BY n),
    w AS (SELECT n, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
    wwin AS (SELECT n, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) AS x(i)),
    whit AS (SELECT n, i FROM wwin SEMI JOIN (SELECT h FROM wwin GROUP BY h HAVING min(n) <> max(n)) USING (h)),
    words AS (SELECT n, sum(least(50, coalesce(i - before, 50))) AS shared FROM (SELECT n, i, lag(i) OVER (PARTITION BY n ORDER BY i) AS before FROM whit) GROUP BY n)
    SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha AS kept_sha256, coalesce(shared, 0)::BIGINT AS n_shared_words
    FROM d JOIN kept USING (n) LEFT JOIN total USING (n) LEFT JOIN words USING (n)"""

#: All pairs with a shingle in common, and the components of those that are linked.
NEAR = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT n, doc_id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
    s AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    e AS (SELECT n, unnest(s) AS x FROM s),
    p AS (SELECT a.n AS a, b.n AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.n < b.n GROUP BY ALL),
    l AS (SELECT p.a, p.b FROM p JOIN s x ON p.a = x.n JOIN s y ON p.b = y.n WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)),
    u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT n AS a, n AS b FROM s UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
    c AS (SELECT r.a, min(s.doc_id) AS component_id FROM r JOIN s ON r.b = s.n GROUP BY r.a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON s.n = c.a"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> query over (spark, sf_dir)."""
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_pii": op5_pii,
        "op6_chroma": op6_chroma,
        "op7_bpe": op7_bpe,
        "op8_minhash": op8_minhash,
        "op9_external_shuffle": op9_external_shuffle,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL with the same rows, for the queries that SQL can express."""
    return {"op1_suffix_dedup": REPEATS, "op8_minhash": NEAR, "op10_warc": WARC}
