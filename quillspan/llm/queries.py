"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dart_minhash, decontaminate, imatch, language_id, packing, repeats, secrets, token_counts, url_filter, warc
from .common import table

#: The folder of the public tokenizers' files; the vocabulary is a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": over("documents", packing.best_fit_pack),
        "op2_imatch_fingerprints": over("documents", imatch.compare_edited),
        "op3_token_counts": over("documents", lambda docs: token_counts.count_tokens(docs, PIECES)),
        "op4_secret_scan": over("documents", secrets.digest),
        "op5_warc_zstd": over("pages", warc.round_trip),
        "op6_repeat_removal": over("documents", repeats.remove_repeats),
        "op7_language_id": over("documents", language_id.language_id),
        "op8_near_duplicates": over("documents", dart_minhash.near_classes),
        "op9_url_filter": over("pages", url_filter.filter_urls),
        "op10_decontaminate": lambda spark, sf_dir: decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": OP4, "op5_warc_zstd": OP5, "op6_repeat_removal": OP6}


def found(kind: str, rank: int, pattern: str, least: int, group: int = 0) -> str:
    """Matches of one kind: the text before a match is what the split leaves before it and the matches there. Shorter groups are dropped."""
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, "start", "start" + length(m) AS "end" FROM (
      SELECT r, m, g, sum(length(piece) + length(before)) OVER (PARTITION BY r ORDER BY i) AS "start" FROM (
        SELECT r, i, ms[i] AS m, gs[i] AS g, pieces[i] AS piece, CASE WHEN i > 1 THEN ms[i - 1] ELSE '' END AS before FROM (
          SELECT r, ms, gs, pieces, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(text, {pattern}) AS ms, regexp_extract_all(text, {pattern}, {group}) AS gs, string_split_regex(text, {pattern}) AS pieces FROM d)))) WHERE length(g) >= {least}"""


#: RE2 folds more than ASCII, so both cases are spelt out. A private key is one with its END line.
ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""'({ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
LINE = "kind || ':' || \"start\" || ':' || \"end\""

OP4 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS MATERIALIZED (
  {found('assign', 0, ASSIGN, 12, 2)}
  UNION ALL {found('access', 1, "'AKIA[A-Z0-9]+'", 18)}
  UNION ALL {found('hex', 2, "'[0-9a-f]{16,}'", 16)}
  UNION ALL {found('private_key', 3, "'-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----'", 0)}
  UNION ALL {found('jwt', 4, "'eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+'", 40)}
), g AS (
  SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
         string_agg({LINE}, ',' ORDER BY "start", rank) FILTER (rank < 3) AS base, string_agg({LINE}, ',' ORDER BY "start", rank) AS every
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

#: Bytes as pairs of hex digits. Starts of strings that occur twice make runs, which end 200 bytes after their last start.
OP6 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS p FROM d)
), twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1
), marked AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200, true) AS opens FROM twice
), runs AS (SELECT r, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY p) AS run FROM marked) GROUP BY r, run
), cuts AS MATERIALIZED (SELECT r, lo, hi FROM runs UNION ALL SELECT r, length(h) // 2, NULL FROM d
), kept AS (
  SELECT r, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (lo - a) AS BIGINT)), '' ORDER BY lo) AS left_over, coalesce(sum(hi - lo), 0) AS removed, count(hi) AS spans
  FROM (SELECT r, lo, hi, coalesce(max(hi) OVER (PARTITION BY r ORDER BY lo, hi NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM cuts) JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM d JOIN kept USING (r)
"""


OP5 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.last_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last_id <> p.page_id THEN m.last_id END AS refers_to
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest
"""
