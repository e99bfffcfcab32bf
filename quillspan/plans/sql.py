"""Pieces of DuckDB SQL that several queries' oracles share. They mirror sources/fixtures.py and functions/text.py."""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"
S = r"[+\-]?\p{Nd}+(?:[.,:/\-]\p{Nd}+)*[%‰]?"
RE = rf"\(\s*{S}\s*\)|[+\-]?\p{{Nd}}+[\p{{L}}_]{W}*[+\-]?|{S}|{W}+[+\-(]?"


def fold(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


def raw_tokens(text: str) -> str:
    """Tokens of a text that is folded already, or isn't to be. RE2 has no look-around, so what a match took too much is dropped again."""
    return rf"""list_transform(regexp_extract_all(replace({text}, '−', '-'), '{RE}'), lambda t:
      CASE WHEN starts_with(t, '(') THEN regexp_replace(t, '\s', '', 'g')
           WHEN regexp_matches(t, '^[+-]\p{{Nd}}+[\p{{L}}_]') THEN regexp_replace(substr(t, 2), '[+(-]$', '')
           WHEN regexp_matches(t, '[\p{{L}}_]') THEN regexp_replace(t, '[+(-]$', '') ELSE t END)"""


def tokens(text: str) -> str:
    return raw_tokens(fold(text))


def numbers(text: str) -> str:
    return rf"list_filter({raw_tokens(text)}, lambda t: regexp_matches(t, '^\(?[+-]?\p{{Nd}}+([.,:/-]\p{{Nd}}+)*[%‰]?\)?$'))"


CORPUS = """
talk AS (
  SELECT conv_id AS document, turn + 1 AS page, text, string_split(text, ' ') AS w,
         array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 7 <> 0), ' ') AS beta,
         conv_id % 10 = 0 AND turn = 0 AS failed, conv_id % 15 = 0 AND turn = 1 AS cut
  FROM conversations
), corpus AS (
  SELECT document, page, 'alpha' AS method, text, 'complete' AS status FROM talk
  UNION ALL SELECT document, page, 'beta', beta, CASE WHEN cut THEN 'truncated' ELSE 'complete' END FROM talk
  UNION ALL SELECT document, page, 'delta', upper(replace(array_to_string(
      CASE WHEN len(w) >= 4 THEN w[1:2] || w[4:4] || w[3:3] || w[5:] ELSE w END, ' '), 'ß', 'ss')), 'complete' FROM talk
  UNION ALL SELECT document, page, 'epsilon', CASE WHEN page % 2 = 1 THEN text ELSE beta END, 'complete' FROM talk
  UNION ALL SELECT document, page, 'gamma', CASE WHEN failed THEN '' ELSE replace(text, 'en', 'em') END,
      CASE WHEN failed THEN 'failed' ELSE 'complete' END FROM talk
)"""

TOKENS = f"""{CORPUS}, tok AS MATERIALIZED (
  SELECT document, page, method, text, status, {tokens('text')} AS words, {numbers('text')} AS numbers FROM corpus
), uni AS MATERIALIZED (
  SELECT document, page, method, t, count(*) AS n FROM (SELECT document, page, method, unnest(words) AS t FROM tok) GROUP BY ALL
), bi AS MATERIALIZED (
  SELECT document, page, method, t, count(*) AS n FROM (
    SELECT document, page, method, unnest(list_transform(range(1, len(words)), lambda i: words[i] || chr(31) || words[i + 1])) AS t FROM tok
  ) GROUP BY ALL
), num AS MATERIALIZED (
  SELECT document, page, method, t, count(*) AS n FROM (SELECT document, page, method, unnest(numbers) AS t FROM tok) GROUP BY ALL
)"""


def meet(of: str) -> str:
    return f"""SELECT a.document, a.page, a.method AS "left", b.method AS "right", sum(least(a.n, b.n)) AS s
      FROM {of} a JOIN {of} b ON a.document = b.document AND a.page = b.page AND a.t = b.t AND a.method < b.method GROUP BY ALL"""


PAIRS = f"""{TOKENS}, pairs AS (
  SELECT a.document, a.page, a.method AS "left", b.method AS "right", len(a.words) AS left_tokens, len(b.words) AS right_tokens,
         greatest(len(a.words) - 1, 0) + greatest(len(b.words) - 1, 0) AS total_bigrams, len(a.numbers) + len(b.numbers) AS total_numbers
  FROM tok a JOIN tok b ON a.document = b.document AND a.page = b.page AND a.method < b.method
), counted AS (
  SELECT p.*, coalesce(u.s, 0) AS shared_tokens, coalesce(b.s, 0) AS shared_bigrams, coalesce(n.s, 0) AS shared_numbers
  FROM pairs p
  LEFT JOIN ({meet('uni')}) u USING (document, page, "left", "right")
  LEFT JOIN ({meet('bi')}) b USING (document, page, "left", "right")
  LEFT JOIN ({meet('num')}) n USING (document, page, "left", "right")
), overlapped AS (
  SELECT *, CASE WHEN left_tokens + right_tokens > 0 THEN 2.0::DOUBLE * shared_tokens / (left_tokens + right_tokens) ELSE 0.0 END AS token_overlap FROM counted
), scores AS MATERIALIZED (
  SELECT *, CASE WHEN total_bigrams > 0 THEN 2.0::DOUBLE * shared_bigrams / total_bigrams ELSE token_overlap END AS bigram_overlap,
         (token_overlap + CASE WHEN total_bigrams > 0 THEN 2.0::DOUBLE * shared_bigrams / total_bigrams ELSE token_overlap END) / 2 AS similarity,
         CASE WHEN total_numbers > 0 THEN 2.0::DOUBLE * shared_numbers / total_numbers END AS numeric_agreement
  FROM overlapped
)"""

FAMILIES = """
families(method, family) AS (VALUES ('alpha', 'A'), ('beta', 'B'), ('gamma', 'C'), ('delta', 'A'), ('epsilon', 'A'), ('epsilon', 'B')),
panel(method, family) AS (VALUES ('alpha', 'A'), ('beta', 'B'), ('delta', 'A'), ('gamma', 'C'))"""


def ends(source: str, keys: str, measure: str) -> str:
    """Both ends of every pair as (keys, method, peer, s)."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}"left" AS method, "right" AS peer, {measure} AS s FROM {source} UNION ALL SELECT {k}"right", "left", {measure} FROM {source}"""


def tolerant(source: str, score: str, name: str, tolerance: str) -> str:
    """A table with the column rank: competition ranks of near-equal scores."""
    order = f"ORDER BY {score} DESC NULLS LAST, {name}"
    return f"""SELECT * EXCLUDE (starts_at, rn), max(starts_at) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS rank FROM (
      SELECT *, CASE WHEN rn = 1 OR before IS NULL OR {score} IS NULL OR abs({score} - before) > {tolerance} THEN rn END AS starts_at FROM (
        SELECT *, row_number() OVER ({order}) AS rn, lag({score}) OVER ({order}) AS before FROM {source})) """
