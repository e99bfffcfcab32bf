"""Alignment and corroboration on pages whose alignment is known beforehand, so that SQL can say what must come out.

Every benchmark item is a document of three pages. On page 1 the methods agree,
but for one thing in turn; page 2 repeats one word, so no surroundings are
unique; on page 3 one method has nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions import text as T
from ..operators import alignment as A
from ..operators import corroboration as K
from ..operators import regions
from ..operators.vocabulary import compiled
from ..sources import fixtures
from . import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str):
    def put(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return put


#: Words that no item has.
OTHER, SECOND = "qqxa qqxb qqxc", "qqya qqyb"


def pages(spark, sf_dir) -> DataFrame:
    """(document, page, method, text, status)."""
    words, turn = F.array_join(T.tokens(F.col("text")), " "), F.col("item_id") % 5
    rows = []
    for m in fixtures.METHODS:
        first = {
            "gamma": F.when(turn.isin(0, 3), OTHER).otherwise(words), "beta": F.when(turn == 3, SECOND).otherwise(words), "delta": F.when(turn == 4, F.concat(words, F.lit("\n" + OTHER))).otherwise(words),
        }.get(m, words)
        status = F.when(turn == 2, "failed").otherwise("complete") if m == "beta" else F.lit("complete")
        texts = (first, F.lit(" ".join(["ha"] * 300)), F.lit("") if m == "gamma" else words)
        rows += [F.struct(F.lit(i).cast("long").alias("page"), F.lit(m).alias("method"), t.alias("text"), (status if i == 1 else F.lit("complete")).alias("status")) for i, t in enumerate(texts, 1)]
    return fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document"), F.inline(F.array(*rows)))


BUILT = f"""{sql.FAMILIES.strip()}, methods AS (SELECT DISTINCT method FROM families
), made AS (
  SELECT item_id AS document, page, method, CASE
      WHEN page = 2 THEN 'same' WHEN page = 3 THEN CASE method WHEN 'gamma' THEN 'none' ELSE 'words' END
      WHEN method = 'gamma' AND item_id % 5 IN (0, 3) THEN 'other' WHEN method = 'beta' AND item_id % 5 = 3 THEN 'second' WHEN method = 'delta' AND item_id % 5 = 4 THEN 'more' ELSE 'words' END AS kind,
    CASE WHEN page = 1 AND method = 'beta' AND item_id % 5 = 2 THEN 'failed' ELSE 'complete' END AS status
  FROM benchmark, methods, (VALUES (1), (2), (3)) p(page)
), parts AS (SELECT *, unnest(range(1, CASE kind WHEN 'same' THEN 4 WHEN 'more' THEN 3 WHEN 'none' THEN 1 ELSE 2 END)) AS passage FROM made
), told AS (
  SELECT a.document, a.page, a.method, a.passage, a.status AS source_status, p.method AS peer, p.family, CASE
      WHEN b.status <> 'complete' THEN 'unavailable' WHEN b.method = a.method THEN 'support' WHEN a.page = 2 THEN 'ambiguous' WHEN a.passage = 2 OR b.kind = 'none' THEN 'missing'
      WHEN a.kind IN ('words', 'more') AND b.kind IN ('words', 'more') THEN 'support' ELSE 'conflict' END AS state
  FROM parts a JOIN made b ON a.document = b.document AND a.page = b.page JOIN panel p ON p.method = b.method
), folded AS (
  SELECT document, page, method, passage, source_status, family, CASE WHEN bool_and(state = 'support') THEN 'support'
      WHEN bool_or(state = 'conflict') OR (bool_or(state = 'support') AND bool_or(state = 'missing')) THEN 'conflict'
      WHEN bool_or(state = 'ambiguous') THEN 'ambiguous' WHEN bool_or(state = 'unavailable') THEN 'unavailable' ELSE 'missing' END AS state
  FROM told GROUP BY document, page, method, passage, source_status, family
), listed AS (
  SELECT document, page, method, passage, source_status, {", ".join(f"coalesce(string_agg(family, '; ' ORDER BY family) FILTER (state = '{s}'), '') AS {n}_families" for s, n in (("support", "supporting"), ("conflict", "conflicting"), ("ambiguous", "ambiguous"), ("missing", "missing"), ("unavailable", "unavailable")))},
    count(*) FILTER (state = 'support') AS n FROM folded GROUP BY document, page, method, passage, source_status
), passages AS (
  SELECT *, CASE WHEN n < 2 THEN 'uncertain' ELSE 'corroborated' END AS status, CASE WHEN n < 2 THEN 'insufficient_family_support' ELSE '' END AS uncertainty_reasons,
    array_to_string(list_filter([CASE WHEN conflicting_families <> '' THEN 'conflicting_readings' END, CASE WHEN ambiguous_families <> '' THEN 'ambiguous_alignment' END, CASE WHEN source_status <> 'complete' THEN 'incomplete_source' END], lambda x: x IS NOT NULL), '; ') AS flags
  FROM listed
), rolled AS (
  SELECT m.document, m.page, m.method, m.status AS source_status, count(p.passage) AS passages, count(*) FILTER (p.status = 'uncertain') AS uncertain_passages, count(*) FILTER (p.flags <> '') AS flagged_passages,
    CASE WHEN count(p.passage) = 0 OR count(*) FILTER (p.status = 'uncertain') > 0 THEN 'uncertain' ELSE 'corroborated' END AS status, count(p.passage) = 0 AS empty_output,
    CASE WHEN count(p.passage) = 0 THEN 'no_text_returned' ELSE coalesce(max(nullif(p.uncertainty_reasons, '')), '') END AS uncertainty_reasons
  FROM made m LEFT JOIN passages p ON m.document = p.document AND m.page = p.page AND m.method = p.method GROUP BY m.document, m.page, m.method, m.status
)"""


def corroborated(spark, sf_dir):
    return K.corroborate(pages(spark, sf_dir), fixtures.families(spark), fixtures.panel(spark), passage_tokens=128)


@query("j13_j14_built_evidence", f"WITH {BUILT} SELECT document, CAST(page AS BIGINT) AS page, method, CAST(passage AS INTEGER) AS passage, peer, state FROM told")
def j13(spark, sf_dir):
    return K.passage_evidence(pages(spark, sf_dir), list(fixtures.PANEL), 128).select("document", "page", "method", "passage", "peer", "state")


@query("a21_built_family_states", f"WITH {BUILT} SELECT document, CAST(page AS BIGINT) AS page, method, CAST(passage AS INTEGER) AS passage, family, state FROM folded")
def a21(spark, sf_dir):
    found = K.passage_evidence(pages(spark, sf_dir), list(fixtures.PANEL), 128)
    return K.family_states(found, fixtures.panel(spark)).select("document", "page", "method", "passage", "family", "state")


LISTS = [f"{n}_families" for n in ("supporting", "conflicting", "ambiguous", "missing", "unavailable")]


@query("a22_k05_built_passages", f"WITH {BUILT} SELECT document, CAST(page AS BIGINT) AS page, method, CAST(passage AS INTEGER) AS passage, source_status, {', '.join(LISTS)}, CAST(n AS INTEGER) AS supporting_family_count, status, uncertainty_reasons, flags FROM passages")
def a22(spark, sf_dir):
    return K.flat(corroborated(spark, sf_dir)[0]).select("document", "page", "method", "passage", "source_status", *LISTS, "supporting_family_count", "status", "uncertainty_reasons", "flags")


@query("a23_built_page_rollup", f"WITH {BUILT} SELECT document, CAST(page AS BIGINT) AS page, method, source_status, passages, uncertain_passages, flagged_passages, status, empty_output, uncertainty_reasons FROM rolled")
def a23(spark, sf_dir):
    made = corroborated(spark, sf_dir)[1].withColumn("uncertainty_reasons", F.array_join("uncertainty_reasons", "; "))
    return made.select("document", "page", "method", "source_status", "passages", "uncertain_passages", "flagged_passages", "status", "empty_output", "uncertainty_reasons")


@query(
    "a24_built_summary",
    f"""WITH {BUILT} SELECT count(*) FILTER (status = 'corroborated') AS corroborated, count(*) FILTER (status = 'uncertain') AS uncertain, count(*) FILTER (flags <> '') AS flagged_passages,
        count(*) FILTER (status = 'corroborated' AND flags <> '') AS corroborated_with_flags, (SELECT count(*) FROM rolled WHERE empty_output) AS empty_page_outputs FROM passages""",
)
def a24(spark, sf_dir):
    return corroborated(spark, sf_dir)[2]


@query(
    "a25_o02_built_ranking",
    f"""WITH {BUILT}, c AS (SELECT method, count(*) AS passages, count(*) FILTER (status = 'corroborated') AS corroborated, count(*) FILTER (flags <> '') AS flagged FROM passages GROUP BY method),
        s(method, score, document_score) AS (VALUES ('alpha', 0.5::DOUBLE, 1.0::DOUBLE), ('beta', NULL, 2.0), ('delta', 0.75, 3.0), ('whole', NULL, 4.0))
        SELECT method, score, document_score, passages, corroborated, flagged, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, method) - 1 AS BIGINT) AS place FROM s LEFT JOIN c USING (method)""",
)
def a25(spark, sf_dir):
    by_page = spark.createDataFrame([("alpha", 0.5), ("beta", None), ("delta", 0.75)], "method string, score double")
    by_document = spark.createDataFrame([("alpha", 1.0), ("beta", 2.0), ("delta", 3.0), ("whole", 4.0)], "method string, score double")
    ranked = K.ranking(corroborated(spark, sf_dir)[0], by_page, by_document)
    # The order is part of the result; there are four rows.
    return ranked.coalesce(1).withColumn("place", F.monotonically_increasing_id())


def two(spark, sf_dir) -> DataFrame:
    """(document, page, method, text): each item, and with three more words at its end."""
    words = F.array_join(T.tokens(F.col("text")), " ")
    sides = F.array(*[F.struct(F.lit(m).alias("method"), t.alias("text")) for m, t in (("a", words), ("b", F.concat(words, F.lit(f" {OTHER}"))))])
    return fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document"), F.lit(1).cast("long").alias("page"), F.inline(sides))


@query("a04_j12_built_similarity", f"SELECT item_id AS document, round(2.0::DOUBLE * n / (2 * n + 3), 9) AS sequence_similarity FROM (SELECT item_id, len({sql.tokens('text')}) AS n FROM benchmark)")
def a04(spark, sf_dir):
    return A.sequence_similarity(two(spark, sf_dir)).select("document", F.round("sequence_similarity", 9).alias("sequence_similarity"))


@query(
    "j12_built_changes",
    f"""SELECT item_id AS document, 'insert' AS kind, CAST(len(w) AS INTEGER) AS left_offset, CAST(len(w) AS INTEGER) AS right_offset, '' AS left_tokens, '{OTHER}' AS right_tokens,
        array_to_string(w[greatest(1, len(w) - 4):], ' ') AS left_context, array_to_string(w[greatest(1, len(w) - 4):], ' ') || ' {OTHER}' AS right_context FROM (SELECT item_id, {sql.tokens('text')} AS w FROM benchmark)""",
)
def j12(spark, sf_dir):
    return A.changes(two(spark, sf_dir)).select("document", "kind", "left_offset", "right_offset", "left_tokens", "right_tokens", "left_context", "right_context")


ONE_LINE = r"trim(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '\s+', ' ', 'g'))"


def marked(spark, sf_dir, read) -> DataFrame:
    """(doc_id, made): a page of HTML around each document's text, read by ``read``. A tag that no table lists stays as text."""
    one = F.trim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("­"), F.lit("")), r"\s+", " "))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        one = F.replace(one, F.lit(sign), F.lit(name))
    html = F.concat(F.lit("<!-- no --><script>no</script>x<b>y</b>z<p>"), one, F.lit("</p>tail<table><tr><td>a</td><td>b</td></tr></table>"))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", read(html, F.lit("html")).alias("made"))


@query("f01_f03_built_flow", f"SELECT doc_id, md5('<script>no</script>xyz ' || {ONE_LINE} || CASE WHEN {ONE_LINE} = '' THEN '' ELSE ' ' END || 'tail a b') AS text_md5 FROM documents")
def f01(spark, sf_dir):
    made = marked(spark, sf_dir, D.extract_text)
    return made.select("doc_id", F.md5(F.encode(F.trim(F.regexp_replace("made", r"\s+", " ")), "utf-8")).alias("text_md5"))


@query(
    "f02_f03_built_lines",
    f"SELECT doc_id, md5('<script>no</script>xyz' || chr(10) || {ONE_LINE} || CASE WHEN {ONE_LINE} = '' THEN '' ELSE chr(10) END || 'tail' || chr(10) || 'a' || chr(9) || 'b') AS text_md5 FROM documents",
)
def f02(spark, sf_dir):
    made = marked(spark, sf_dir, D.field_text)
    # Blank lines between blocks don't count.
    return made.select("doc_id", F.md5(F.encode(F.trim(F.regexp_replace("made", r"\s*\n\s*", "\n")), "utf-8")).alias("text_md5"))


#: A label that two concepts have, so that its owner is unclear.
UNCLEAR = {"concepts": {"Thing": {"fields": ["est"]}, "Other": {"fields": ["est"]}}}


@query(
    "j11_o04_built_rejections",
    """WITH k AS (SELECT item_id, 1 + item_id % 6 AS n FROM benchmark), spots AS (SELECT item_id, n, unnest(range(0, n)) AS i FROM k), pairs AS (SELECT a.item_id, a.n, a.i * 41 AS x, b.i * 41 AS y FROM spots a JOIN spots b USING (item_id)),
       shown AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY x, y) AS at_most FROM pairs)
       SELECT item_id AS document, CAST(n * n AS INTEGER) AS rejected, 0 AS matched, string_agg('label:est ' || x || ' ' || y, '; ' ORDER BY x, y) FILTER (at_most <= 20) AS examples FROM shown GROUP BY item_id, n""",
)
def o04(spark, sf_dir):
    # An unclear label among words that the other side doesn't have: no two regions may match.
    times = (1 + F.col("item_id") % 6).cast("int")
    sides = F.array(*[F.struct(F.lit(m).alias("method"), F.repeat(F.lit("est " + f"{w} " * 40), times).alias("text")) for m, w in (("a", "qqx"), ("b", "qqy"))])
    rows = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document"), F.lit(1).cast("long").alias("page"), F.inline(sides))
    made = regions.region_agreement(rows, compiled(UNCLEAR))
    shown = F.array_join(F.transform("examples", lambda e: F.concat_ws(" ", e["tag"], e["left_at"].cast("string"), e["right_at"].cast("string"))), "; ")
    return made.select("document", "rejected", "matched", shown.alias("examples"))
