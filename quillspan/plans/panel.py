"""Queries on panel votes and coverage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import panel as P
from ..sources import fixtures
from . import sql
from .consensus import rounded, scores

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def tables(spark):
    return fixtures.families(spark), fixtures.panel(spark)


EDGES = f"""{sql.PAIRS}, {sql.FAMILIES}, edges AS (
  SELECT * FROM scores WHERE "left" IN (SELECT method FROM panel) OR "right" IN (SELECT method FROM panel)
), by_document AS (SELECT document, "left", "right", avg(similarity) AS s FROM edges GROUP BY ALL
), overall AS (SELECT "left", "right", avg(s) AS s FROM by_document GROUP BY ALL
), sides AS ({sql.ends('overall', '', 's')}
), doc_sides AS ({sql.ends('by_document', 'document', 's')}
), votes AS (
  SELECT s.method, s.peer, p.family AS peer_family, s.s FROM sides s JOIN panel p ON p.method = s.peer
  WHERE NOT EXISTS (SELECT 1 FROM families f WHERE f.method = s.method AND f.family = p.family)
), doc_votes AS (
  SELECT s.document, s.method, s.peer, p.family AS peer_family, s.s FROM doc_sides s JOIN panel p ON p.method = s.peer
  WHERE NOT EXISTS (SELECT 1 FROM families f WHERE f.method = s.method AND f.family = p.family)
)"""


@query("p07_panel_edges", f"""WITH {EDGES} SELECT document, page, "left", "right", round(similarity, 9) AS similarity FROM edges""")
def p07(spark, sf_dir):
    made = P.panel_edges(scores(spark, sf_dir), fixtures.panel(spark))
    return rounded(made.select("document", "page", "left", "right", "similarity"), "similarity")


@query("j04_panel_votes", f"WITH {EDGES} SELECT method, peer, peer_family, round(s, 9) AS s FROM votes")
def j04(spark, sf_dir):
    families, panel = tables(spark)
    pairs = P.corpus_pairs(P.document_pairs(P.panel_edges(scores(spark, sf_dir), panel)))
    return rounded(P.votes(pairs, "s", families, panel, []).select("method", "peer", "peer_family", "s"), "s")


@query(
    "a17_a18_panel_scores",
    f"""WITH {EDGES} SELECT m.method, round(v.score, 7) AS score FROM (SELECT DISTINCT method FROM families) m LEFT JOIN
        (SELECT method, 100 * avg(s) AS score FROM (SELECT method, peer_family, avg(s) AS s FROM votes GROUP BY ALL) GROUP BY method) v USING (method)""",
)
def a17(spark, sf_dir):
    made = P.panel_scores(scores(spark, sf_dir), *tables(spark))
    return made.select("method", F.round("score", 7).alias("score"))


@query(
    "a18_document_panel_scores",
    f"""WITH {EDGES} SELECT document, method, round(100 * avg(s), 7) AS score FROM (SELECT document, method, peer_family, avg(s) AS s FROM doc_votes GROUP BY ALL) GROUP BY ALL""",
)
def a18(spark, sf_dir):
    made = P.document_scores(scores(spark, sf_dir), *tables(spark))
    return made.select("document", "method", F.round("score", 7).alias("score"))


@query(
    "a19_leave_one_family_out",
    f"""WITH {EDGES}, left_out AS (
          SELECT x.family, v.method, v.peer_family, avg(v.s) AS s FROM votes v JOIN (SELECT DISTINCT family FROM panel) x ON x.family <> v.peer_family GROUP BY ALL
        ) SELECT x.family, m.method, round(s.score, 7) AS score FROM (SELECT DISTINCT family FROM panel) x CROSS JOIN (SELECT DISTINCT method FROM families) m
        LEFT JOIN (SELECT family, method, 100 * avg(s) AS score FROM left_out GROUP BY ALL) s ON s.family = x.family AND s.method = m.method""",
)
def a19(spark, sf_dir):
    made = P.leave_one_family_out(scores(spark, sf_dir), *tables(spark))
    return made.select("family", "method", F.round("score", 7).alias("score"))


@query(
    "a20_family_sensitivity",
    f"""WITH {sql.PAIRS}, fam(method, family) AS (VALUES ('alpha', 'A'), ('beta', 'B'), ('gamma', 'C'), ('delta', 'A'), ('epsilon', 'D')),
        d AS (SELECT document, "left", "right", avg(token_overlap) AS s FROM scores GROUP BY ALL), o AS (SELECT "left", "right", avg(s) AS s FROM d GROUP BY ALL),
        sides AS ({sql.ends('o', '', 's')}), cases(excluded) AS (SELECT DISTINCT family FROM fam UNION ALL SELECT NULL),
        v AS (SELECT c.excluded, s.method, p.family AS pf, avg(s.s) AS s FROM sides s JOIN fam f ON f.method = s.method JOIN fam p ON p.method = s.peer AND p.family <> f.family
              JOIN cases c ON c.excluded IS NULL OR (c.excluded <> f.family AND c.excluded <> p.family) GROUP BY ALL)
        SELECT coalesce(excluded, 'none') AS excluded, method, round(100 * avg(s), 7) AS score FROM v GROUP BY ALL""",
)
def a20(spark, sf_dir):
    fam = spark.createDataFrame([("alpha", "A"), ("beta", "B"), ("gamma", "C"), ("delta", "A"), ("epsilon", "D")], "method string, family string")
    made = P.family_sensitivity(scores(spark, sf_dir), fam)
    return made.select(F.coalesce("excluded", F.lit("none")).alias("excluded"), "method", F.round("score", 7).alias("score"))


@query(
    "p17_common_pages",
    f"WITH {sql.CORPUS} SELECT document, page FROM corpus GROUP BY ALL HAVING bool_and(status = 'complete')",
)
def p17(spark, sf_dir):
    return P.common_pages(fixtures.pages(spark, sf_dir))


@query(
    "p06_masked_consensus",
    f"""WITH {sql.PAIRS}, ok AS (SELECT document, page FROM corpus GROUP BY ALL HAVING bool_and(status = 'complete')),
        kept AS (SELECT s.* FROM scores s JOIN ok USING (document, page)), sides AS ({sql.ends('kept', 'document, page', 'similarity')}),
        p AS (SELECT document, page, method, avg(s) AS s FROM sides GROUP BY ALL), d AS (SELECT document, method, avg(s) AS s FROM p GROUP BY ALL)
        SELECT method, round(avg(s), 9) AS score FROM d GROUP BY method""",
)
def p06(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    kept = pages.join(P.common_pages(pages), ["document", "page"], "left_semi")
    return rounded(C.consensus(C.pair_scores(kept), "similarity"), "score")


@query(
    "a34_coverage",
    f"""WITH {sql.CORPUS}, d AS (SELECT method, document, count(*) AS pages, count(*) FILTER (status = 'complete') AS completed, bool_and(status = 'complete') AS whole FROM corpus GROUP BY ALL)
        SELECT method, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(completed) AS BIGINT) AS completed, round(sum(completed)::DOUBLE / sum(pages), 9) AS share, count(*) FILTER (whole) AS complete_documents FROM d GROUP BY method""",
)
def a34(spark, sf_dir):
    return rounded(P.coverage(fixtures.pages(spark, sf_dir)), "share")


@query(
    "s14_exactly_one",
    f"WITH {sql.CORPUS} SELECT document, page, method, count(*) AS rows, count(*) = 1 AS single FROM corpus GROUP BY ALL",
)
def s14(spark, sf_dir):
    made = fixtures.pages(spark, sf_dir).groupBy("document", "page", "method").agg(F.count(F.lit(1)).alias("rows"))
    return made.withColumn("single", F.col("rows") == 1)


@query(
    "s18_hybrid_reconstruction",
    f"""WITH {sql.CORPUS} SELECT g.document, g.page, CASE WHEN g.status = 'failed' THEN 'alpha' ELSE 'gamma' END AS source,
        length(CASE WHEN g.status = 'failed' THEN a.text ELSE g.text END) AS characters
        FROM corpus g JOIN corpus a ON a.document = g.document AND a.page = g.page AND a.method = 'alpha' WHERE g.method = 'gamma'""",
)
def s18(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    main = pages.where("method = 'gamma'").select("document", "page", "status", "text")
    spare = pages.where("method = 'alpha'").select("document", "page", F.col("text").alias("spare"))
    failed = F.col("status") == "failed"
    made = main.join(spare, ["document", "page"], "left")
    return made.select("document", "page", F.when(failed, "alpha").otherwise("gamma").alias("source"), F.length(F.when(failed, F.col("spare")).otherwise(F.col("text"))).alias("characters"))


@query(
    "a33_leave_one_document_out",
    f"""WITH {sql.PAIRS}, sides AS ({sql.ends('scores', 'document, page', 'token_overlap')}), p AS (SELECT document, page, method, avg(s) AS s FROM sides GROUP BY ALL),
        d AS (SELECT document, method, avg(s) AS s FROM p GROUP BY ALL), t AS (SELECT method, sum(s) AS total, count(*) AS n FROM d GROUP BY method)
        SELECT d.document, d.method, round((t.total - d.s) / nullif(t.n - 1, 0), 9) AS score FROM d JOIN t USING (method)""",
)
def a33(spark, sf_dir):
    """The mean without a document is the total less its share: one pass, where a self join would pair all documents."""
    by_document = C.page_scores(scores(spark, sf_dir)).groupBy("document", "method").agg(F.avg("score").alias("s"))
    total = by_document.groupBy("method").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("n"))
    made = by_document.join(total, "method")
    return rounded(made.select("document", "method", F.try_divide(F.col("total") - F.col("s"), (F.col("n") - 1).cast("double")).alias("score")), "score")


@query(
    "a32_sensitivity_variants",
    f"""WITH {sql.PAIRS}, v AS (SELECT document, page, "left", "right", unnest(['tokens', 'bigrams', 'half']) AS variant, unnest([token_overlap, bigram_overlap, similarity]) AS s FROM scores),
        sides AS ({sql.ends('v', 'variant, document, page', 's')}), p AS (SELECT variant, document, page, method, avg(s) AS s FROM sides GROUP BY ALL)
        SELECT variant, weighting, method, round(score, 9) AS score FROM (
          SELECT variant, 'page' AS weighting, method, avg(s) AS score FROM p GROUP BY ALL UNION ALL
          SELECT variant, 'document', method, avg(s) FROM (SELECT variant, document, method, avg(s) AS s FROM p GROUP BY ALL) GROUP BY ALL)""",
)
def a32(spark, sf_dir):
    """All variants from one scan of the pair scores."""
    measures = {"tokens": "token_overlap", "bigrams": "bigram_overlap", "half": "similarity"}
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), F.col(v).alias("s")) for k, v in measures.items()])
    long = scores(spark, sf_dir).select("document", "page", F.explode(F.array("left", "right")).alias("method"), rows.alias("rows")).select("document", "page", "method", F.inline("rows"))
    by_page = long.groupBy("variant", "document", "page", "method").agg(F.avg("s").alias("s"))
    # Sums and counts of the pages make both weightings from one aggregation.
    by_document = by_page.groupBy("variant", "document", "method").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("n"))
    both = by_document.groupBy("variant", "method").agg((F.sum("total") / F.sum("n")).alias("page"), F.avg(F.col("total") / F.col("n")).alias("document"))
    long = both.select("variant", "method", F.inline(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("score")) for w in ("page", "document")])))
    return rounded(long.select("variant", "weighting", "method", "score"), "score")
