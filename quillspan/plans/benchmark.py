"""Queries on the field benchmark, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import benchmark as B
from ..operators import consensus as C
from ..sources import fixtures
from . import sql
from .consensus import rounded

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def inputs(spark, sf_dir):
    return fixtures.references(spark, sf_dir), fixtures.predictions(spark, sf_dir), fixtures.profile(spark)


def canon(value: str) -> str:
    """The typed value of the fixtures' fields: prices have two decimals, dates are ISO, statuses verbatim, priorities folded."""
    return f"""CASE WHEN lower(trim({value})) IN ('', '-', '—', 'n/a', 'na', 'null', 'none', '<redacted>', '[redacted]') THEN NULL
      WHEN field = 'Amount' THEN CASE WHEN regexp_full_match({value}, '[0-9]+([.][0-9]+)?') THEN '["' || CASE WHEN {value} LIKE '%.%' THEN regexp_replace(regexp_replace({value}, '0+$', ''), '[.]$', '') ELSE {value} END || '", "", null]' END
      WHEN field = 'Date' THEN CASE WHEN regexp_full_match({value}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {value} END
      WHEN field = 'Status' THEN trim({value}) ELSE lower(trim({value})) END"""


FIX = f"""
profile(field, ord, weight, critical, target) AS (VALUES ('Amount', 0, 5.0, true, 'Status'), ('Date', 1, 2.0, true, NULL), ('Priority', 2, 1.0, false, NULL), ('Status', 3, 1.0, true, NULL)),
o AS (
  SELECT o_custkey % 50 AS document, o_orderkey AS record, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders
), refs0 AS (
  SELECT document, record, field, ord,
    CASE field WHEN 'Amount' THEN CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') WHEN 'Date' THEN d WHEN 'Priority' THEN p ELSE s END AS v,
    CASE WHEN field <> 'Priority' THEN 'present' WHEN record % 23 = 0 THEN 'unreadable' WHEN record % 29 = 0 THEN 'absent' ELSE 'present' END AS status,
    record % 3 + 1 AS page, [(record % 5) / 10.0::DOUBLE, ord / 10.0::DOUBLE, (record % 5) / 10.0::DOUBLE + 0.3, ord / 10.0::DOUBLE + 0.1] AS bbox,
    document % 10 AS template_id, CASE WHEN document % 10 < 6 THEN 'test' WHEN document % 10 < 8 THEN 'train' ELSE 'validation' END AS split
  FROM o CROSS JOIN profile
), refs AS (SELECT *, CASE WHEN status = 'present' THEN v END AS value FROM refs0
), base AS (
  SELECT document, record * 100 + ord * 10 AS idx, record, field, coalesce(value, '?') AS value, page, bbox FROM refs WHERE status <> 'absent'
), preds AS (
  SELECT 'plain' AS method, * FROM base
  UNION ALL
  SELECT 'noisy', document, idx, CASE WHEN field = 'Amount' AND record % 17 = 0 THEN record + 1 ELSE record END, field,
    CASE WHEN field = 'Amount' AND record % 7 = 0 THEN '9' || value WHEN field = 'Date' AND record % 19 = 0 THEN '  ' ELSE value END,
    CASE WHEN record % 13 = 5 THEN page + 1 ELSE page END, CASE WHEN record % 5 = 1 THEN list_transform(bbox, lambda x: x * 0.5) ELSE bbox END
  FROM base WHERE NOT (field = 'Status' AND record % 11 = 0)
  UNION ALL
  SELECT 'noisy', document, idx + 1, record, field, '1' || value, page, bbox FROM base WHERE field = 'Amount' AND record % 13 = 0
), methods(method) AS (VALUES ('plain'), ('noisy')),
marked AS MATERIALIZED (SELECT p.*, r.status AS ref_status, {canon('p.value').replace('field', 'p.field')} AS pv FROM preds p LEFT JOIN refs r USING (document, record, field)
), firsts AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY method, document, record, field) AS candidates FROM marked
    WHERE coalesce(ref_status, '') <> 'unreadable' WINDOW w AS (PARTITION BY method, document, record, field ORDER BY idx)) WHERE rn = 1
), m0 AS MATERIALIZED (
  SELECT m.method, r.document, r.record, r.field, r.value, pr.weight, pr.critical, pr.target, r.page, r.bbox, f.value AS guess, f.pv, f.idx, f.page AS gpage, f.bbox AS gbox, f.candidates,
    {canon('r.value').replace('field', 'r.field')} AS rv, coalesce(trim(f.value) <> '', false) AS detected
  FROM refs r CROSS JOIN methods m JOIN profile pr USING (field)
  LEFT JOIN firsts f ON f.method = m.method AND f.document = r.document AND f.record = r.record AND f.field = r.field WHERE r.status = 'present'
), m1 AS MATERIALIZED (
  SELECT *, coalesce(detected AND candidates = 1 AND pv = rv, false) AS correct, coalesce(detected AND candidates = 1 AND guess = value, false) AS literal_correct,
    coalesce(detected AND candidates = 1 AND gpage = page AND
      greatest(0, least(bbox[3], gbox[3]) - greatest(bbox[1], gbox[1])) * greatest(0, least(bbox[4], gbox[4]) - greatest(bbox[2], gbox[2])) * 3 >=
      (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) + (gbox[3] - gbox[1]) * (gbox[4] - gbox[2]), false) AS localized,
    levenshtein(value, CASE WHEN detected THEN guess ELSE '' END) AS edits, CASE WHEN detected THEN idx END AS used_idx,
    CASE WHEN candidates > 1 THEN 'duplicate_predictions' WHEN coalesce(detected AND candidates = 1 AND pv = rv, false) THEN 'correct' WHEN detected THEN 'wrong_value' ELSE 'missing' END AS reason
  FROM m0
), matched AS MATERIALIZED (
  SELECT a.*, a.correct AND (a.target IS NULL OR b.record IS NULL OR b.correct) AS complete, b.correct AS target_correct
  FROM m1 a LEFT JOIN m1 b ON a.target = b.field AND a.method = b.method AND a.document = b.document AND a.record = b.record
), extra AS MATERIALIZED (
  SELECT x.method, x.document, x.idx, x.record, x.field, x.value,
    CASE WHEN x.pv IS NOT NULL AND EXISTS (SELECT 1 FROM m1 k WHERE k.method = 'plain' AND k.document = x.document AND k.field = x.field AND k.rv = x.pv AND k.record <> x.record) THEN 'wrong_record'
         WHEN x.ref_status = 'present' THEN 'duplicate' ELSE 'extra' END AS reason
  FROM marked x WHERE coalesce(x.ref_status, '') <> 'unreadable'
  AND NOT EXISTS (SELECT 1 FROM m1 u WHERE u.method = x.method AND u.document = x.document AND u.used_idx = x.idx)
), crit_extra AS (SELECT DISTINCT method, document, record FROM extra WHERE field <> 'Priority'
), recs AS (
  SELECT method, document, record, count(*) AS n, count(*) FILTER (complete) AS ok FROM matched WHERE critical GROUP BY ALL
), counts AS (
  SELECT a.method, a.document, a.field, a.reference_fields, p.predicted_fields, a.detected_fields, a.correct_values, a.literal_correct_values, a.localized_fields, a.missing_fields, a.wrong_values,
    coalesce(e.n, 0) AS extra_fields, coalesce(p.ignored, 0) AS ignored_unreadable_predictions, r.unreadable_fields, r.absent_fields, a.critical_fields, a.critical_correct, a.critical_weight, a.critical_correct_weight,
    a.edits + coalesce(e.chars, 0) AS field_edit_distance, a.chars AS field_characters, a.relationships, a.correct_relationships
  FROM (SELECT method, document, field, count(*) AS reference_fields, count(*) FILTER (detected) AS detected_fields, count(*) FILTER (correct) AS correct_values, count(*) FILTER (literal_correct) AS literal_correct_values,
          count(*) FILTER (localized) AS localized_fields, count(*) FILTER (NOT detected) AS missing_fields, count(*) FILTER (detected AND NOT correct) AS wrong_values, count(*) FILTER (critical) AS critical_fields,
          count(*) FILTER (critical AND complete) AS critical_correct, coalesce(sum(weight) FILTER (critical), 0) AS critical_weight, coalesce(sum(weight) FILTER (critical AND complete), 0) AS critical_correct_weight,
          sum(edits) AS edits, sum(length(value)) AS chars, count(*) FILTER (target_correct IS NOT NULL) AS relationships, count(*) FILTER (target_correct AND correct) AS correct_relationships FROM matched GROUP BY ALL) a
  LEFT JOIN (SELECT method, document, field, count(*) FILTER (coalesce(ref_status, '') <> 'unreadable') AS predicted_fields, count(*) FILTER (ref_status = 'unreadable') AS ignored FROM marked GROUP BY ALL) p USING (method, document, field)
  LEFT JOIN (SELECT document, field, count(*) FILTER (status = 'unreadable') AS unreadable_fields, count(*) FILTER (status = 'absent') AS absent_fields FROM refs GROUP BY ALL) r USING (document, field)
  LEFT JOIN (SELECT method, document, field, count(*) AS n, sum(length(value)) AS chars FROM extra GROUP BY ALL) e USING (method, document, field)
)"""

SHOWN = [
    "reference_fields", "predicted_fields", "detected_fields", "correct_values", "literal_correct_values", "localized_fields", "missing_fields", "wrong_values", "extra_fields",
    "ignored_unreadable_predictions", "unreadable_fields", "absent_fields", "critical_fields", "critical_correct", "field_edit_distance", "field_characters", "relationships", "correct_relationships",
]
AS_LONG = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in SHOWN)
AS_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SHOWN)


@query("j05_w08_reference_match", f"""WITH {FIX} SELECT method, document, record, field, detected, coalesce(candidates, 0) AS candidates, correct, literal_correct, CAST(edits AS BIGINT) AS edits, reason FROM matched""")
def j05(spark, sf_dir):
    made = B.matches(*inputs(spark, sf_dir))
    return made.select("method", "document", "record", "field", "detected", F.coalesce("candidates", F.lit(0)).alias("candidates"), "correct", "literal_correct", "edits", "reason")


@query("f16_localization", f"""WITH {FIX} SELECT method, document, field, count(*) FILTER (localized) AS localized FROM matched GROUP BY ALL""")
def f16(spark, sf_dir):
    return B.matches(*inputs(spark, sf_dir), threshold=1 / 2).groupBy("method", "document", "field").agg(F.count_if("localized").alias("localized"))


@query("j06_j07_extra_predictions", f"WITH {FIX} SELECT method, document, idx, record, field, value, reason FROM extra")
def j06(spark, sf_dir):
    refs, preds, profile = inputs(spark, sf_dir)
    return B.extras(refs, preds, profile, B.matches(refs, preds, profile)).drop("unknown_field")


@query("j08_relationships", f"""WITH {FIX} SELECT method, document, record, field, target, correct AND target_correct AS correct FROM matched WHERE target_correct IS NOT NULL""")
def j08(spark, sf_dir):
    return B.relations(B.matches(*inputs(spark, sf_dir)))


@query("a26_counters", f"""WITH {FIX} SELECT method, document, field, {AS_LONG}, CAST(critical_correct_weight AS DOUBLE) AS critical_correct_weight FROM counts""")
def a26(spark, sf_dir):
    made = B.counters(*inputs(spark, sf_dir)).where("field is not null")
    return made.select("method", "document", "field", *SHOWN, "critical_correct_weight")


@query(
    "a27_ratios",
    f"""WITH {FIX}, t AS (SELECT method, {AS_SUMS}, sum(critical_weight) AS w, sum(critical_correct_weight) AS cw FROM counts GROUP BY method)
        SELECT method, round(detected_fields / predicted_fields, 9) AS field_precision, round(correct_values / reference_fields, 9) AS value_recall,
        round(2 * correct_values / (predicted_fields + reference_fields), 9) AS value_f1, round(cw / w, 9) AS weighted_critical_field_accuracy,
        round(field_edit_distance / field_characters, 9) AS field_character_error_rate, round(correct_relationships / relationships, 9) AS relationship_accuracy FROM t""",
)
def a27(spark, sf_dir):
    counts = B.counters(*inputs(spark, sf_dir))
    total = counts.groupBy("method").agg(*[F.sum(c).alias(c) for c in B.COUNTERS if c in counts.columns])
    names = ["field_precision", "value_recall", "value_f1", "weighted_critical_field_accuracy", "field_character_error_rate", "relationship_accuracy"]
    return rounded(B.ratios(total).select("method", *names), *names)


@query(
    "a28_rollup",
    f"""WITH {FIX}, g AS (SELECT c.*, d.template_id FROM counts c JOIN (SELECT DISTINCT document, template_id FROM refs) d USING (document))
        SELECT CASE WHEN grouping(field) = 0 THEN 'field' WHEN grouping(template_id) = 0 THEN 'template' WHEN grouping(document) = 0 THEN 'document' ELSE 'method' END AS level,
        method, field, template_id, document, {AS_SUMS} FROM g GROUP BY GROUPING SETS ((method), (method, field), (method, template_id), (method, document))""",
)
def a28(spark, sf_dir):
    refs, preds, profile = inputs(spark, sf_dir)
    counts = B.counters(refs, preds, profile).where("field is not null")
    return B.rollup(counts, refs.select("document", "template_id").distinct()).select("level", "method", "field", "template_id", "document", *SHOWN)


SCORES = """d AS (SELECT method, document, sum(critical_correct_weight) AS a, sum(critical_weight) AS b FROM counts GROUP BY ALL),
  s AS (SELECT method, 100 * avg(a / nullif(b, 0)) AS by_document, 100 * sum(a) / sum(b) AS by_field FROM d GROUP BY method)"""


@query("a29_w02_method_ranking", f"WITH {FIX}, {SCORES} SELECT rank, method, round(by_document, 7) AS score, round(by_field, 7) AS pooled FROM ({sql.tolerant('s', 'by_document', 'method', '1e-10')})")
def a29(spark, sf_dir):
    counts = B.counters(*inputs(spark, sf_dir)).where("field is not null")
    both = B.method_scores(counts).join(B.method_scores(counts, "field").withColumnRenamed("score", "pooled"), "method")
    ranked = C.tolerant_rank(both, "score", "method", 1e-10)
    return ranked.select(F.col("rank").cast("long"), "method", F.round("score", 7).alias("score"), F.round("pooled", 7).alias("pooled"))


@query(
    "a30_records_and_documents",
    f"""WITH {FIX}, r AS (SELECT x.method, x.document, count(*) AS eligible_records, count(*) FILTER (x.n = x.ok AND c.record IS NULL) AS correct_records
          FROM recs x LEFT JOIN crit_extra c USING (method, document, record) GROUP BY ALL),
        d AS (SELECT method, document, sum(n) AS n, sum(ok) AS ok FROM recs GROUP BY ALL)
        SELECT r.method, r.document, r.eligible_records, r.correct_records, CAST(1 AS BIGINT) AS eligible_documents,
        CAST(d.n = d.ok AND NOT EXISTS (SELECT 1 FROM crit_extra c WHERE c.method = d.method AND c.document = d.document) AS BIGINT) AS correct_documents FROM r JOIN d USING (method, document)""",
)
def a30(spark, sf_dir):
    counts = B.counters(*inputs(spark, sf_dir)).where("field is null")
    return counts.select("method", "document", "eligible_records", "correct_records", "eligible_documents", "correct_documents")


@query(
    "p16_constraint_report",
    f"""WITH {FIX}, mine AS (SELECT * FROM marked WHERE coalesce(ref_status, '') NOT IN ('unreadable', 'not_applicable')),
        per AS (SELECT method, document, record, field, count(*) AS n, bool_or(trim(value) <> '') AS filled FROM mine GROUP BY ALL),
        slots AS (SELECT DISTINCT m.method, r.document, r.record, p.field FROM refs r CROSS JOIN methods m CROSS JOIN profile p
          WHERE NOT EXISTS (SELECT 1 FROM refs x WHERE x.document = r.document AND x.record = r.record AND x.field = p.field AND x.status = 'unreadable')),
        found AS (
          SELECT method, document, record, field, 'missing_value' AS reason, value FROM mine WHERE trim(value) = ''
          UNION ALL SELECT method, document, record, field, 'pattern', value FROM mine WHERE field = 'Priority' AND NOT regexp_full_match(value, '[1-4]-.*')
          UNION ALL SELECT method, document, record, field, 'enum', value FROM mine WHERE field = 'Status' AND value NOT IN ('F', 'O')
          UNION ALL SELECT method, document, record, field, 'maximum', value FROM mine WHERE field = 'Amount' AND CAST(value AS DECIMAL(38, 9)) > 400000
          UNION ALL SELECT method, document, record, field, 'minimum', value FROM mine WHERE field = 'Amount' AND CAST(value AS DECIMAL(38, 9)) < 1000
          UNION ALL SELECT method, document, record, field, 'duplicate_field', NULL FROM per WHERE n > 1
          UNION ALL SELECT s.method, s.document, s.record, s.field, 'required_field_missing', NULL FROM slots s LEFT JOIN per USING (method, document, record, field)
            WHERE s.field IN ('Amount', 'Date') AND NOT coalesce(filled, false)
          UNION ALL SELECT method, document, record, field, 'missing_relationship_target', 'Status' FROM mine x WHERE field = 'Amount'
            AND NOT EXISTS (SELECT 1 FROM per t WHERE t.method = x.method AND t.document = x.document AND t.record = x.record AND t.field = 'Status' AND t.filled))
        SELECT method, document, record, field, reason, value FROM found""",
)
def p16(spark, sf_dir):
    refs, preds, profile = inputs(spark, sf_dir)
    rules = spark.createDataFrame(
        [("Amount", True, None, None, 1000.0, 400000.0), ("Date", True, None, None, None, None), ("Priority", False, "[1-4]-.*", None, None, None), ("Status", False, None, ["F", "O"], None, None)],
        "field string, required boolean, pattern string, enum array<string>, minimum double, maximum double",
    )
    return B.violations(preds, profile, rules, refs)


@query("p12_template_splits", f"WITH {FIX} SELECT template_id, count(DISTINCT split) AS splits FROM refs GROUP BY template_id")
def p12(spark, sf_dir):
    return fixtures.references(spark, sf_dir).groupBy("template_id").agg(F.count_distinct("split").alias("splits"))


@query("p12_leaking_templates", f"WITH {FIX} SELECT document % 7 AS template_id, count(DISTINCT split) AS splits FROM refs GROUP BY ALL HAVING count(DISTINCT split) > 1")
def p12_leak(spark, sf_dir):
    return B.leaking_templates(fixtures.references(spark, sf_dir).withColumn("template_id", F.col("document") % 7))


@query("p13_missing_predictions", f"WITH {FIX} SELECT r.document, r.record, r.field FROM refs r WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.method = 'noisy' AND p.document = r.document AND p.record = r.record AND p.field = r.field)")
def p13(spark, sf_dir):
    refs, preds, _ = inputs(spark, sf_dir)
    return refs.select(*B.KEY).join(preds.where("method = 'noisy'"), B.KEY, "left_anti")


@query("p08_split_filter", f"WITH {FIX} SELECT split, field, count(*) AS n FROM refs WHERE split = 'test' GROUP BY ALL")
def p08(spark, sf_dir):
    return fixtures.references(spark, sf_dir).where("split = 'test'").groupBy("split", "field").agg(F.count(F.lit(1)).alias("n"))


@query("f17_box_validity", f"WITH {FIX} SELECT field, bbox[4] <= 0.25 AS sound, count(*) AS n FROM refs WHERE field IN ('Amount', 'Date', 'Priority') GROUP BY ALL")
def f17(spark, sf_dir):
    scaled = F.transform("bbox", lambda x: x * 4)
    upper = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.get(scaled, F.lit(3)))
    refs = fixtures.references(spark, sf_dir).where("field in ('Amount', 'Date', 'Priority')")
    return refs.withColumn("sound", V.box_valid(upper)).groupBy("field", "sound").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f10_typed_values",
    f"""WITH {FIX} SELECT record, field, {canon('value')} AS value FROM base WHERE value <> '?'""",
)
def f10(spark, sf_dir):
    preds, profile = fixtures.predictions(spark, sf_dir).where("method = 'plain' and value <> '?'"), fixtures.profile(spark)
    return preds.join(profile, "field").select("record", "field", B.canonical("value")["value"].alias("value"))


@query(
    "f10_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS long_form, strftime(o_orderdate, '%Y-%m-%d') AS day_first,
       CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') END AS guessed,
       CASE WHEN NOT (day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate)) THEN 'ambiguous_date' END AS error FROM orders""",
)
def f10_dates(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    typed = lambda pattern, order: V.typed_value(F.date_format("o_orderdate", pattern), F.lit("date"), F.lit("Date"), F.lit(order).cast("string"))
    guess = typed("d/M/yyyy", None)
    return orders.select("o_orderkey", typed("MMMM d, yyyy", None)["value"].alias("long_form"), typed("d-M-yyyy", "dmy")["value"].alias("day_first"), guess["value"].alias("guessed"), guess["error"].alias("error"))


@query(
    "f09_f12_types_and_shapes",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'amount' WHEN 1 THEN 'date' WHEN 2 THEN 'currency' WHEN 3 THEN 'identifier' ELSE 'text' END AS kind,
       CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS shaped FROM customer""",
)
def f09(spark, sf_dir):
    pick = (F.col("c_custkey") % 5).cast("int")
    names = F.array(*map(F.lit, ("TotalBalance", "SettlementDate", "TradeCurrency", "AccountIdentification", "Remark")))
    kind = V.value_type(F.get(names, pick))
    values = F.array((F.round(F.abs("c_acctbal"))).cast("long").cast("string"), F.col("c_mktsegment"), F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.col("c_name"))
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), V.looks_like_value(F.get(values, pick), kind, F.lit(None).cast("string")).alias("shaped"))


@query("f15_edit_distance", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS edits FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def f15(spark, sf_dir):
    n = fixtures.table(spark, sf_dir, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"{x}k"), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").where("ak < bk").select("a", "b", V.edit_distance(F.col("a"), F.col("b")).alias("edits"))


# No SQL: DuckDB's levenshtein counts bytes, not characters. tests/test_whole_jobs.py has a brute-force version.
@query("j09_region_errors")
def j09(spark, sf_dir):
    rows = fixtures.pages(spark, sf_dir).select("method", "document", F.col("page").alias("region"), "text")
    return B.regions(rows.where("method = 'alpha'").drop("method"), rows.where("method in ('beta', 'gamma') and text <> ''"))


@query(
    "j23_variant_differences",
    f"""WITH {FIX}, {SCORES}, v AS (SELECT 'documents' AS variant, method, by_document AS score FROM s UNION ALL SELECT 'fields', method, by_field FROM s)
        SELECT v.variant, v.method, round(v.score - b.score, 7) AS difference FROM v JOIN v b ON b.method = v.method AND b.variant = 'documents'""",
)
def j23(spark, sf_dir):
    counts = B.counters(*inputs(spark, sf_dir)).where("field is not null")
    named = [B.method_scores(counts, w).select(F.lit(v).alias("variant"), "method", "score") for v, w in (("documents", "document"), ("fields", "field"))]
    made = B.variant_differences(named[0].union(named[1]), "documents")
    return made.select("variant", "method", (F.round("difference", 7) + 0.0).alias("difference"))


@query(
    "j24_outcome_changes",
    f"""WITH {FIX} SELECT a.document, a.record, a.field, a.reason AS before, b.reason AS after FROM m1 a FULL JOIN m1 b
        ON a.document = b.document AND a.record = b.record AND a.field = b.field WHERE a.method = 'plain' AND b.method = 'noisy' AND a.reason IS DISTINCT FROM b.reason""",
)
def j24(spark, sf_dir):
    made = B.matches(*inputs(spark, sf_dir)).select("method", *B.KEY, "reason")
    before, after = (made.where(F.col("method") == m).select(*B.KEY, F.col("reason").alias(n)) for m, n in (("plain", "before"), ("noisy", "after")))
    return before.join(after, B.KEY, "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query(
    "j25_page_routing",
    f"""WITH {FIX}, routed AS (SELECT DISTINCT document, field, page, value FROM base) SELECT field, page, count(*) AS n FROM routed
        WHERE (field, page) IN (VALUES ('Amount', 1), ('Date', 2), ('Status', 3)) GROUP BY ALL""",
)
def j25(spark, sf_dir):
    routes = spark.createDataFrame([("Amount", 1), ("Date", 2), ("Status", 3)], "field string, page long")
    mine = fixtures.predictions(spark, sf_dir).where("method = 'plain'").select("document", "field", "page", "value")
    return mine.join(F.broadcast(routes), ["field", "page"]).dropDuplicates(["document", "field", "page", "value"]).groupBy("field", "page").agg(F.count(F.lit(1)).alias("n"))
