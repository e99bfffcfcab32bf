"""Queries that align, decode, extract and route; SQL where it can say the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions import text as T
from ..operators import alignment as A
from ..operators import consensus as C
from ..operators import corroboration as K
from ..operators import discovery, extraction, regions, statistics
from ..operators import panel as P
from ..operators.vocabulary import compiled, weighted_overlap
from ..sources import fixtures, json_io
from . import sql
from .consensus import rounded, scores

QUERIES, ORACLES = {}, {}

VOCABULARY = {
    "date_order": "dmy",
    "concepts": {
        "Customer": {"aliases": ["Client"], "fields": ["Name", "AccountBalance", "BalanceCurrency", "OpeningDate", "MarketSegment"]},
        "Nation": {"fields": ["NationKey"], "field_types": {"NationKey": "identifier"}},
    },
}
#: Frequent words of the synthetic talk, as labels for the region operators.
TALK = {"concepts": {"Thing": {"name": "tion", "aliases": ["the", "and", "une"], "fields": ["est", "pour", "that"]}, "Other": {"name": "ment", "fields": ["that", "dans"]}}}
PROFILE = {"fields": {"Amount": {"aliases": ["Total Price"]}, "Status": {}, "Date": {"aliases": ["OrderDate"]}}, "record_key_labels": ["Order"]}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def shown(df: DataFrame, key: str, text) -> DataFrame:
    return df.select(key, F.length(text).alias("characters"), F.md5(text.cast("binary")).alias("text_md5"))


@query("f01_f03_flat_text")
def f01(spark, sf_dir):
    pages = fixtures.table(spark, sf_dir, "pages").withColumn("flat", D.extract_text("html", F.lit("html")))
    return shown(pages, "page_id", F.col("flat"))


@query("f02_f03_line_text")
def f02(spark, sf_dir):
    pages = fixtures.table(spark, sf_dir, "pages").withColumn("lined", D.field_text("html", F.lit("html")))
    return shown(pages, "page_id", F.col("lined"))


@query("f04_f05_clean", r"SELECT doc_id, length(t) AS characters, md5(t) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(replace(text, chr(173), ''), '\s+', ' ', 'g')) AS t FROM documents)")
def f04(spark, sf_dir):
    return shown(fixtures.table(spark, sf_dir, "documents").withColumn("clean", D.clean("text")), "doc_id", F.col("clean"))


@query("f18_fingerprints", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f18(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("f08_name_variants", r"""SELECT p_partkey, CASE WHEN regexp_replace(p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g') = p_brand THEN 1 ELSE 2 END AS variants FROM part""")
def f08(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", F.size(T.name_variants(F.col("p_brand"))).alias("variants"))


@query("j03_hyphen_repair", rf"""WITH {sql.CORPUS} SELECT document, page, method, length(t) AS characters, md5(t) AS text_md5 FROM (SELECT document, page, method, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM corpus)""")
def j03(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    broken = F.when(F.col("method") == "beta", F.regexp_replace("text", r"(\p{L}{4})(\p{L}{3,}) ", "$1-\n$2 ")).otherwise(F.col("text"))
    return A.repair_hyphens(pages.withColumn("text", broken)).select("document", "page", "method", F.length("text").alias("characters"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("j12_a04_sequence_similarity")
def a04(spark, sf_dir):
    return rounded(A.sequence_similarity(fixtures.pages(spark, sf_dir)), "sequence_similarity")


@query("j12_changes")
def j12(spark, sf_dir):
    return A.changes(fixtures.pages(spark, sf_dir))


def evidence(spark, sf_dir):
    return K.passage_evidence(fixtures.pages(spark, sf_dir), list(fixtures.PANEL), 40)


@query("j13_j14_passage_evidence")
def j13(spark, sf_dir):
    return evidence(spark, sf_dir).select("document", "page", "method", "passage", "peer", "state", "peer_token_start", "peer_token_end")


@query(
    "w05_passages",
    f"""WITH {sql.CORPUS}, lines AS (SELECT document, page, method, i, len(words) AS n FROM (
          SELECT document, page, method, i, {sql.tokens('line')} AS words FROM (SELECT document, page, method, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM corpus))),
        placed AS (SELECT *, sum(n) OVER (PARTITION BY document, page, method ORDER BY i) - n AS first FROM lines),
        cut AS (SELECT document, page, method, CAST(first + k * 40 AS INTEGER) AS token_start, CAST(first + least(n, k * 40 + 40) AS INTEGER) AS token_end
          FROM (SELECT *, unnest(range(0, CAST(ceil(n / 40.0) AS BIGINT))) AS k FROM placed))
        SELECT *, CAST(row_number() OVER (PARTITION BY document, page, method ORDER BY token_start) AS INTEGER) AS passage FROM cut""",
)
def w05(spark, sf_dir):
    return evidence(spark, sf_dir).where("peer = 'alpha'").select("document", "page", "method", "passage", "token_start", "token_end")


@query("a21_family_states")
def a21(spark, sf_dir):
    return K.family_states(evidence(spark, sf_dir), fixtures.panel(spark)).select("document", "page", "method", "passage", "family", "state")


def corroborated(spark, sf_dir):
    return K.corroborate(fixtures.pages(spark, sf_dir), fixtures.families(spark), fixtures.panel(spark))


@query("t4_a22_k05_passages")
def a22(spark, sf_dir):
    return K.flat(corroborated(spark, sf_dir)[0])


@query("a23_page_rollup")
def a23(spark, sf_dir):
    return corroborated(spark, sf_dir)[1]


@query("a24_summary")
def a24(spark, sf_dir):
    return corroborated(spark, sf_dir)[2]


@query("a25_o02_saved_ranking")
def a25(spark, sf_dir):
    families, panel = fixtures.families(spark), fixtures.panel(spark)
    by_page = P.panel_scores(scores(spark, sf_dir), families, panel)
    whole = fixtures.pages(spark, sf_dir).groupBy("document", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    by_document = P.panel_scores(C.pair_scores(whole.withColumn("page", F.lit(1).cast("long"))), families, panel)
    return rounded(K.ranking(corroborated(spark, sf_dir)[0], by_page, by_document), "score", "document_score")


LABELS = ("thing", "tion", "the", "and", "une", "est", "pour", "that", "other", "ment", "dans")


@query(
    "j15_a06_label_weighted_overlap",
    f"""WITH {sql.TOKENS}, size AS (SELECT document, page, method, len(words) AS n, len(list_filter(words, lambda w: w IN {LABELS})) AS labels FROM tok),
        met AS (SELECT a.document, a.page, a.method AS "left", b.method AS "right", sum(least(a.n, b.n)) AS s, coalesce(sum(least(a.n, b.n)) FILTER (a.t IN {LABELS}), 0) AS l
          FROM uni a JOIN uni b ON a.document = b.document AND a.page = b.page AND a.t = b.t AND a.method < b.method GROUP BY ALL)
        SELECT a.document, a.page, a.method AS "left", b.method AS "right", round(CASE WHEN a.n + b.n > 0 THEN 2.0::DOUBLE * (coalesce(s, 0) + 2 * coalesce(l, 0)) / (a.n + b.n + 2 * (a.labels + b.labels)) ELSE 0.0 END, 9) AS overlap,
          round(CASE WHEN a.labels + b.labels > 0 THEN 2.0::DOUBLE * coalesce(l, 0) / (a.labels + b.labels) END, 9) AS phrases
        FROM size a JOIN size b ON a.document = b.document AND a.page = b.page AND a.method < b.method LEFT JOIN met m ON m.document = a.document AND m.page = a.page AND m."left" = a.method AND m."right" = b.method""",
)
def a06(spark, sf_dir):
    root = compiled(TALK)
    both = C.pairs(fixtures.pages(spark, sf_dir).select("document", "page", "method", T.tokens(F.col("text")).alias("words")))

    @F.pandas_udf("struct<overlap:double,phrases:double>")
    def score(left, right):
        import pandas as pd

        return pd.DataFrame([weighted_overlap(list(a), list(b), root, 3.0) for a, b in zip(left, right, strict=True)], columns=["overlap", "phrases"])

    made = both.select("document", "page", F.col("l.method").alias("left"), F.col("r.method").alias("right"), score("l.words", "r.words").alias("s"))
    return rounded(made.select("document", "page", "left", "right", "s.overlap", "s.phrases"), "overlap", "phrases")


@query("j10_j11_a07_region_agreement")
def a07(spark, sf_dir):
    return rounded(regions.region_agreement(fixtures.pages(spark, sf_dir), compiled(TALK)).drop("examples"), "matched_mass", "agreement", "anchor_agreement")


#: Those of the labels that are no stop words.
ANCHORS = ("thing", "tion", "une", "est", "pour", "other", "ment", "dans")


@query(
    "w04_a09_a36_localization",
    f"""WITH {sql.CORPUS}, t AS (SELECT document, page, method, {sql.tokens('text')} AS words FROM corpus),
        spots AS (SELECT document, page, method, len(words) AS n, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i] IN {ANCHORS})) AS p FROM t),
        near AS (SELECT document, page, method, count(DISTINCT i) AS k FROM (SELECT document, page, method, unnest(range(greatest(1, p - 16), least(n, p + 16) + 1)) AS i FROM spots) GROUP BY ALL),
        found AS (SELECT document, page, method, count(*) AS a FROM spots GROUP BY ALL)
        SELECT document, page, method, CAST(coalesce(a, 0) AS INTEGER) AS anchors, CAST(0 AS INTEGER) AS unclear_anchors, CAST(len(words) AS INTEGER) AS tokens, CAST(coalesce(k, 0) AS INTEGER) AS selected_tokens, CAST(coalesce(k, 0) AS DOUBLE) AS weight_sum
        FROM t LEFT JOIN near USING (document, page, method) LEFT JOIN found USING (document, page, method)""",
)
def a09(spark, sf_dir):
    return regions.localization(fixtures.pages(spark, sf_dir), compiled(TALK))


def accounts(spark, sf_dir, wrong: bool = False) -> DataFrame:
    """(unit, text): a labelled page for each customer; ``wrong`` changes every fifth balance and drops every seventh date."""
    # Dealt anew: a page is many times as long as what the file holds of it, so one split of the file would be one task's many pages.
    c = fixtures.table(spark, sf_dir, "customer").repartition("c_custkey")
    balance = F.round(F.abs("c_acctbal")).cast("long")
    balance = F.when((F.col("c_custkey") % 5 == 0) & F.lit(wrong), balance + 1).otherwise(balance)
    day = F.concat(F.col("c_custkey") % 28 + 1, F.lit("/03/2024"))
    dated = F.when((F.col("c_custkey") % 7 == 0) & F.lit(wrong), "Opening Date: soon").otherwise(F.concat(F.lit("Opening Date: "), day))
    text = F.concat_ws("\n", F.lit("Customer"), F.concat(F.lit("Name: "), "c_name"), F.concat(F.lit("Account Balance: "), balance, F.lit(".50; Balance Currency: usd")), dated, F.concat(F.lit("Nation Key\t"), F.col("c_nationkey")))
    return c.select(F.col("c_custkey").alias("unit"), text.alias("text"))


EXPECTED = """SELECT c_custkey AS unit, 'Customer.Name' AS field, lower(c_name) AS value, NULL AS error FROM customer
  UNION ALL SELECT c_custkey, 'Customer.AccountBalance', '["' || CAST(CAST(round(abs(c_acctbal)) AS BIGINT) AS VARCHAR) || '.5", "", "USD"]', NULL FROM customer
  UNION ALL SELECT c_custkey, 'Customer.BalanceCurrency', 'USD', NULL FROM customer
  UNION ALL SELECT c_custkey, 'Customer.OpeningDate', '2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), NULL FROM customer
  UNION ALL SELECT c_custkey, 'Nation.NationKey', CAST(c_nationkey AS VARCHAR), NULL FROM customer"""


@query("j16_j17_j18_w09_field_values", EXPECTED)
def j16(spark, sf_dir):
    found, _ = extraction.read_pages(accounts(spark, sf_dir), compiled(VOCABULARY), ["unit"])
    return extraction.bind_currencies(found, ["unit"]).select("unit", "field", "value", "error")


@query(
    "a10_field_value_agreement",
    """SELECT c_custkey AS unit, CAST(5 - CAST(c_custkey % 5 = 0 AS INTEGER) - CAST(c_custkey % 7 = 0 AS INTEGER) AS BIGINT) AS shared, CAST(10 AS BIGINT) AS total,
       round((5 - CAST(c_custkey % 5 = 0 AS INTEGER) - CAST(c_custkey % 7 = 0 AS INTEGER)) / 5.0, 9)::DOUBLE AS agreement FROM customer""",
)
def a10(spark, sf_dir):
    root = compiled(VOCABULARY)
    sides = [extraction.read_pages(accounts(spark, sf_dir, w), root, ["unit"]) for w in (False, True)]
    issues = sides[0][1].union(sides[1][1]).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return rounded(extraction.value_agreement(sides[0][0], sides[1][0], issues, ["unit"]), "agreement")


@query(
    "a11_field_agreement",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 5 <> 0) AS b, count(*) FILTER (c_custkey % 7 <> 0) AS d FROM customer)
       SELECT field, n AS left_count, n AS right_count, CASE field WHEN 'Customer.AccountBalance' THEN b WHEN 'Customer.OpeningDate' THEN d ELSE n END AS matched,
       round(CASE field WHEN 'Customer.AccountBalance' THEN b WHEN 'Customer.OpeningDate' THEN d ELSE n END / n, 9) AS agreement
       FROM c CROSS JOIN (VALUES ('Customer.Name'), ('Customer.AccountBalance'), ('Customer.BalanceCurrency'), ('Customer.OpeningDate'), ('Nation.NationKey')) f(field)""",
)
def a11(spark, sf_dir):
    root = compiled(VOCABULARY)
    sides = [extraction.read_pages(accounts(spark, sf_dir, w), root, ["unit"])[0] for w in (False, True)]
    return rounded(extraction.field_agreement(*sides), "agreement")


@query(
    "w06_occurrences",
    """SELECT unit, field, CAST(row_number() OVER (PARTITION BY unit, field ORDER BY seq) AS INTEGER) AS occurrence, seq FROM (
         SELECT o_orderkey % 500 AS unit, CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END AS field, o_orderkey AS seq FROM orders)""",
)
def w06(spark, sf_dir):
    o = fixtures.table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_orderkey") % 500).alias("unit"), F.when(F.col("o_orderkey") % 2 == 0, "Even").otherwise("Odd").alias("field"), F.lit(None).cast("string").alias("record"), F.col("o_orderkey").alias("seq"))
    return extraction.occurrences(rows, ["unit"]).select("unit", "field", "occurrence", "seq")


ORDERS = """SELECT o_custkey AS document, o_orderkey AS record, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"""


@query(
    "j19_t6_profile_extraction",
    f"""WITH o AS ({ORDERS}) SELECT document, CAST(record AS VARCHAR) AS record, 'Amount' AS field, CAST(price AS VARCHAR) AS value FROM o
        UNION ALL SELECT document, CAST(record AS VARCHAR), 'Status', s FROM o UNION ALL SELECT document, 'document', 'Date', max(d) FROM o GROUP BY document""",
)
def t6(spark, sf_dir):
    o = fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.concat_ws("\t", F.col("o_orderkey"), F.round("o_totalprice").cast("long"), "o_orderstatus").alias("row"),
    )
    rows = F.array_join(F.array_sort(F.collect_list("row")), "\n")
    pages = o.groupBy("document").agg(F.concat(F.lit("Order\tTotal Price\tStatus\n"), rows, F.lit("\n\nOrder Date\n"), F.max("d")).alias("text"))
    made = extraction.profile_predictions(pages.select("document", F.lit("alpha").alias("method"), F.lit(1).cast("long").alias("page"), "text"), PROFILE)
    return made.select("document", "record", "field", "value")


WORDS = r"""list_distinct(list_filter(regexp_extract_all(replace(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda x: x NOT IN ('and', 'for', 'in', 'of', 'the', 'this', 'to', 'with')))"""


@query(
    "j21_o03_schema_shortlist",
    f"""WITH b AS (SELECT doc_id AS block_id, unnest({WORDS}) AS w FROM documents), s AS (SELECT item_id AS schema_id, unnest({WORDS}) AS w FROM benchmark),
        hit AS (SELECT block_id, schema_id, count(*) AS shared FROM b JOIN s USING (w) GROUP BY ALL),
        spare AS (SELECT d.doc_id AS block_id, x.item_id AS schema_id, 0 AS shared FROM documents d CROSS JOIN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 5) x),
        every AS (SELECT block_id, schema_id, max(shared) AS shared FROM (SELECT * FROM hit UNION ALL SELECT * FROM spare) GROUP BY ALL)
        SELECT block_id, schema_id, shared, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY block_id ORDER BY shared DESC, schema_id) AS INTEGER) AS place FROM every) WHERE place <= 5""",
)
def j21(spark, sf_dir):
    blocks = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text")
    schemas = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("schema_id"), "text")
    return discovery.shortlist(blocks, schemas, 5)


GRAPH = """WITH n AS (SELECT 'r' || r_regionkey AS schema_id, r_name AS schema_name, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS field_id, n_name AS field_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 2)"""


def graph(spark, sf_dir):
    r, n = (fixtures.table(spark, sf_dir, t) for t in ("region", "nation"))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("BusinessComponent").alias("type"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    parts = n.where("n_regionkey <> 2").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")), F.lit("BusinessElement"), "n_name", F.concat(F.lit("r"), "n_regionkey"))
    return nodes.union(parts)


@query("s12_j22_graph_catalog", f"{GRAPH} SELECT *, CAST(row_number() OVER (PARTITION BY schema_id ORDER BY field_id) AS INTEGER) AS ord FROM n")
def j22(spark, sf_dir):
    return discovery.catalog_from_graph(graph(spark, sf_dir))


@query("o07_field_batches", f"{GRAPH} SELECT schema_id, field_id, CAST((row_number() OVER (PARTITION BY schema_id ORDER BY field_id) - 1) // 2 AS BIGINT) AS batch FROM n")
def o07(spark, sf_dir):
    return discovery.batches_of(discovery.catalog_from_graph(graph(spark, sf_dir)), 2).select("schema_id", "field_id", "batch")


@query("p14_repeated_ids", f"{GRAPH} SELECT schema_id, substr(field_id, 1, 2) AS field_id, count(*) AS n FROM n GROUP BY ALL HAVING count(*) > 1")
def p14(spark, sf_dir):
    return discovery.repeated_ids(discovery.catalog_from_graph(graph(spark, sf_dir)).withColumn("field_id", F.substring("field_id", 1, 2)))


@query(
    "f21_x06_discovery",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, right(coalesce(text, ''), 40) AS quote FROM documents),
       e AS (SELECT *, CASE WHEN string_split(text, quote)[-1] = '' THEN length(text) - length(quote) ELSE 0 END AS a FROM d WHERE text <> '')
       SELECT 'r' || (doc_id % 2) AS schema_id, CAST(doc_id AS VARCHAR) AS block_id, 'head' AS field_id, CAST(a AS BIGINT) AS span_start, CAST(length(text) AS BIGINT) AS span_end, NULL AS issue FROM e
       UNION ALL SELECT 'r' || (doc_id % 2), CAST(doc_id AS VARCHAR), 'head', NULL, NULL, 'not_in_evidence' FROM d WHERE text = ''
       UNION ALL SELECT 'r' || (doc_id % 2), CAST(doc_id AS VARCHAR), 'lost', NULL, NULL, 'not_in_evidence' FROM d""",
)
def x06(spark, sf_dir):
    # All documents, with quotes from their ends.
    docs = fixtures.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    blocks = docs.select(F.col("doc_id").cast("string").alias("block_id"), F.lit(0).cast("long").alias("start"), "text")
    routes = docs.select(F.col("doc_id").cast("string").alias("block_id"), F.concat(F.lit("r"), F.col("doc_id") % 2).alias("schema_id"))
    fields = spark.createDataFrame([(s, i, f) for s in ("r0", "r1") for i, f in enumerate(("head", "lost"))], "schema_id string, ord int, field_id string")

    def claims(text: str, ids: list[str]) -> list[dict]:
        quote = text[-40:]
        starts = [m.start() for m in re.finditer(re.escape(quote), text)]
        # Occurrences don't overlap, so the end may be none of them; the whole text is quoted then.
        quote, nth = (quote, len(starts)) if starts[-1] == len(text) - len(quote) else (text, 1)
        return [{"field_id": "head", "evidence": quote, "value": quote, "occurrence": nth}, {"field_id": "lost", "evidence": "\x00", "value": "\x00"}]

    made = discovery.discover(blocks, routes, fields, claims)
    return made.select("schema_id", "block_id", "field_id", "span_start", "span_end", "issue")


@query("a31_bootstrap")
def a31(spark, sf_dir):
    return rounded(statistics.bootstrap(C.page_scores(scores(spark, sf_dir))), "share_first", "low", "high")


@query("a35_timings", "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS longest FROM events GROUP BY event_type")
def a35(spark, sf_dir):
    made = statistics.timings(fixtures.table(spark, sf_dir, "events"), ["event_type"], "value")
    return made.withColumns({c: F.round(c, 6) for c in ("total", "mean", "median", "longest")})


@query(
    "f22_miss_diagnosis",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bound_elsewhere' WHEN 1 THEN 'not_extracted' WHEN 2 THEN 'format' WHEN 3 THEN 'other_page' ELSE 'misread' END AS cause, length(p_brand) <= 3 AS weak FROM part""",
)
def f22(spark, sf_dir):
    pick = F.col("p_partkey") % 5
    ref = F.col("p_brand")
    spaced = F.regexp_replace(ref, "(.)", "$1 ")
    rows = fixtures.table(spark, sf_dir, "part").select(
        "p_partkey", ref.alias("reference"), F.when(pick != 1, "zzzzzzzzzzzzzzzzzz").alias("predicted"),
        F.when(pick < 2, F.concat(F.lit("x "), ref)).when(pick == 2, spaced).otherwise("none").alias("page_text"), F.when(pick == 3, ref).otherwise("none").alias("document_text"),
    )
    return statistics.diagnosis(rows).select("p_partkey", "cause", "weak")


@query("p19_response_classes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'invalid' WHEN 1 THEN 'refusal' WHEN 2 THEN 'truncated' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'incomplete' ELSE 'ok' END AS outcome FROM events")
def p19(spark, sf_dir):
    bodies = ("nonsense", '{"refusal":"no","page":7}', '{"finish_reason":"length","page":7}', '{"page":8,"text":"a"}', '{"page":7}', '{"page":7,"text":"a"}')
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", F.lit(7).alias("page"), F.get(F.array(*map(F.lit, bodies)), (F.col("event_id") % 6).cast("int")).alias("body"))
    return statistics.response_class(rows).select("event_id", "outcome")


@query("s16_file_discovery")
def s16(spark, sf_dir):
    found = json_io.discover_files(spark, sf_dir, "*.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")
