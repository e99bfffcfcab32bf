"""Queries on agreement between methods, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import consensus as C
from ..sources import fixtures
from . import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to nine places: sums run in any order, their last bits differ."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_scores(fixtures.pages(spark, sf_dir))


for _table, _key in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id")):
    _text = "html" if _table == "pages" else "text"

    def _tokens(spark, sf_dir, name=_table, key=_key, text=_text):
        words = fixtures.table(spark, sf_dir, name).select(key, T.tokens(F.col(text)).alias("words"))
        return words.select(key, F.size("words").alias("n_tokens"), F.md5(F.array_join("words", " ").cast("binary")).alias("token_md5"))

    query(
        f"f06_tokens_{_table}",
        f"SELECT {_key}, len(words) AS n_tokens, md5(array_to_string(words, ' ')) AS token_md5 FROM (SELECT {_key}, {sql.tokens(_text)} AS words FROM {_table})",
    )(_tokens)


@query(
    "f07_numeric_counts",
    f"SELECT doc_id, number, count(*) AS n FROM (SELECT doc_id, unnest({sql.numbers('text')}) AS number FROM documents) GROUP BY ALL",
)
def f07(spark, sf_dir):
    each = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("number"))
    return each.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n"))


@query("f13_label_key", r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ' ') AS label FROM part")
def f13(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", T.label_key(F.col("p_name")).alias("label"))


@query(
    "f19_routing_words",
    r"""SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(replace(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), 'ß', 'ss'), '[\p{L}\p{N}]+'),
        lambda x: x NOT IN ('and', 'for', 'in', 'of', 'the', 'this', 'to', 'with')))) AS n_words FROM benchmark""",
)
def f19(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.size(T.routing_words(F.col("text"))).alias("n_words"))


@query(
    "f20_w10_text_chunks",
    """SELECT doc_id, i * 80 AS start, substr(text, i * 80 + 1, 100) AS chunk FROM
       (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 20) / 80.0) AS BIGINT)))) AS i FROM documents)""",
)
def f20(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.inline(T.chunks(F.col("text"), 100, 20))).select("doc_id", F.col("start").cast("long"), F.col("text").alias("chunk"))


@query("f25_redact_messages", r"""SELECT event_id, regexp_replace(props, '(?i)((?:api[_-]?key|token|secret|password)["'']?\s*[:=]\s*["'']?)[^\s"'',;]+', '\1[redacted]', 'g') AS props FROM events""")
def f25(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").select("event_id", T.redact(F.col("props")).alias("props"))


@query("f26_visual_tokens", "SELECT p_partkey, CAST(ceil(p_size * 30 / 28.0) * ceil(p_size * 17 / 28.0) AS BIGINT) AS tokens FROM part")
def f26(spark, sf_dir):
    size = F.col("p_size")
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", T.visual_tokens(size * 30, size * 17).alias("tokens"))


@query(
    "f24_w11_repeated_ngrams",
    """WITH ids AS (SELECT doc_id, list_transform(list_slice(string_split(text, ' '), -64, -1), lambda x: CAST(length(x) AS BIGINT)) AS a FROM documents),
       hit AS (SELECT doc_id, unnest(CASE WHEN len(a) >= 3 THEN range(1, len(a) - 1) ELSE [] END) AS i, a FROM ids)
       SELECT d.doc_id, coalesce(h.banned, '') AS banned FROM documents d LEFT JOIN (
         SELECT doc_id, string_agg(DISTINCT CAST(a[i + 2] AS VARCHAR), ',' ORDER BY CAST(a[i + 2] AS VARCHAR)) AS banned FROM hit
         WHERE a[i] = a[len(a) - 1] AND a[i + 1] = a[len(a)] GROUP BY doc_id) h USING (doc_id)""",
)
def f24(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    banned = T.banned_next(ids, 3, 64)
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.transform(banned, lambda x: x.cast("string"))), ",").alias("banned"))


@query(
    "j01_method_pairs",
    f"""WITH {sql.CORPUS} SELECT a.document, a.page, a.method AS "left", b.method AS "right" FROM corpus a JOIN corpus b
        ON a.document = b.document AND a.page = b.page AND a.method < b.method""",
)
def j01(spark, sf_dir):
    units = fixtures.pages(spark, sf_dir).select("document", "page", "method")
    return C.pairs(units).select("document", "page", F.col("l.method").alias("left"), F.col("r.method").alias("right"))


@query(
    "j02_a03_token_overlap",
    f"""WITH {sql.PAIRS} SELECT document, page, "left", "right", left_tokens, right_tokens, shared_tokens, round(token_overlap, 9) AS token_overlap FROM scores""",
)
def j02(spark, sf_dir):
    made = scores(spark, sf_dir).select("document", "page", "left", "right", "left_tokens", "right_tokens", "shared_tokens", "token_overlap")
    return rounded(made, "token_overlap")


@query(
    "a01_w03_signatures",
    f"""WITH {sql.TOKENS} SELECT t.document, t.page, t.method, len(t.words) AS n_words, greatest(len(t.words) - 1, 0) AS n_bigrams,
        coalesce(u.d, 0) AS distinct_words, coalesce(b.d, 0) AS distinct_bigrams FROM tok t
        LEFT JOIN (SELECT document, page, method, count(*) AS d FROM uni GROUP BY ALL) u USING (document, page, method)
        LEFT JOIN (SELECT document, page, method, count(*) AS d FROM bi GROUP BY ALL) b USING (document, page, method)""",
)
def a01(spark, sf_dir):
    made = C.signatures(fixtures.pages(spark, sf_dir))
    return made.select("document", "page", "method", "n_words", "n_bigrams", F.size(F.array_distinct("words")).alias("distinct_words"), F.size(F.array_distinct(C.bigrams(F.col("words")))).alias("distinct_bigrams"))


@query("a02_agreement", f"""WITH {sql.PAIRS} SELECT document, page, "left", "right", round(token_overlap, 9) AS token_dice, round(bigram_overlap, 9) AS bigram_dice, round(similarity, 9) AS similarity FROM scores""")
def a02(spark, sf_dir):
    made = scores(spark, sf_dir).select("document", "page", "left", "right", F.col("token_overlap").alias("token_dice"), F.col("bigram_overlap").alias("bigram_dice"), "similarity")
    return rounded(made, "token_dice", "bigram_dice", "similarity")


@query("a05_numeric_agreement", f"""WITH {sql.PAIRS} SELECT document, page, "left", "right", total_numbers, round(numeric_agreement, 9) AS numeric_agreement FROM scores""")
def a05(spark, sf_dir):
    made = scores(spark, sf_dir).select("document", "page", "left", "right", "total_numbers", "numeric_agreement")
    return rounded(made, "numeric_agreement")


RANKED = f"""{sql.PAIRS}, sides AS ({sql.ends('scores', 'document, page', 'token_overlap')}),
  by_page AS (SELECT document, page, method, avg(s) AS s FROM sides GROUP BY ALL),
  by_document AS (SELECT document, method, avg(s) AS s FROM by_page GROUP BY ALL),
  overall AS (SELECT method, avg(s) AS score FROM by_document GROUP BY method)"""


@query("a12_consensus_mean", f"WITH {RANKED} SELECT method, round(score, 9) AS score FROM overall")
def a12(spark, sf_dir):
    return rounded(C.consensus(scores(spark, sf_dir)), "score")


@query("a12_consensus_by_page", f"WITH {RANKED} SELECT method, round(avg(s), 9) AS score FROM by_page GROUP BY method")
def a12_page(spark, sf_dir):
    return rounded(C.consensus(scores(spark, sf_dir), weighting="page"), "score")


@query("t1_consensus_ranking", f"WITH {RANKED} SELECT rank, method, round(100 * score, 7) AS score FROM ({sql.tolerant('overall', 'score', 'method', '1e-12')})")
def t1(spark, sf_dir):
    ranked = C.tolerant_rank(C.consensus(scores(spark, sf_dir)), "score", "method", 1e-12)
    return ranked.select(F.col("rank").cast("long"), "method", F.round(100 * F.col("score"), 7).alias("score"))


@query(
    "w01_tolerant_ranks",
    f"""WITH s AS (SELECT s_name AS name, s_nationkey AS k, round(s_acctbal / 100) * 0.25 AS score FROM supplier)
        SELECT name, k, score, rank FROM ({sql.tolerant('s', 'score', 'name', '0.3')})""",
)
def w01(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("k"), (F.round(F.col("s_acctbal") / 100) * 0.25).alias("score"))
    return C.tolerant_rank(rows, "score", "name", 0.3).select("name", "k", "score", F.col("rank").cast("long"))


@query(
    "a13_pair_summary",
    f"""WITH {sql.PAIRS} SELECT "left", "right", count(*) AS pages, count(numeric_agreement) AS pages_with_numbers, round(avg(numeric_agreement), 9) AS mean_numeric_agreement,
        round(avg(token_overlap), 9) AS mean_token_overlap, round(avg(similarity), 9) AS mean_similarity FROM scores GROUP BY ALL""",
)
def a13(spark, sf_dir):
    return rounded(C.pair_summary(scores(spark, sf_dir)), "mean_numeric_agreement", "mean_token_overlap", "mean_similarity")


@query(
    "a14_micro_overlap",
    f"""WITH {sql.PAIRS} SELECT "left", "right", coalesce(CAST(document AS VARCHAR), 'all') AS document, CAST(sum(left_tokens) AS BIGINT) AS left_tokens, CAST(sum(right_tokens) AS BIGINT) AS right_tokens,
        CAST(sum(shared_tokens) AS BIGINT) AS shared_tokens, round(CASE WHEN sum(left_tokens) + sum(right_tokens) > 0 THEN 2.0::DOUBLE * sum(shared_tokens) / (sum(left_tokens) + sum(right_tokens)) ELSE 0 END, 9) AS token_overlap
        FROM scores GROUP BY GROUPING SETS (("left", "right", document), ("left", "right"))""",
)
def a14(spark, sf_dir):
    made = C.micro(scores(spark, sf_dir)).withColumn("document", F.when(F.col("is_total") == 1, "all").otherwise(F.col("document").cast("string")))
    return rounded(made.drop("is_total"), "token_overlap")


@query("a15_review_queue", f"""WITH {sql.PAIRS} SELECT document, page, round(avg(token_overlap), 9) AS mean_overlap FROM scores GROUP BY ALL""")
def a15(spark, sf_dir):
    return rounded(C.review_queue(scores(spark, sf_dir)), "mean_overlap")


@query(
    "o06_lowest_pages",
    f"""WITH {sql.PAIRS}, q AS (SELECT document, page, round(avg(token_overlap), 9) AS mean_overlap FROM scores GROUP BY ALL)
        SELECT * FROM q ORDER BY mean_overlap, document, page LIMIT 12""",
)
def o06(spark, sf_dir):
    return rounded(C.review_queue(scores(spark, sf_dir)), "mean_overlap").orderBy("mean_overlap", "document", "page").limit(12)


@query(
    "a16_text_volume",
    f"""WITH {sql.TOKENS} SELECT document, method, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(words)) AS BIGINT) AS tokens FROM tok GROUP BY ALL""",
)
def a16(spark, sf_dir):
    return C.volumes(fixtures.pages(spark, sf_dir))


@query(
    "u01_u02_multiset_difference",
    f"""WITH {sql.TOKENS} SELECT document, page, t AS token, n AS missed FROM (
        SELECT a.document, a.page, a.t, a.n - coalesce(b.n, 0) AS n FROM (SELECT * FROM uni WHERE method = 'alpha') a
        LEFT JOIN (SELECT * FROM uni WHERE method = 'beta') b USING (document, page, t)) WHERE n > 0""",
)
def u02(spark, sf_dir):
    made = C.signatures(fixtures.pages(spark, sf_dir).where("method in ('alpha', 'beta')"))
    both = C.pairs(made.select("document", "page", "method", "unigrams"))
    lost = C.beyond(F.col("l.unigrams"), F.col("r.unigrams"))
    return both.select("document", "page", F.explode(lost).alias("token")).groupBy("document", "page", "token").agg(F.count(F.lit(1)).alias("missed"))


@query(
    "u01_multiset_intersection",
    f"""WITH {sql.CORPUS}, w AS (SELECT method, page, len(string_split(text, ' ')) AS n FROM corpus WHERE method IN ('alpha', 'beta'))
        SELECT page, n, count(*) AS times FROM (SELECT page, n FROM w WHERE method = 'alpha' INTERSECT ALL SELECT page, n FROM w WHERE method = 'beta') GROUP BY ALL""",
)
def u01(spark, sf_dir):
    w = fixtures.pages(spark, sf_dir).select("method", "page", F.size(F.split("text", " ")).alias("n"))
    one, two = (w.where(F.col("method") == m).select("page", "n") for m in ("alpha", "beta"))
    return one.intersectAll(two).groupBy("page", "n").agg(F.count(F.lit(1)).alias("times"))


@query(
    "u03_peer_vocabulary",
    f"""WITH {sql.TOKENS}, v AS (SELECT DISTINCT document, page, method, t FROM uni), n AS (SELECT document, page, t, count(*) AS methods FROM v GROUP BY ALL)
        SELECT v.document, v.page, v.method, count(*) AS own, count(*) FILTER (methods > 1) AS corroborated FROM v JOIN n USING (document, page, t) GROUP BY ALL""",
)
def u03(spark, sf_dir):
    words = fixtures.pages(spark, sf_dir).select("document", "page", "method", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    # One shuffle: the count over the token's window rides on the exchange that the page's tokens need anyway.
    counted = words.withColumn("methods", F.count(F.lit(1)).over(Window.partitionBy("document", "page", "t")))
    return counted.groupBy("document", "page", "method").agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("methods") > 1).alias("corroborated"))


@query(
    "u05_set_equality",
    """SELECT a.conv_id AS document, len(a.r) AS turns, list_sort(a.r) = list_sort(['user', 'assistant']) AS same, list_has_all(['user', 'assistant', 'system'], a.r) AS within
       FROM (SELECT conv_id, list(DISTINCT role) AS r FROM conversations GROUP BY conv_id) a""",
)
def u05(spark, sf_dir):
    roles = fixtures.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document")).agg(F.collect_set("role").alias("r"))
    wanted, allowed = F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    return roles.select("document", F.size("r").alias("turns"), (F.array_sort("r") == F.array_sort(wanted)).alias("same"), (F.size(F.array_except("r", allowed)) == 0).alias("within"))


@query(
    "u06_ordered_union",
    f"""WITH {sql.CORPUS}, m AS (SELECT 1 AS ord, * FROM corpus WHERE method = 'alpha' UNION ALL SELECT 2, * FROM corpus WHERE method = 'gamma')
        SELECT ord, document, page, method, length(text) AS characters FROM m""",
)
def u06(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    parts = [pages.where(F.col("method") == m).withColumn("ord", F.lit(i)) for i, m in enumerate(("alpha", "gamma"), 1)]
    return parts[0].unionByName(parts[1]).select("ord", "document", "page", "method", F.length("text").alias("characters"))


@query(
    "p01_corpus_shape",
    f"""WITH {sql.CORPUS}, per AS (SELECT document, method, count(*) AS pages FROM corpus GROUP BY ALL)
        SELECT document, count(*) AS methods, min(pages) AS least, max(pages) AS most, count(*) >= 3 AND min(pages) = max(pages) AS sound FROM per GROUP BY document""",
)
def p01(spark, sf_dir):
    per = fixtures.pages(spark, sf_dir).groupBy("document", "method").agg(F.count(F.lit(1)).alias("pages"))
    made = per.groupBy("document").agg(F.count(F.lit(1)).alias("methods"), F.min("pages").alias("least"), F.max("pages").alias("most"))
    return made.withColumn("sound", (F.col("methods") >= 3) & (F.col("least") == F.col("most")))


@query(
    "p02_page_exclusion",
    f"""WITH {sql.TOKENS} SELECT document, page, CASE WHEN max(len(list_filter(words, lambda w: length(w) > 12))) = 0 THEN 'no scorable tokens' END AS reason FROM tok GROUP BY ALL""",
)
def p02(spark, sf_dir):
    long_words = F.exists(T.tokens(F.col("text")), lambda w: F.length(w) > 12)
    made = fixtures.pages(spark, sf_dir).groupBy("document", "page").agg(F.bool_or(long_words).alias("any"))
    return made.select("document", "page", F.when(~F.col("any"), "no scorable tokens").alias("reason"))
