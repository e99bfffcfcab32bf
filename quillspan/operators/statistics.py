"""Resampling, timing and routing statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def bootstrap(page_scores: DataFrame, repetitions: int = 2000, seed: int = 20260910) -> DataFrame:
    """(method, share_first, low, high) of (document, page, method, score) by paired page resampling within documents.

    Each repetition draws every document's pages with replacement, the same for
    all methods: draw i of repetition r is a hash of (seed, r, document, i), so a
    lost task draws the same again. Means are over a document's draws, then over
    documents; the first place is shared among ties. Bounds are the 50th and
    1950th of 2000 sorted means, or their like.
    """
    methods = page_scores.groupBy("document", "page").agg(F.array_sort(F.collect_list(F.struct("method", "score"))).alias("scores"))
    numbered = methods.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "scores"))).alias("pages"))
    n = F.size("pages")
    # Every page has the same methods, in the same order.
    names = F.transform(F.get("pages", F.lit(0))["scores"], lambda s: s["method"])
    draws = lambda rep: F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(F.lit(seed), rep, F.col("document"), i), n).cast("int"))
    mean = lambda at, j: F.aggregate(at, F.lit(0.0), lambda a, k: a + F.get(F.get("pages", k)["scores"], j)["score"]) / n
    means = lambda at: F.transform(names, lambda name, j: F.struct(name.alias("method"), mean(at, j).alias("s")))
    # All repetitions of a document are drawn inside its row, so its pages are never copied; its means are all that moves on.
    reps = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(repetitions - 1).cast("long")), lambda rep: F.struct(rep.alias("rep"), let(draws(rep), means).alias("means")))
    by_rep = numbered.select(F.inline(reps)).select("rep", F.inline("means")).groupBy("rep", "method").agg(F.avg("s").alias("s"))
    best = Window.partitionBy("rep")
    shared = by_rep.withColumn("top", F.max("s").over(best)).withColumn("wins", (F.col("s") == F.col("top")).cast("int"))
    shared = shared.withColumn("share", F.col("wins") / F.sum("wins").over(best))
    low, high = int(0.025 * repetitions) - 1, int(0.975 * repetitions) - 1
    ordered = shared.groupBy("method").agg((F.sum("share") / repetitions).alias("share_first"), F.array_sort(F.collect_list("s")).alias("all"))
    return ordered.select("method", "share_first", F.get("all", F.lit(low)).alias("low"), F.get("all", F.lit(high)).alias("high"))


def timings(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    s = F.col(seconds)
    return rows.groupBy(*keys).agg(F.count(s).alias("n"), F.sum(s).alias("total"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.max(s).alias("longest"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """``rows`` (reference, predicted, page_text, document_text) with ``cause``: why a field was missed, the first that holds."""
    ref, page, whole = (F.lower(F.col(c)) for c in ("reference", "page_text", "document_text"))
    tight = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    near = F.levenshtein(F.lower("predicted"), ref) <= 0.25 * F.greatest(F.length("predicted"), F.length("reference"))
    cause = (
        F.when(F.contains(page, ref) & F.col("predicted").isNotNull(), "bound_elsewhere").when(F.contains(page, ref), "not_extracted")
        .when(F.contains(tight(page), tight(ref)), "format").when(F.coalesce(near, F.lit(False)), "near_miss").when(F.contains(whole, ref), "other_page").otherwise("misread")
    )
    return rows.withColumns({"cause": cause, "weak": F.length("reference") <= 3})


def response_class(rows: DataFrame) -> DataFrame:
    """``rows`` (body: a reply as JSON) with ``outcome``; the first flag that holds wins."""
    got = lambda path: F.get_json_object("body", path)
    outcome = (
        F.when(got("$").isNull(), "invalid").when(got("$.refusal").isNotNull(), "refusal").when(got("$.finish_reason") == "length", "truncated")
        .when(got("$.page") != F.col("page").cast("string"), "mismatch").when(got("$.text").isNull(), "incomplete").otherwise("ok")
    )
    return rows.withColumn("outcome", outcome)
