"""Family-balanced votes of a fixed panel of methods.

A method is scored by panel members of other families only; members of one family
share one vote. The tables of methods and families are tiny whatever the corpus;
Spark measures them while a query runs, and joins by broadcast what is small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def panel_edges(scores: DataFrame, panel: DataFrame) -> DataFrame:
    """Only pairs that touch the panel: the others change no panel score."""
    one = panel.select(F.col("method").alias("voter"))
    touched = scores.join(one, (F.col("left") == F.col("voter")) | (F.col("right") == F.col("voter")), "left_semi")
    return touched


def ends(scores: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """Every pair from both sides: (keys, method, peer, s)."""
    sides = F.array(F.struct(F.col("left").alias("method"), F.col("right").alias("peer")), F.struct(F.col("right").alias("method"), F.col("left").alias("peer")))
    return scores.select(*keys, F.col(measure).alias("s"), F.inline(sides))


def each_method(rows: DataFrame, methods: DataFrame) -> DataFrame:
    """``rows`` once for each method of ``methods``, whose names go along as one array: they are few, whatever the corpus."""
    names = methods.agg(F.array_sort(F.collect_set("method")))
    return rows.withColumn("method", F.explode(names.scalar()))


def votes(pairs: DataFrame, measure: str, families: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, peer, peer_family, s): a panel member's vote on a method that shares no family with it."""
    own = families.groupBy("method").agg(F.collect_set("family").alias("own"))
    peers = panel.select(F.col("method").alias("peer"), F.col("family").alias("peer_family"))
    voted = ends(pairs, measure, keys).join(peers, "peer").join(own, "method")
    return voted.where(~F.array_contains("own", F.col("peer_family"))).drop("own")


def balanced(voted: DataFrame, keys: list[str], families: DataFrame) -> DataFrame:
    """(keys, method, score): mean within each peer family, then over families, times 100; null for a method without peers."""
    by_family = voted.groupBy(*keys, "method", "peer_family").agg(F.avg("s").alias("s"))
    score = by_family.groupBy(*keys, "method").agg((100 * F.avg("s")).alias("score"))
    if keys:
        return score
    return families.select("method").distinct().join(score, "method", "left")


def document_pairs(scores: DataFrame, measure: str = "similarity") -> DataFrame:
    """(document, left, right, s): pages averaged within a document."""
    return scores.groupBy("document", "left", "right").agg(F.avg(measure).alias("s"))


def corpus_pairs(by_document: DataFrame) -> DataFrame:
    """(left, right, s): documents averaged alike."""
    return by_document.groupBy("left", "right").agg(F.avg("s").alias("s"))


def panel_scores(scores: DataFrame, families: DataFrame, panel: DataFrame, measure: str = "similarity") -> DataFrame:
    pairs = corpus_pairs(document_pairs(panel_edges(scores, panel), measure))
    return balanced(votes(pairs, "s", families, panel, []), [], families)


def document_scores(scores: DataFrame, families: DataFrame, panel: DataFrame, measure: str = "similarity") -> DataFrame:
    pairs = document_pairs(panel_edges(scores, panel), measure)
    return balanced(votes(pairs, "s", families, panel, ["document"]), ["document"], families)


def leave_one_family_out(scores: DataFrame, families: DataFrame, panel: DataFrame, measure: str = "similarity") -> DataFrame:
    """(family, method, score): the panel's scores without the voters of one family at a time."""
    pairs = corpus_pairs(document_pairs(panel_edges(scores, panel), measure))
    voted = votes(pairs, "s", families, panel, [])
    every = panel.select("family").distinct()
    left = voted.join(every, F.col("family") != F.col("peer_family"))
    kept = balanced(left, ["family"], families)
    grid = each_method(every, families)
    return grid.join(kept, ["family", "method"], "left")


def family_sensitivity(scores: DataFrame, family_of: DataFrame, measure: str = "token_overlap") -> DataFrame:
    """(excluded, method, score): scores with all methods as voters, and without one family, candidates and voters alike.

    ``family_of`` gives each method one family; ``excluded`` is null for the full panel.
    """
    pairs = corpus_pairs(document_pairs(scores, measure))
    fam = family_of
    sided = ends(pairs, "s", []).join(fam.withColumnRenamed("family", "own"), "method").join(fam.select(F.col("method").alias("peer"), F.col("family").alias("peer_family")), "peer")
    voted = sided.where("own <> peer_family")
    cases = family_of.select("family").distinct().select(F.col("family").alias("excluded")).union(family_of.sparkSession.createDataFrame([(None,)], "excluded string"))
    left = voted.join(cases, F.col("excluded").isNull() | ((F.col("excluded") != F.col("own")) & (F.col("excluded") != F.col("peer_family"))))
    by_family = left.groupBy("excluded", "method", "peer_family").agg(F.avg("s").alias("s"))
    score = by_family.groupBy("excluded", "method").agg((100 * F.avg("s")).alias("score"))
    grid = fam.join(cases, F.col("excluded").isNull() | (F.col("excluded") != F.col("family"))).select("excluded", "method")
    return grid.alias("g").join(score.alias("s"), F.col("g.excluded").eqNullSafe(F.col("s.excluded")) & (F.col("g.method") == F.col("s.method")), "left").select("g.excluded", "g.method", "score")


def complete_matrix(scores: DataFrame, methods: DataFrame) -> DataFrame:
    """Units whose pairs are missing or repeated: (document, page, pairs, distinct_pairs, expected)."""
    n = methods.select("method").distinct().count()
    seen = scores.groupBy("document", "page").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("left", "right").alias("distinct_pairs"))
    return seen.withColumn("expected", F.lit(n * (n - 1) // 2)).where("pairs <> expected or distinct_pairs <> expected")


def common_pages(pages: DataFrame) -> DataFrame:
    """(document, page) of the pages that every method has completed."""
    return pages.groupBy("document", "page").agg(F.bool_and(F.col("status") == "complete").alias("all_complete")).where("all_complete").drop("all_complete")


def coverage(pages: DataFrame) -> DataFrame:
    """(method, pages, completed, share, complete_documents): how much each method has read."""
    done = F.col("status") == "complete"
    by_document = pages.groupBy("method", "document").agg(F.count(F.lit(1)).alias("pages"), F.count_if(done).alias("completed"), F.bool_and(done).alias("whole"))
    return by_document.groupBy("method").agg(
        F.sum("pages").alias("pages"), F.sum("completed").alias("completed"), (F.sum("completed") / F.sum("pages")).alias("share"), F.count_if("whole").alias("complete_documents")
    )
