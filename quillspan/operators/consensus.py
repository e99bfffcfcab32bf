"""Pairwise agreement of methods, page by page, and what is summed up from it.

Multisets are arrays of items in which repetitions carry their number, built per
page in its row; two of them share as much as their arrays, which a hash set
tells in one pass. The methods of one (document, page) meet in one row by one
shuffle of each page, and pairs are scored inside that row: nothing is copied for
each pair, nothing is exploded across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dice, numbers, tokens

UNIT = ["document", "page"]


def numbered(items: Column) -> Column:
    """The multiset of an array of strings as a set: sorted, each repetition with its number behind it.

    Sorted items form runs; an item's number is its distance from where its run
    starts. The separator is in no token.
    """

    def body(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(xs)))
        nth = lambda s: F.flatten(F.zip_with(s, ends(s), lambda a, b: F.sequence(F.lit(0), b - a - 1)))
        tagged = lambda n: F.zip_with(xs, n, lambda x, k: F.when(k == 0, x).otherwise(F.concat(x, F.lit("\x1e"), k.cast("string"))))
        return F.get(F.transform(F.transform(F.array(starts), nth), tagged), F.lit(0))

    full = F.filter(F.array(F.array_sort(items)), lambda xs: F.size(xs) > 0)
    return F.coalesce(F.get(F.transform(full, body), F.lit(0)), F.array().cast("array<string>"))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    return F.size(F.array_intersect(a, b))


def beyond(a: Column, b: Column) -> Column:
    """The multiset a without b, as an array of items."""
    return F.transform(F.array_except(a, b), lambda x: F.substring_index(x, "\x1e", 1))


def bigrams(words: Column) -> Column:
    """Neighbouring words as one string each; the separator is in no token."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit("\x1f"), b))


def signatures(pages: DataFrame) -> DataFrame:
    """``pages`` with words, and the multisets of words, of ordered pairs of words, and of numbers."""
    worded = pages.withColumn("words", tokens(F.col("text")))
    return worded.withColumns({
        "unigrams": numbered(F.col("words")), "bigrams": numbered(bigrams(F.col("words"))), "numbers": numbered(numbers(F.col("text"))),
        "n_words": F.size("words"), "n_bigrams": F.greatest(F.size("words") - 1, F.lit(0)),
    })


def pairs(units: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """All pairs of methods of a unit, once each, ``left`` before ``right`` by name; columns as structs l and r."""
    rest = [c for c in units.columns if c not in keys]
    left, right = (units.select(*keys, F.struct(*rest).alias(x)) for x in "lr")
    return left.join(right, keys).where(F.col("l.method") < F.col("r.method"))


def pair_scores(pages: DataFrame) -> DataFrame:
    """One row for each pair of methods of a page, with every set-based measure."""
    columns = ("method", "n_words", "n_bigrams", "unigrams", "bigrams", "numbers")
    rows = signatures(pages).groupBy(*UNIT).agg(F.collect_list(F.struct(*columns)).alias("m"))

    def scored(x: Column, y: Column) -> Column:
        return F.struct(
            x["method"].alias("left"), y["method"].alias("right"), x["n_words"].alias("left_tokens"), y["n_words"].alias("right_tokens"),
            shared(x["unigrams"], y["unigrams"]).alias("shared_tokens"), (x["n_bigrams"] + y["n_bigrams"]).alias("total_bigrams"),
            shared(x["bigrams"], y["bigrams"]).alias("shared_bigrams"), (F.size(x["numbers"]) + F.size(y["numbers"])).alias("total_numbers"),
            shared(x["numbers"], y["numbers"]).alias("shared_numbers"),
        )

    met = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: x["method"] < y["method"]), lambda y: scored(x, y))))
    made = rows.select(*UNIT, F.inline(met))
    overlap = dice(F.col("shared_tokens"), F.col("left_tokens"), F.col("right_tokens"))
    pairs_of_words = dice(F.col("shared_bigrams"), F.col("total_bigrams"), F.lit(0), empty=overlap)
    numeric = dice(F.col("shared_numbers"), F.col("total_numbers"), F.lit(0), empty=F.lit(None).cast("double"))
    return made.withColumns({"token_overlap": overlap, "bigram_overlap": pairs_of_words, "similarity": (overlap + pairs_of_words) / 2, "numeric_agreement": numeric})


def scorable(pages: DataFrame) -> DataFrame:
    """(document, page, scorable): whether any method has a token there."""
    return pages.groupBy(*UNIT).agg(F.bool_or(F.size(tokens(F.col("text"))) > 0).alias("scorable"))


def page_scores(scores: DataFrame, measure: str = "token_overlap") -> DataFrame:
    """(document, page, method, score): a method's mean over its peers. Both ends of a pair in one pass, no second scan."""
    ends = F.explode(F.array("left", "right")).alias("method")
    return scores.select(*UNIT, ends, F.col(measure).alias("s")).groupBy(*UNIT, "method").agg(F.avg("s").alias("score"))


def consensus(scores: DataFrame, measure: str = "token_overlap", weighting: str = "document") -> DataFrame:
    """(method, score): mean over peers, then pages, then documents; or over all pages alike."""
    by_page = page_scores(scores, measure)
    if weighting == "page":
        return by_page.groupBy("method").agg(F.avg("score").alias("score"))
    return by_page.groupBy("document", "method").agg(F.avg("score").alias("s")).groupBy("method").agg(F.avg("s").alias("score"))


def tolerant_rank(rows: DataFrame, score: str, name: str, tolerance: float, partition: list[str] | None = None) -> DataFrame:
    """Competition rank: a new rank starts where the score differs from the row before by more than ``tolerance``; null scores last.

    Without ``partition`` the window spans all rows, which are the methods compared: a handful.
    """
    order = Window.partitionBy(*(partition or [])).orderBy(F.col(score).desc_nulls_last(), F.col(name).asc())
    before = F.lag(score).over(order)
    starts = before.isNull() | (F.abs(F.col(score) - before) > tolerance) | F.col(score).isNull()
    numbered = rows.withColumn("starts_at", F.when(starts, F.row_number().over(order)))
    return numbered.withColumn("rank", F.max("starts_at").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts_at")


def pair_summary(scores: DataFrame) -> DataFrame:
    """One row for each pair of methods: means over its pages, undefined values left out."""
    return scores.groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("pages"), F.count("numeric_agreement").alias("pages_with_numbers"), F.avg("numeric_agreement").alias("mean_numeric_agreement"),
        F.avg("token_overlap").alias("mean_token_overlap"), F.avg("similarity").alias("mean_similarity"),
    )


def micro(scores: DataFrame) -> DataFrame:
    """Overlap of summed counts for each document and for all; ``document`` is null in the latter."""
    sums = [F.sum(c).alias(c) for c in ("left_tokens", "right_tokens", "shared_tokens")]
    grouped = scores.groupingSets([["left", "right", "document"], ["left", "right"]], "left", "right", "document").agg(*sums, F.grouping("document").alias("is_total"))
    return grouped.withColumn("token_overlap", dice(F.col("shared_tokens"), F.col("left_tokens"), F.col("right_tokens")))


def review_queue(scores: DataFrame) -> DataFrame:
    """(document, page, mean_overlap): pages by how far their methods agree."""
    return scores.groupBy(*UNIT).agg(F.avg("token_overlap").alias("mean_overlap"))


def volumes(pages: DataFrame) -> DataFrame:
    words = F.size(tokens(F.col("text")))
    return pages.groupBy("document", "method").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("characters"), F.sum(words).alias("tokens"))
