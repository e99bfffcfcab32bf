"""Resuming page work: only pages that aren't done, in batches or as a stream of new files.

A page that arrives late changes every peer's mean on it, so pages are handled
whole, by (document, page); there is no watermark to wait for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["document", "page", "method"]


def pending(pages: DataFrame, done: DataFrame) -> DataFrame:
    return pages.join(done.select(*KEY).distinct(), KEY, "left_anti")


def extend(spark: SparkSession, pages: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Append ``work`` of the pages that ``path`` doesn't have; the number of pages done."""
    try:
        todo = pending(pages, spark.read.parquet(path))
    except Exception as e:  # the first run finds nothing there
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = pages
    todo = todo.persist()
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    todo.unpersist()
    return n


def assembled(pages: DataFrame) -> DataFrame:
    """(document, method, text): each method's finished pages as one Markdown text, in order, a rule between pages. A document's pages meet in one row."""
    listed = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("document", "method").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n---\n\n").alias("text"))


def follow(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Work on page files as they arrive; each micro-batch goes through ``extend``, so a batch that is run again adds nothing."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda df, _: extend(spark, df, path, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
