"""Routing text blocks to schemas, and checking what a model claims to have found there.

Routing looks a block's words up in the catalogue's, so blocks and schemas meet only
where they share one; a shortlist that shared words can't fill is topped up by schema id. Model
calls go through an adapter that is handed in; every claim is checked against the
block's own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.text import routing_words


#: Blocks that are Python values at once.
BLOCKS = 64


def shortlist(blocks: DataFrame, schemas: DataFrame, k: int = 5) -> DataFrame:
    """(block_id, schema_id, shared, place): the k schemas with most words in common, ties by id.

    ``schemas`` (schema_id, text) is a catalogue: its words are read on the driver,
    like a vocabulary, and travel in the closure. A block's words meet in one row
    and are counted there; counted by a grouping, each task would hold a table of
    its blocks times the schemas. Schemas without a word in common fill up by id.
    """
    words_of = routing_words(F.col("text"))
    listed = schemas.where("schema_id is not null").select("schema_id", F.coalesce(words_of, F.array().cast("array<string>")).alias("words")).collect()
    ids = sorted({r["schema_id"] for r in listed})
    number, of_word = {x: n for n, x in enumerate(ids)}, {}
    for r in listed:
        for w in r["words"]:
            of_word.setdefault(w, []).append(number[r["schema_id"]])
    of_word = {w: np.array(n, dtype=np.int64) for w, n in of_word.items()}
    types = {f.name: f.dataType for f in (*blocks.schema.fields, *schemas.schema.fields)}
    schema = StructType([StructField("block_id", types["block_id"]), StructField("schema_id", types["schema_id"]), StructField("shared", LongType()), StructField("place", IntegerType())])
    shape = to_arrow_schema(schema)

    def best(words: list[str]) -> list[tuple[int, int]]:
        hits = [of_word[w] for w in words if w in of_word]
        found, counts = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.array([], dtype=np.int64),) * 2
        first = np.lexsort((found, -counts))[:k]
        out = list(zip(found[first].tolist(), counts[first].tolist(), strict=True))
        taken = {n for n, _ in out}
        return out + [(n, 0) for n in range(min(k, len(ids))) if n not in taken][: k - len(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCKS):
                rows = batch.slice(first, BLOCKS).to_pylist()
                made = [(r["block_id"], ids[n], c, place) for r in rows for place, (n, c) in enumerate(best(r["words"]), 1)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), shape, strict=True)], schema=shape)

    one = blocks.groupBy("block_id").agg(F.flatten(F.collect_list(words_of)).alias("words"))
    return one.mapInArrow(run, schema)


def batches_of(fields: DataFrame, size: int = 40) -> DataFrame:
    """Fields of a schema in batches, by their order: adds ``batch``."""
    return fields.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("schema_id").orderBy("ord")) - 1) / size))


def located(text: str, quote: str, value: str, nth: int) -> tuple[int, int] | None:
    """Where ``value`` stands in the nth exact ``quote``; None unless it stands there once."""
    if not quote or not value or quote.count(value) != 1:
        return None
    places = [m.start() for m in re.finditer(re.escape(quote), text)]
    if not 1 <= nth <= len(places):
        return None
    start = places[nth - 1] + quote.index(value)
    return start, start + len(value)


def verify(claims: DataFrame) -> DataFrame:
    """``claims`` (text, start, evidence, value, occurrence, ...) with span_start, span_end in the source, and ``issue`` where the text doesn't bear a claim out."""
    schema = "long"

    @F.pandas_udf(f"struct<a:{schema},b:{schema}>")
    def check(text: pd.Series, quote: pd.Series, value: pd.Series, nth: pd.Series) -> pd.DataFrame:
        found = [located(*row) for row in zip(text, quote, value, nth, strict=True)]
        return pd.DataFrame({"a": pd.array([f[0] if f else None for f in found], "Int64"), "b": pd.array([f[1] if f else None for f in found], "Int64")})

    span = check("text", "evidence", "value", "occurrence")
    made = claims.withColumn("span", span)
    return made.select(*claims.columns, (F.col("start") + F.col("span.a")).alias("span_start"), (F.col("start") + F.col("span.b")).alias("span_end"), F.when(F.col("span.a").isNull(), "not_in_evidence").alias("issue"))


def discover(blocks: DataFrame, routes: DataFrame, fields: DataFrame, adapter: Callable[[str, list[str]], list[dict]], size: int = 40) -> DataFrame:
    """Verified claims for each routed block and batch of fields. ``adapter`` gets a text and field ids, and returns claims (field_id, evidence, value, occurrence)."""
    grouped = batches_of(fields, size).groupBy("schema_id", "batch").agg(F.array_sort(F.collect_list("field_id")).alias("field_ids"))
    asked = blocks.join(routes.select("block_id", "schema_id"), "block_id").join(grouped, "schema_id").select("block_id", "schema_id", "start", "text", "field_ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["block_id", "schema_id", "start", "text", "field_id", "evidence", "value", "occurrence"]
        for batch in batches:
            out = []
            for block, schema, start, text, ids in batch.itertuples(index=False):
                known = set(ids)
                for c in adapter(text, list(ids)):
                    if c["field_id"] not in known:
                        raise ValueError(f"unknown field: {c['field_id']}")
                    out.append((block, schema, start, text, c["field_id"], c["evidence"], c["value"], c.get("occurrence", 1)))
            yield pd.DataFrame(out, columns=names)

    claims = asked.mapInPandas(run, "block_id string, schema_id string, start long, text string, field_id string, evidence string, value string, occurrence int")
    return verify(claims).dropDuplicates(["schema_id", "field_id", "block_id", "span_start", "span_end"]).drop("text")


def catalog_from_graph(nodes: DataFrame) -> DataFrame:
    """(schema_id, schema_name, ord, field_id, field_name) from graph nodes (id, type, name, parent_id): components with their elements; those without are left out."""
    owners = nodes.where("type in ('BusinessComponent', 'MessageComponent')").select(F.col("id").alias("schema_id"), F.col("name").alias("schema_name"))
    parts = nodes.where("type in ('BusinessElement', 'MessageElement')").select(F.col("parent_id").alias("schema_id"), F.col("id").alias("field_id"), F.col("name").alias("field_name"))
    order = Window.partitionBy("schema_id").orderBy("field_id")
    return owners.join(parts, "schema_id").withColumn("ord", F.row_number().over(order))


def repeated_ids(fields: DataFrame) -> DataFrame:
    """Ids that a catalogue has twice."""
    return fields.groupBy("schema_id", "field_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
