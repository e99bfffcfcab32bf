"""A training corpus from ``documents``: five stages, each on all that the one before has kept.

Every stage's rows are written as Parquet to the shared folder and read again as
the next one's, so a lost executor costs a part of one stage.

No stage fails on odd rows. Null, empty and letterless texts go in the first one,
as do those of an empty table's model; repeated rows count as copies; very long
texts are read whole; extra columns, whatever their names, come through to the
last stage, which returns placements. Ties keep the least id, then the least hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import dart_minhash, decontaminate, language_id, packing, secrets
from quillspan.llm.common import fresh, table, written

#: A text that the best language model codes in more bits than its bytes have is in no known language.
MOST_BITS = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those that fit no language at all."""
    columns = docs.columns
    made = language_id.identify(docs, language_id.train(docs), columns)
    lang, _, bits = made.columns[len(columns) :]
    return made.where((F.col(lang) != "und") & (F.col(bits) <= MOST_BITS)).select(*[F.col(f"`{c}`") for c in columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class."""
    return dart_minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of the benchmark."""
    columns, name = docs.columns, fresh(docs, "items")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), name)
    return found.where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets masked and its length counted anew."""
    columns = docs.columns
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: which span of which document, with its bytes, stands where in which bin."""
    return packing.best_fit_pack(docs, content=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: Language models, signatures and tiles are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document kept: (doc_id, piece, start, length, shard, bin, capacity, offset, content), a bin's pieces being one sequence."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
