"""Shared helpers of the training-data operators.

Every operator takes and returns DataFrames, names its internal columns so that
they cannot clash with extra columns of the input, and cuts lineage only by
tables written below the shared folder named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is a single process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspan-")
    return f"{root.rstrip('/')}/quillspan-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors then cost no recomputation."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def per_text(
    df: DataFrame, text: str, keep: list[str], schema: str, fn: Callable[[list[str | None]], list]
) -> DataFrame:
    """Apply ``fn`` (texts -> one pyarrow array per field of ``schema``) beside the columns ``keep``.

    Row-local: no shuffle, and a lost executor costs only its own splits. Rows go
    to ``fn`` in slices of bounded bytes, so a batch of very long texts stays small.
    An added column whose name is taken gets underscores; it stays in its place.
    A text that is kept goes to Python once.
    """
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL(schema)
    at = keep.index(text) if text in keep else len(keep)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate([*keep, text] if at == len(keep) else keep)])
    out = StructType([*source.schema.fields[: len(keep)], *(StructField(f"a{i}", f.dataType) for i, f in enumerate(added.fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(fn(texts), list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns[: len(keep)], arrow, strict=False)), *made], schema=arrow)

    done = source.mapInArrow(run, out)
    taken, names = {c.lower() for c in keep}, []
    for f in added.fields:
        name = f.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return done.toDF(*keep, *names)


def arrow_schema(ddl: str) -> pa.Schema:
    """For the driver: a worker has no session to read DDL with."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` cut where the bytes of ``column`` pass ``limit``; one longer row stands alone."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, hot: int = 256) -> DataFrame:
    """Left join on ``key``, which ``right`` has once each, with ``weight`` the number of rows that ``left`` has of it.

    Keys of more than one in ``hot`` rows go by a broadcast join: there are fewer
    than ``hot`` of those, whatever the data. The rest meet in a shuffled join,
    where the rows already served stand apart, dealt out by ``spread``.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    most = max(1, total // hot)
    values = [c for c in right.columns if c != key]
    few = right.where(F.col(weight) > most).select(F.col(key).alias("hot_key"), F.struct(*values).alias("hot_values"))
    text = F.hex(key) if right.schema[key].dataType.typeName() == "binary" else F.col(key).cast("string")
    rest = right.where(F.col(weight) <= most).select(text.alias("match"), F.struct(*values).alias("values"))
    first = left.join(F.broadcast(few), F.col(key) == F.col("hot_key"), "left")
    first = first.withColumn("match", F.when(F.col("hot_key").isNull() & F.col(key).isNotNull(), text).otherwise(F.concat(F.lit("-"), F.xxhash64(spread).cast("string"))))
    both = first.join(rest, "match", "left").withColumn("all_values", F.coalesce("hot_values", "values"))
    return both.select(*[F.col(f"`{c}`") for c in left.columns], "all_values.*")


class WordHashes(dict):
    """word -> 64-bit hash, kept for repeated words and emptied before it grows large."""

    _shared: WordHashes | None = None

    @classmethod
    def shared(cls) -> WordHashes:
        """The worker's own; it lasts over its tasks."""
        cls._shared = cls() if cls._shared is None else cls._shared
        return cls._shared

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in WORD.findall((text or "").lower())], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every ``n`` consecutive word hashes; fewer words than ``n`` make one shorter shingle, none make none."""
    if not len(hashes):
        return hashes
    n, base = min(n, len(hashes)), np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * base + hashes[i : len(hashes) - n + 1 + i]
    return mix(out + np.uint64(n))
