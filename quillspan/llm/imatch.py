"""Operator 2: I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band, so whose
inverse document frequency does. A fingerprint is a row of hashes, one for each
of several random subsets of the lexicon, of very different densities: a hash is
taken over the document's distinct terms in that subset, sorted. Dense subsets
tell apart texts that differ a little, sparse ones still agree on texts that
share most terms.

The lexicon is broadcast. Its size has a bound that doesn't depend on the number
of documents N: a term in it is in N / 1000 documents at least, so there are at
most 1000 times as many as a document has distinct terms on average.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, partitions, per_text, slices

#: Bounds of the document frequency as a share of all documents.
BAND = (1 / 1000, 1 / 10)
#: Subsets that hold one term in 2**d, so many of each d; the first hash is over the whole band.
DENSITIES, REPEATS = (1, 3, 5, 6, 7, 8, 9), 8
#: The first hash of a text that has terms, but none in the band; the second is over all its terms.
OUTSIDE = "f" * 8
NONE = "0" * 8
SIZE = 1 + len(DENSITIES) * REPEATS
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_terms long"


def terms(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@lru_cache(maxsize=400_000)
def subsets(term: str) -> tuple[int, ...]:
    """The numbers of the subsets that a term is in, 0 (the whole band) among them."""
    out, j = [0], 1
    for d in DENSITIES:
        for _ in range(REPEATS):
            if not xxhash.xxh64_intdigest(term, seed=j) & ((1 << d) - 1):
                out.append(j)
            j += 1
    return tuple(out)


def told(row: Iterable[str]) -> str:
    """The hash of sorted terms as eight hex digits, neither all 0 (no terms) nor all f (the marker)."""
    if not row:
        return NONE
    x = hashlib.blake2b(" ".join(sorted(row)).encode("utf-8", "surrogatepass"), digest_size=4).hexdigest()
    return {NONE: "00000001", OUTSIDE: "fffffffe"}.get(x, x)


def fingerprint(text: str, lexicon: frozenset[str]) -> tuple[str, int]:
    """(hex fingerprint, number of terms it stands on).

    All zeros without any term; a marker and a hash of all terms where none is in
    the band, so that such texts are alike if they have the same terms only.
    """
    every = terms(text)
    kept = every & lexicon
    if every and not kept:
        return OUTSIDE + told(every) + NONE * (SIZE - 2), 0
    rows: list[list[str]] = [[] for _ in range(SIZE)]
    for term in sorted(kept):
        for j in subsets(term):
            rows[j].append(term)
    return "".join(map(told, rows)), len(kept)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else the largest share of equal hashes that subsets of one density have.

    Only subsets that either text has terms in count, and densities with half as
    many of those as there are subsets; if none has, all densities count together.
    Subsets sparse enough to hold a term or two agree as often as the two sets of
    terms do, by their Jaccard similarity; denser ones agree less.
    """
    if a == b:
        return 1.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    groups = [pairs[i : i + REPEATS] for i in range(1, SIZE, REPEATS)]
    equal = [[x == y for x, y in g if x != NONE or y != NONE] for g in groups]
    shares = [sum(e) / len(e) for e in equal if 2 * len(e) >= REPEATS]
    every = [x == y for x, y in pairs if x != NONE or y != NONE]
    return round(max(shares, default=sum(every) / len(every)), 6)


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> frozenset[str]:
    """Terms by their document frequency over all rows; twice at least. Counted before the shuffle, by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return made

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    seen.update(terms(t or ""))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    n = docs.count()
    least, most = max(2, math.ceil(band[0] * n)), max(2, math.floor(band[1] * n))
    df = docs.select(text).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return frozenset(df.where(F.col("n").between(least, most)).select("term").toPandas()["term"])


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, z, look) dealt into blocks of neighbouring ids, one block a partition, each sorted; z is the text, compressed for the way.

    The rows with look = 1 stand after a block's own rows and start with the row
    that follows them: the next block's first, or the first of all.
    """
    n = max(2, partitions(docs))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    got = slim.select(order.alias("o")).agg(F.min("o"), F.percentile_approx("o", [i / n for i in range(1, n)], 100 * n)).first()
    first, cuts = got[0], np.array(sorted(set(got[1] or ()) - {got[0]}), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, 1):
                o = part.column(2).to_numpy(zero_copy_only=False)
                block = np.searchsorted(cuts, o, side="right").astype(np.int32)
                rows = np.arange(len(o))
                ahead = rows[np.isin(o, cuts)]
                wrap = rows[o == first]
                index = np.concatenate([rows, ahead, wrap])
                into = np.concatenate([block, block[ahead] - 1, np.full(len(wrap), len(cuts), np.int32)]).astype(np.int32)
                look = np.repeat(np.array([0, 1, 1], np.int32), [len(rows), len(ahead), len(wrap)])
                z = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()], pa.binary())
                both = [x.take(pa.array(index)) for x in (part.column(0), z, part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([*both, pa.array(into, pa.int32()), pa.array(look, pa.int32())], names=["doc_id", "z", "o", "tie", "block", "look"])

    keyed = slim.withColumns({"o": order, "tie": F.xxhash64("text")})
    dealt = keyed.mapInArrow(deal, "doc_id long, z binary, o long, tie long, block int, look int")
    return dealt.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("look", "o", "tie").select("doc_id", "z", "look")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, n_terms) for every row; null texts count as empty, whose fingerprint is all zeros. Row-local after the lexicon."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, band))

    def run(texts):
        got = [fingerprint(t or "", sent.value) for t in texts]
        return [[x[0] for x in got], [x[1] for x in got]]

    return per_text(docs, text, [id_col], "fingerprint string, n_terms long", run)


def compare_edited(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Each text against itself with its last quarter replaced from the next document, and against that document.

    Texts move once, to stand in order of doc_id (null ids first; rows of one id
    by a hash of the text; equal rows in any order, since their results are equal
    but for the last one's next text). Null texts count as empty; a single document
    is its own next one; very long texts are read whole, one at a time. An empty
    table gives no rows; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs.select("text"), "text", band))
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        held, out, done = None, [], False

        def row(this, nxt):
            (doc_id, text, (mine, n)), (_, other, (theirs, _)) = this, nxt
            k = len(text) // 4
            edited = text[: len(text) - k] + other[:k]
            changed, _ = fingerprint(edited, words)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(text), digest, mine, changed, likeness(mine, changed), likeness(mine, theirs), n

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for doc_id, z, look in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if done:
                        break
                    text = zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")
                    now = (doc_id, text, fingerprint(text, words))
                    if held is not None:
                        out.append(row(held, now))
                    held, done = now, look == 1
                if out:
                    yield flush()

    return in_order(docs).mapInArrow(run, SCHEMA)
