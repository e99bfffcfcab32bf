"""Operator 8: near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles, each weighing as often
as it occurs. DartMinHash throws darts at the plane weight x rank of every
element, at random but the same for all documents, by hashing; a dart that falls
below an element's weight belongs to the document, and each of k coordinates
keeps its dart of least rank. Two signatures agree in a coordinate with the
probability of the weighted Jaccard similarity. About k ln k darts fill all
coordinates, so the ranks searched shrink as the document's weight grows.

Signatures join by bands; equal word sequences are one text throughout. Then
links are made in two steps, each verified exactly by weighted Jaccard:

1. In each bucket every text is compared with a central one, so a family of
   copies costs one comparison for each.
2. Texts whose bucket holds several classes still are joined by a prefix filter
   with positions: a text's shingles stand by rarity, those that no other of
   these texts has first, and a pair that is similar enough has its first common
   shingle so early in both that enough are left behind it. That is exact: it
   rules no link out. Texts that differ from all others in over a ninth of
   their shingles, as most in a large family do, have no entry left and cost
   nothing; nothing is compared block by block.

Classes are connected components, found by alternating large and small stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fresh, grams, hot_join, mix, per_text, slices, written

SHINGLE, LIKE = 5, 0.8
BANDS, ROWS = 30, 5
CELL = np.uint64(0x9E3779B97F4A7C15)
DART = np.uint64(0xD1B54A32D192ED03)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class DartMinHash:
    def __init__(self, k: int, seed: int = 1):
        self.k, self.seed = k, np.uint64(seed)
        self.darts = k * (math.log(k) + 3)

    def cells(self, upto: float) -> list[tuple[float, float]]:
        """(start, length) of the cells of the rank axis: doubling up to 1, of length 1 from there."""
        out, at, length = [], 0.0, 2.0**-6
        while at < upto:
            out.append((at, length))
            at += length
            length = min(1.0, at)
        return out

    def signature(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The k darts (as 64-bit numbers) of a set without repetitions; of no elements, none."""
        if weights is None:
            strips, share, weight = elements, None, float(len(elements))
        else:
            elements, weights = elements[weights > 0], weights[weights > 0]
            layers = np.ceil(weights).astype(int)
            at = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
            strips = np.where(at == 0, np.repeat(elements, layers), mix(np.repeat(elements, layers) + at.astype(np.uint64) * DART))
            share, weight = np.minimum(1.0, np.repeat(weights, layers) - at), float(weights.sum())
            share = None if (share == 1.0).all() else share
        if not len(strips):
            return np.zeros(0, np.uint64)
        out, filled, done = np.zeros(self.k, np.uint64), np.zeros(self.k, bool), 0
        upto = self.darts / weight
        while not filled.all():
            todo = self.cells(upto)
            step = max(1, (1 << 19) // len(strips))
            while done < len(todo) and not filled.all():
                self.throw(strips, share, todo[done : done + step], done, out, filled)
                done += len(todo[done : done + step])
            upto = max(2 * upto, upto + 2.0**-6)
        return out

    def throw(self, strips, share, cells, first, out, filled) -> None:
        """The darts of some cells, all of a rank above those before: they fill coordinates that are still empty."""
        start, length = np.array(cells).T
        number = mix((np.arange(first, first + len(cells)).astype(np.uint64) + np.uint64(1)) * CELL + self.seed)
        area = mix(strips[:, None] + number[None, :])
        u = unit(area)
        at, cell = np.nonzero(u > np.exp(-length)[None, :])
        if not len(at):
            return
        u, lam = u[at, cell], length[cell]
        count, term, total = np.zeros(len(at), int), np.exp(-lam), np.exp(-lam)
        for j in range(1, 20):  # the Poisson number of darts, by inversion
            more = u > total
            if not more.any():
                break
            count += more
            term = term * lam / j
            total = total + term
        owner = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(area[at[owner], cell[owner]] + (nth.astype(np.uint64) + np.uint64(1)) * DART)
        rank = start[cell[owner]] + lam[owner] * unit(mix(dart + np.uint64(1)))
        where = (mix(dart + np.uint64(2)) % np.uint64(self.k)).astype(int)
        keep = ~filled[where]
        if share is not None:
            keep &= unit(mix(dart + np.uint64(3))) < share[at[owner]]
        dart, rank, where = dart[keep], rank[keep], where[keep]
        order = np.argsort(rank, kind="stable")[::-1]
        out[where[order]] = dart[order]  # the least rank is written last
        filled[where] = True


def bands(signature: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each band."""
    if not len(signature):
        return np.zeros(0, np.int64)
    key, parts = np.arange(1, n + 1).astype(np.uint64), signature[: n * rows].reshape(n, rows)
    for i in range(rows):
        key = mix(key * CELL + parts[:, i])
    return key.view(np.int64)


def weighted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a sequence of word hashes, and how often each occurs."""
    return np.unique(grams(words, SHINGLE), return_counts=True)


def layered(words: np.ndarray) -> np.ndarray:
    """A hash for each occurrence of each shingle, numbered within the shingle: the Jaccard similarity of these sets is the weighted one."""
    elements, counts = weighted(words)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(mix(np.repeat(elements, counts) + nth.astype(np.uint64) * CELL))


def node(id_col: str, text: str) -> Column:
    """The number of a document: its id, or for a null id a negative number made from its text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), -F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(1 << 62)) - 1)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, text_hash, row, copy, n, bands): copy is a 128-bit hash of the words, or of the text if it has none."""

    def run(texts):
        hashes, darts = WordHashes.shared(), DartMinHash(BANDS * ROWS)
        copies, sizes, keys = [], [], []
        for t in texts:
            words = hashes.of(t)
            copies.append(xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"\0" + (t or "").encode("utf-8", "surrogatepass")))
            elements, counts = weighted(words)
            sizes.append(int(counts.sum()))
            keys.append(bands(darts.signature(elements, counts.astype(float))))
        return [copies, sizes, keys]

    return per_text(docs, "text", ["doc_id", "node", "text_hash", "row"], "copy binary, n long, bands array<long>", run)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the texts ``wanted`` (key, node, text_hash), written once for all that compares them.

    What is wanted grows with the documents, so the two meet by a merge at every
    size. Rows that repeat an id and a text then stand together, and the first of
    them is taken; a split of a hot key may give a text twice, which does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes.shared(), None
        for batch in batches:
            for part in slices(batch, 1):
                keys = part.column(0).to_pylist()
                new = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
                last = keys[-1]
                sets = [layered(hashes.of(part.column(1)[i].as_py())).view(np.int64) for i in new]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    met = docs.join(wanted.hint("merge"), ["node", "text_hash"]).select("key", "text")
    return written(met.mapInArrow(run, "key long, shingles array<long>"))


def verified(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """Of the distinct pairs (a, b) of keys those whose texts' shingles have a weighted Jaccard similarity of ``like`` or more."""
    left, right = (sets.select(F.col("key").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both, sizes = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return written(pairs.join(left, "a").join(right, "b").where(both * (1 + like) >= like * sizes - 1e-9).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (a, b); the label is the least node of its component.

    Large and small stars in turn, each round's edges written to the shared
    folder, until a round changes nothing. The number of rounds grows with the
    logarithm of the longest chain. A hub's edges are not brought to one task: the
    least neighbour of the few largest hubs is broadcast.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("a", "m")))
        near = hot_join(both, least, "a", "degree", F.col("b"))
        if large:
            return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while before[0]:
        # Both kinds of star leave edges (a, b) with a > b.
        now = written(star(star(now, True), False))
        if (after := state(now)) == before:
            break
        before = after
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_links(texts: DataFrame, docs: DataFrame, like: float) -> DataFrame:
    """Links (a, b) between the keys of different texts; ``texts`` has (key, node, text_hash, n, bands), ``docs`` (node, text_hash, text).

    The centre of a bucket is its text with the most company in all buckets, which
    in a family of copies is the one nearest to all others.
    """
    keyed = texts.select("key", "n", F.explode("bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    near = written(keyed.join(sizes, "band"))
    company = near.groupBy("key").agg(F.sum("size").alias("company"))
    centres = near.join(company, "key").groupBy("band").agg(F.max_by(F.struct("key", "n"), F.struct("company", -F.col("key"))).alias("centre"))
    first = near.join(centres, "band").where((F.col("key") != F.col("centre.key")) & fits(F.col("n"), F.col("centre.n"), like))
    first = written(first.select(F.col("key").alias("a"), F.col("centre.key").alias("b")).distinct())
    sets = shingle_sets(docs, texts.select("key", "node", "text_hash").join(near.select("key").distinct(), "key", "left_semi"))
    links = verified(first, sets, like)
    second = open_pairs(near, written(components(links).withColumnRenamed("node", "key")), sets, like)
    known = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = written(second.join(known, ["a", "b"], "left_anti"))
    return links.union(verified(second, sets, like)).distinct()


def fits(x: Column, y: Column, like: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= F.lit(like) * F.greatest(x, y) - 1e-9


def open_pairs(near: DataFrame, labels: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """Pairs (a, b), a > b, of texts that aren't in one class by ``labels``, if they can be similar enough; all texts of buckets with several classes meet.

    Sets of n and m shingles that are similar enough share like / (1 + like) *
    (n + m) at least. Let all shingles stand in one order, rare ones first. If the
    first that two sets share has p others before it in the one and q in the other,
    they share n - p and m - q at most. So only the first n - like * n + 1 of each
    set can be a pair's first one, and only where p and q leave enough.
    """
    members = near.where("size > 2").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
    members = written(members.join(several, "band", "left_semi").select("key", "n", "label").distinct())
    each = sets.join(members.select("key"), "key", "left_semi").select("key", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    ranked = each.join(shared, "shingle").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("texts", "shingle"))).alias("shared")).join(members, "key")
    alone = F.col("n") - F.size("shared")
    reach = (F.floor(F.col("n") * (1 - like) + 1e-9) + 1 - alone).cast("int")
    entries = ranked.where(reach > 0).select("key", "n", "label", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), reach)).alias("at", "s"))
    entries = written(entries.select("key", "n", "label", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("at")).alias("behind")))
    # An entry whose rest is too short for the least of the other sets meets none of them.
    lists = entries.groupBy("shingle").agg(F.min("n").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("shingle", "least")
    enough = lambda behind, sizes: behind * (1 + like) >= F.lit(like) * sizes - 1e-6
    left = written(entries.join(lists, "shingle").where(enough(F.col("behind"), F.col("n") + F.col("least"))).drop("least"))
    x, y = left.alias("x"), left.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.key") > F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
    rest, sizes = F.least("x.behind", "y.behind"), F.col("x.n") + F.col("y.n")
    return x.join(y, apart & fits(F.col("x.n"), F.col("y.n"), like) & enough(rest, sizes)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def row_hash(docs: DataFrame) -> Column:
    """Of all columns that can be hashed, so all but maps."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def labelled(docs: DataFrame, id_col: str, text: str, like: float) -> DataFrame:
    """(doc_id, node, text_hash, row, class_id, copies, links, best) for every row; best is the (node, text_hash) of the row that stands for its class."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = row_hash(docs)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), node(id_col, text).alias("node"), F.xxhash64(content).alias("text_hash"), row.alias("row"), F.col(f"`{text}`").alias("text"))
    mine = written(signed(slim))
    copies = mine.groupBy("copy").agg(F.min(F.struct("node", "text_hash")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    copies = written(copies.select(F.monotonically_increasing_id().alias("key"), "copy", "of", "of.node", "of.text_hash", "n", "bands", "copies"))
    found = near_links(copies, slim.select("node", "text_hash", "text"), like)
    labels = written(components(found))
    ends = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    own = F.coalesce("label", "key")
    named = written(copies.join(labels.withColumnRenamed("node", "key"), "key", "left").join(ends, "key", "left").select("copy", "copies", own.alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "of"))
    least = named.groupBy("label").agg(F.min("of").alias("best"))
    classes = written(named.join(least, "label").select("copy", "copies", "links", "best"))
    return hot_join(mine.select("doc_id", "node", "text_hash", "row", "copy"), classes, "copy", "copies", F.col("row")).withColumn("class_id", F.col("best.node")).drop("copy")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", like: float = LIKE) -> DataFrame:
    """(doc_id, class_id, copies, links) for every row.

    class_id is the least id of the documents linked to it, directly or not;
    copies counts the rows with its very words, links the verified links of its
    words to other texts that the class rests on (two texts of one class need not
    have a link of their own). Documents are linked if they have the same words in
    the same order (texts without words: if they are equal), or if their weighted
    five-word shingles are similar enough. A text of fewer than five words is one
    shingle. Null texts count as empty. Rows that share an id but not a text are
    documents of their own; rows without an id are numbered from their texts.
    Repeated rows are copies. Ties for a bucket's centre go to the text numbered
    first. Very long texts are read whole; their sets stand alone in a batch. An
    empty table gives no rows; extra columns are ignored.
    """
    return labelled(docs, id_col, text, like).select("doc_id", "class_id", "copies", "links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of least id of each class, once, with all its columns.

    Of rows with one id and one text the one of least row hash stays; only of rows
    equal in all columns are texts aggregated. Nulls, empty and very long texts,
    empty tables and clashing columns are as in near_classes.
    """
    columns = docs.columns
    a, b, c = (fresh(docs, x) for x in ("node", "text_hash", "row"))
    mine = labelled(docs, id_col, text, LIKE).where((F.col("node") == F.col("best.node")) & (F.col("text_hash") == F.col("best.text_hash")))
    each = mine.groupBy("node", "text_hash", "row").agg(F.count(F.lit(1)).alias("n"))
    chosen = written(each.groupBy("node", "text_hash").agg(F.min(F.struct("row", "n")).alias("r")).select(F.col("node").alias(a), F.col("text_hash").alias(b), F.col("r.row").alias(c), "r.n"))
    named = {a: node(id_col, text), b: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), c: row_hash(docs)}
    numbered = docs.withColumns(named)
    kept = numbered.join(chosen.where("n = 1").hint("merge"), [a, b, c], "left_semi")
    again = chosen.where("n > 1")
    if not again.isEmpty():
        kept = kept.union(numbered.join(again, [a, b, c], "left_semi").dropDuplicates([a, b, c]))
    return kept.select(*[F.col(f"`{x}`") for x in columns])
