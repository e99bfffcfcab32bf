"""Operator 10: benchmark decontamination by greedy string tiling.

Documents and benchmark items become word sequences. A rolling Karp-Rabin hash
of every five words seeds the comparison: an item is compared with a document
only if they share a seed. For such a pair the longest common run of words that
is still unmarked on both sides is marked as a tile, again and again, down to
runs of five words; tiles never overlap, and their order doesn't matter, so
reordered passages count in full. An item of fewer than five words is its own
seed and tile: it is found where it stands whole. An item whose tiles cover the threshold's
share of its words is found in the document.

The benchmark is sent to the executors in blocks of bounded size: one block is
the usual case, more blocks mean more passes over the documents, so a larger
benchmark never needs more memory. Row-local, no shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, grams, per_text

WORDS, COVER = 5, 0.8
#: The bound of what is broadcast at once, in bytes of item texts; a longer item makes a block alone.
BLOCK_BYTES = 8 << 20
MATCH = "array<struct<item_id:long,n_words:int,n_covered:int,n_tiles:int,coverage:double>>"


def tiles(item: np.ndarray, doc: np.ndarray, hits: list[tuple[int, int]], least: int = WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, words), longest first, then leftmost in the item and the document.

    ``hits`` are the starts of equal runs of ``least`` words; hits one after
    another on a diagonal are one maximal match. A match that earlier tiles have
    cut goes back with what is left of it.
    """
    runs: list[tuple[int, int, int]] = []
    for d, i in sorted((j - i, i) for i, j in hits):
        if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] - least + 1 == i:
            runs[-1] = (d, runs[-1][1], runs[-1][2] + 1)
        else:
            runs.append((d, i, least))
    heap = [(-n, i, i + d) for d, i, n in runs]
    heapq.heapify(heap)
    mine, theirs, out, left = np.zeros(len(item), bool), np.zeros(len(doc), bool), [], len(item)
    while heap and left >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = np.flatnonzero(mine[i : i + n] | theirs[j : j + n])
        if not len(taken):
            mine[i : i + n] = theirs[j : j + n] = True
            out.append((i, j, n))
            left -= n
            continue
        edges = [-1, *taken.tolist(), n]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a - 1 >= least:
                heapq.heappush(heap, (-(b - a - 1), i + a + 1, j + a + 1))
    return out


class Seeds:
    """The seeds of ``width`` words of some items, in order."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int):
        self.items, self.width = items, width
        seeds = [grams(w, width) for _, w in items]
        allseeds = np.concatenate(seeds)
        order = np.argsort(allseeds, kind="stable")
        self.seeds = allseeds[order]
        self.owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order]
        self.place = np.concatenate([np.arange(len(s)) for s in seeds])[order].astype(int)

    def found(self, doc: np.ndarray, cover: float) -> list[tuple[int, int, int, int, float]]:
        out, width = [], self.width
        if len(doc) < width:
            return out
        # Each seed of the document once, with its places; its repetitions count for items that pass only.
        every = grams(doc, width)
        places = np.argsort(every, kind="stable")
        mine, start, times = np.unique(every[places], return_index=True, return_counts=True)
        first = np.searchsorted(self.seeds, mine)
        at = np.flatnonzero(self.seeds[np.minimum(first, len(self.seeds) - 1)] == mine)
        if not len(at):
            return out
        last = np.searchsorted(self.seeds, mine[at], side="right")
        count = last - first[at]
        seed = np.repeat(at, count)
        row = np.repeat(first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        owner, i = self.owner[row], self.place[row]
        order = np.argsort(owner, kind="stable")
        owner, i, seed = owner[order], i[order], seed[order]
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1), len(owner)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            item_id, words = self.items[owner[a]]
            reach = np.zeros(len(words) + width, bool)
            for k in range(width):
                reach[i[a:b] + k] = True
            if reach.sum() < cover * len(words) - 1e-9:
                continue  # the tiles lie within the seeds, so they can't cover more
            met = ((x, y) for x, s in zip(i[a:b].tolist(), seed[a:b].tolist(), strict=True) for y in places[start[s] : start[s] + times[s]].tolist())
            same = [(x, y) for x, y in met if (words[x : x + width] == doc[y : y + width]).all()]
            got = tiles(words, doc, same, width)
            n = sum(x[2] for x in got)
            if n >= cover * len(words) - 1e-9:
                out.append((item_id, len(words), n, len(got), round(n / len(words), 6)))
        return out


class Index:
    """Items by seed: of five words, or of all the words of an item that has fewer. Items without words are never found."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = WordHashes()
        worded = [(i, w) for i, w in ((i, hashes.of(t)) for i, t in items) if len(w)]
        width = lambda x: min(WORDS, len(x[1]))
        self.parts = [Seeds([x for x in worded if width(x) == n], n) for n in sorted(set(map(width, worded)))]

    def found(self, doc: np.ndarray, cover: float) -> list[tuple[int, int, int, int, float]]:
        return [x for p in self.parts for x in p.found(doc, cover)]


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of ``most`` bytes of text, one in memory at a time; ties in coverage keep all items."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if block and size + len(r[1]) > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1].encode("utf-8", "surrogatepass"))
    yield block


def annotate(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the column ``name``: the items found in each document, as an array of (item_id, n_words, n_covered, n_tiles, coverage)."""
    found: list[str] = []
    for block in blocks(benchmark, item_id, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(texts, sent=sent):
            hashes = WordHashes.shared()
            got = [sorted(sent.value.found(hashes.of(t), cover), key=lambda x: (x[0] is None, x[0])) for t in texts]
            return [[[dict(zip(("item_id", "n_words", "n_covered", "n_tiles", "coverage"), x, strict=True)) for x in row] for row in got]]

        # The text itself is among the kept columns, so the whole row passes through.
        docs = per_text(docs, text, docs.columns, f"found {MATCH}", run)
        found.append(docs.columns[-1])
    whole = F.concat(*[F.col(f"`{c}`") for c in found])
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in found], whole.alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", cover: float = COVER) -> DataFrame:
    """One row per document and item found in it: (doc_id, item_id, n_words, n_covered, n_tiles, coverage).

    Null and empty texts contain nothing; items of fewer than five words are
    found where they stand whole, items without words never; repeated documents
    and items give a row each; of matches of one length the leftmost in the item,
    then in the document, is marked first. Very long texts are compared whole: a
    text's memory grows with its words and with the places where an item that
    its seeds may cover repeats in it. An empty table on either side gives no
    rows. Extra columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    found = annotate(slim, benchmark, "hits", cover=cover)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
