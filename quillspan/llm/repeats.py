"""Operator 6: removal of repeated byte strings by common-prefix interval trees.

Every byte covered by a 200-byte string that starts at another place as well is
removed. One suffix array over a whole corpus doesn't fit a machine, so the
strings are dealt out by what they contain:

1. In every 200-byte string the 24-byte string of least hash is its anchor.
   Equal strings have equal anchors at equal offsets, so all copies of a string
   meet where their anchor's hash is dealt. About one byte in 90 starts an anchor.
2. What surrounds an anchor (176 bytes to each side) decides which of the strings
   around it repeat. Anchors that occur once are done; places of equal
   surroundings, told by another hash, repeat as a whole, however many there
   are, and one of them stands for all from there on.
3. Different surroundings of one anchor are put into enhanced suffix arrays, one
   for each column. A stack scan goes through the intervals of their common
   prefixes; those of 200 bytes or more whose occurrences differ in the byte
   before are the maximal repeats, each a group with all its occurrences, and all
   of those are covered. repeat_groups puts the groups out.
   An anchor with very many different surroundings is not sent to one task:
   there each 200-byte string around it is counted by a 128-bit hash.
4. Each document's covered spans are merged and cut out.

Texts move twice, compressed; anchors move as hashes and positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, mix, partitions, per_text, slices, written

LENGTH, GRAM = 200, 24
SIDE = LENGTH - GRAM
#: An anchor with more different surroundings than this is counted by string.
MOST = 60_000
#: Bytes of surroundings that are sorted at once.
ARRAY_BYTES = 1 << 20
#: Anchors of more than one in so many places are looked up apart.
HOT = 256
BASE = 0x9E3779B97F4A7C15
KEY = ["doc_id", "th"]
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@lru_cache(maxsize=4)
def powers(base: int, bits: int) -> np.ndarray:
    """base**i modulo 2**64 for i up to 2**bits."""
    out = np.full((1 << bits) + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Sums:
    """Hashes of any substrings of one text, from prefix sums modulo 2**64. They choose anchors, whose bytes are compared later."""

    def __init__(self, raw: np.ndarray, base: int = BASE):
        bits = max(16, int(len(raw)).bit_length())
        self.back = powers(pow(base, -1, 1 << 64), bits)
        table = mix((np.arange(256).astype(np.uint64) + np.uint64(1)) * np.uint64(base))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(table[raw] * powers(base, bits)[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the surroundings, position) of a text; none under 200 bytes."""
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)
    at = np.arange(len(raw) - GRAM + 1)
    each = Sums(raw)(at, at + GRAM)
    least = sliding(each, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    pos = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum) == each)
    whole = raw.tobytes()
    around = [xxhash.xxh3_64_intdigest(whole[max(0, p - SIDE) : p + LENGTH], min(p, SIDE)) for p in pos.tolist()]
    return each[pos].view(np.int64), np.array(around, np.uint64).view(np.int64), pos.astype(np.int32)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before) of numbers under 2**15, by doubling.

    The ranks of each doubling are kept: two suffixes' common prefix is read off
    them from the longest step down. Prefixes are told apart up to 512 only, more
    than any piece has.
    """
    n = len(text)
    rank = text.astype(np.int64)
    levels, step = [], 1
    while True:
        order = np.argsort(rank, kind="stable")
        values = rank[order]
        new = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append((step, rank))
        if step >= 512 or new[-1] == n - 1:
            break
        next_rank = np.zeros(n, np.int64)
        next_rank[: n - step] = rank[step:] + 1 if step < n else 0
        rank = rank * (n + 1) + next_rank
        step *= 2
    prefix = np.zeros(n, np.int64)
    a, b, have = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for step, rank in reversed(levels):
        inside = (a + step <= n) & (b + step <= n)
        same = np.flatnonzero(inside)
        same = same[rank[a[same] % n] == rank[b[same] % n]]
        a[same] += step
        b[same] += step
        have[same] += step
    prefix[1:] = have
    return order, prefix


def intervals(prefix: np.ndarray, differs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first row, row after the last) of the intervals of a suffix array that stand for maximal repeats of ``least`` or more.

    ``prefix`` has the common prefix of each row with the one before. A stack holds
    the open intervals; when one closes, its rows are all occurrences of its
    prefix; it is maximal to the right by construction, and to the left if the
    values before its occurrences differ: ``differs`` counts, from the first row,
    the neighbours with different values before them, so one step tells whether
    an interval has any. Runs of rows that have none at all are passed over, and
    runs of one common prefix are one interval; the stack goes through the others.
    """
    inside = np.flatnonzero(prefix >= least)
    empty = np.zeros(0, np.int64)
    if not len(inside):
        return empty, empty, empty
    cuts = np.flatnonzero(np.diff(inside) > 1) + 1
    start, stop = inside[np.concatenate([[0], cuts])], inside[np.concatenate([cuts - 1, [-1]])] + 1
    diverse = differs[stop - 1] != differs[start - 1]
    start, stop = start[diverse], stop[diverse]
    if not len(start):
        return empty, empty, empty
    # reduceat takes what lies between two starts into the first one's part, so ends stand among the starts.
    edges = np.stack([start, stop], axis=1).ravel()
    padded = np.concatenate([prefix, [0]])
    low, high = np.minimum.reduceat(padded, edges)[::2], np.maximum.reduceat(padded, edges)[::2]
    even = low == high
    out = [(low[even].astype(np.int64), start[even] - 1, stop[even])]
    for a, b in zip(start[~even].tolist(), stop[~even].tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (prefix, first row)
        made = []
        for i, p in zip(range(a, b + 1), [*prefix[a:b].tolist(), 0], strict=True):
            first = i - 1
            while stack and stack[-1][0] > p:
                length, first = stack.pop()
                if differs[i - 1] != differs[first]:
                    made.append((length, first, i))
            if p >= least and (not stack or stack[-1][0] < p):
                stack.append((p, first))
        if made:
            out.append(tuple(np.array(x, np.int64) for x in zip(*made, strict=True)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def maximal_repeats(text: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of every maximal repeat of ``least`` or more in one sequence."""
    order, prefix = suffix_array(text)
    before = np.where(order > 0, text[order - 1], -1)
    differs = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for length, first, end in zip(*intervals(prefix, differs, least), strict=True):
        yield int(length), order[first:end]


class Aligned:
    """The enhanced suffix arrays of pieces that stand one above the other, their anchors in column SIDE.

    A string and its copies lie in the same columns, so suffixes are compared
    within a column only, and within an anchor. The array of column c - 1 follows
    from that of column c: the suffixes are dealt by the byte in front of them, in
    a stable sort, and the common prefix of two that come to stand side by side is
    one more than the least of those between them. The rightmost array is sorted
    once. (This is the positional Burrows-Wheeler transform, read from the right.)
    """

    def __init__(self, group: np.ndarray, left: np.ndarray, raw: list[bytes]):
        self.rows, self.left = len(raw), left
        width = SIDE + LENGTH
        # 0 is beyond a piece's ends.
        self.cells = np.zeros((self.rows, width + 1), np.uint16)
        for i, (n, x) in enumerate(zip(left.tolist(), raw, strict=True)):
            self.cells[i, SIDE - n : SIDE - n + len(x)] = np.frombuffer(x, np.uint8)
            self.cells[i, SIDE - n : SIDE - n + len(x)] += 1
        tails = [x[n:] for n, x in zip(left.tolist(), raw, strict=True)]
        ends = np.array([len(t) for t in tails], np.int32)
        self.group = group.astype(np.uint16)
        self.order = np.array(sorted(range(self.rows), key=lambda i: (group[i], tails[i])), np.int64)
        self.prefix = np.zeros(self.rows + 1, np.int32)
        if self.rows > 1:
            one, two = self.order[:-1], self.order[1:]
            same = self.cells[one, SIDE:width] == self.cells[two, SIDE:width]
            common = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
            common = np.minimum(common, np.minimum(ends[one], ends[two]))
            self.prefix[1:-1] = np.where(self.group[one] == self.group[two], common, 0)

    def step(self, column: int) -> None:
        """Go from the array of ``column`` + 1 to that of ``column``."""
        front = self.cells[self.order, column]
        place = np.argsort(front, kind="stable")
        place = place[np.argsort(self.group[self.order[place]], kind="stable")]
        p, q = place[:-1], place[1:]
        joined = (self.group[self.order[p]] == self.group[self.order[q]]) & (front[p] == front[q]) & (front[p] > 0)
        prefix = np.zeros(self.rows + 1, np.int32)
        at = np.flatnonzero(joined)
        if len(at):
            lo, gap = p[at] + 1, q[at] - p[at]
            power = np.log2(gap).astype(np.int64)
            table, least = self.prefix, np.empty(len(at), np.int32)
            for k in range(int(power.max()) + 1):
                if k:
                    table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
                mine = np.flatnonzero(power == k)
                least[mine] = np.minimum(table[lo[mine]], table[lo[mine] + gap[mine] - (1 << k)])
            prefix[at + 1] = least + 1
        self.order, self.prefix = self.order[place], prefix

    def repeats(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(column, lengths, first rows, ends) of the maximal repeats of ``least`` bytes or more by the column that they start in.

        All occurrences of one are the rows of ``order`` from its first to its end,
        while that column's array stands. One whose occurrences all have the same
        byte in front isn't maximal: it is met again, longer, a column to the left.
        A text's start differs from all else.
        """
        for column in range(SIDE, -1, -1):
            if column < SIDE:
                self.step(column)
            prefix = self.prefix[: self.rows]
            if not (prefix >= least).any():
                continue
            front = self.cells[self.order, column - 1] if column else np.zeros(self.rows, np.uint16)
            differs = np.concatenate([[0], np.cumsum((front[1:] != front[:-1]) | (front[1:] == 0))])
            yield column, *intervals(prefix, differs, least)

    def covered(self, least: int) -> np.ndarray:
        """Which cells lie in an occurrence of a maximal repeat of ``least`` bytes or more."""
        edge = np.zeros((self.rows, self.cells.shape[1] + 1), np.int16)
        for column, length, first, end in self.repeats(least):
            if not len(length):
                continue
            by = np.argsort(length, kind="stable")  # of repeats that start together the longest is written last
            length, first, n = length[by], first[by], (end - first)[by]
            at = self.order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            reach = np.zeros(self.rows, np.int64)
            reach[at] = np.repeat(length, n)
            rows = np.flatnonzero(reach)
            edge[rows, column] += 1
            edge[rows, column + reach[rows]] -= 1
        return np.cumsum(edge, axis=1, dtype=np.int16)[:, :-1] > 0


def aligned(rows: list[tuple[int, int, int, bytes]]) -> Aligned:
    """Rows (anchor, surroundings, bytes before the anchor, bytes) one above the other."""
    names = {a: i for i, a in enumerate(dict.fromkeys(r[0] for r in rows))}
    return Aligned(np.array([names[r[0]] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows])


def covered(rows: list[tuple[int, int, int, bytes]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Spans relative to the anchor, by (anchor, surroundings)."""
    inside = aligned(rows).covered(LENGTH)
    turns = np.diff(np.pad(inside.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    starts, ends = np.nonzero(turns == 1), np.nonzero(turns == -1)
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, a, b in zip(starts[0].tolist(), starts[1].tolist(), ends[1].tolist(), strict=True):
        out.setdefault((rows[i][0], rows[i][1]), []).append((a - SIDE, b - SIDE))
    return out


def grouped(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(anchor, surroundings, group, start relative to the anchor, length) of every occurrence of every maximal repeat; a group is named by a hash of its string.

    A repeat in which the anchor is not the least of any 200 bytes is left to the
    anchors that are: other copies of it need not have this one.
    """
    made = aligned(rows)
    found = ((column, int(n), made.order[a:b]) for column, *x in made.repeats(LENGTH) for n, a, b in zip(*x, strict=True))
    for column, length, at in found:
        _, _, left, raw = rows[int(at[0])]
        string = raw[column - SIDE + left : column - SIDE + left + length]
        grams = Sums(np.frombuffer(string, np.uint8))(start := np.arange(length - GRAM + 1), start + GRAM)
        less = np.concatenate([[-1], np.flatnonzero(grams < grams[SIDE - column]), [len(grams)]])
        k = int(np.searchsorted(less, SIDE - column))
        if less[k] - less[k - 1] <= SIDE + 1:
            continue
        name = xxhash.xxh3_128_digest(string)
        for i in at.tolist():
            yield rows[i][0], rows[i][1], name, column - SIDE, length


SPANS = "array<struct<lo:int,hi:int>>"


def by_array(pieces: DataFrame, groups: bool = False) -> DataFrame:
    """(ah, ch, spans) of pieces sorted by anchor, whole anchors, ARRAY_BYTES of them at a time; with ``groups`` (ah, ch, name, lo, length) of all occurrences."""
    kinds = arrow_schema(f"ah long, ch long, {'name binary, lo int, length int' if groups else f'spans {SPANS}'}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            if groups:
                made = list(grouped(held))
            else:
                made = [(*k, [{"lo": a, "hi": b} for a, b in v]) for k, v in covered(held).items()]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for batch in batches:
            for part in slices(batch, 3):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held and row[:2] == held[-1][:2] and not groups:
                        continue  # the same piece, from rows that repeat
                    if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                        yield flush()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[3])
        if held:
            yield flush()

    n = partitions(pieces)
    dealt = pieces.repartition(n, "ah").sortWithinPartitions("ah", "ch")
    out = "ah long, ch long, " + ("name binary, lo int, length int" if groups else f"spans {SPANS}")
    return dealt.select("ah", "ch", "offset", "raw").mapInArrow(run, out)


def by_string(pieces: DataFrame) -> DataFrame:
    """(ah, ch, spans) of anchors with very many surroundings: each 200-byte string around one is counted by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ah, ch, offset, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = np.arange(len(raw) - LENGTH + 1)
                each = b"".join(xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(len(start)))
                one, two = np.frombuffer(each, dtype=np.int64).reshape(-1, 2).T
                rows = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, ah)), pa.array(np.full(rows, ch)), pa.array((start - offset).astype(np.int32)), pa.array(one), pa.array(two)],
                    names=["ah", "ch", "lo", "one", "two"],
                )

    each = written(pieces.dropDuplicates(["ah", "ch"]).select("ah", "ch", "offset", "raw").mapInArrow(run, "ah long, ch long, lo int, one long, two long"))
    name = ["ah", "lo", "one", "two"]
    twice = each.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = each.join(twice, name, "left_semi").groupBy("ah", "ch").agg(F.collect_list(F.struct("lo", (F.col("lo") + LENGTH).alias("hi"))).alias("spans"))
    return found.select("ah", "ch", F.col("spans").cast(SPANS).alias("spans"))


def packed(slim: DataFrame) -> DataFrame:
    """(doc_id, th, z): the texts in UTF-8, compressed before they are shuffled."""

    def run(texts):
        press = zstandard.ZstdCompressor(level=3)
        return [[press.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]]

    return per_text(slim, "text", KEY, "z binary", run)


def surroundings(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(ah, ch, n, offset, raw) of the representatives (doc_id, th, pos, ah, ch, n). Rows that repeat give the same piece again."""
    lists = reps.groupBy(*KEY).agg(F.collect_list(F.struct("ah", "ch", "pos", "n")).alias("wanted"))
    joined = texts.join(lists, [texts[k].eqNullSafe(lists[k]) for k in KEY]).select("z", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ah", "ch", "n", "offset", "raw"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for part in slices(batch, 0, 1 << 19):
                rows = []
                for z, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = zstandard.ZstdDecompressor().decompress(z)
                    for w in wanted:
                        left = min(w["pos"], SIDE)
                        rows.append((w["ah"], w["ch"], w["n"], left, raw[w["pos"] - left : w["pos"] + LENGTH]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=names)

    return joined.mapInArrow(run, "ah long, ch long, n long, offset int, raw binary")


def places(slim: DataFrame) -> DataFrame:
    """(doc_id, th, pos, ah, ch, several) of the anchors that occur again; ``several`` if their surroundings differ.

    Anchors of more than one in HOT places, of which there are fewer than HOT, are
    looked up in a broadcast table; the others meet in a shuffle.
    """

    def run(names):
        got = [anchors(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)) for t in names]
        return [[g[i] for g in got] for i in range(3)]

    each = written(per_text(slim, "text", KEY, "ah array<long>, ch array<long>, pos array<int>", run))
    rows = each.select(*KEY, F.explode(F.arrays_zip("ah", "ch", "pos")).alias("a")).select(*KEY, "a.ah", "a.ch", "a.pos")
    twice = rows.groupBy("ah").agg(F.count(F.lit(1)).alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).where("n > 1")
    twice = written(twice.select("ah", (F.col("lo") != F.col("hi")).alias("several"), "n"))
    most = (each.agg(F.sum(F.size("ah"))).first()[0] or 0) // HOT
    few, rest = (F.broadcast(twice.where(F.col("n") > most)).drop("n"), twice.where(F.col("n") <= most).drop("n"))
    cold = rows.join(few.drop("several"), "ah", "left_anti").join(rest, "ah")
    return written(rows.join(few, "ah").unionByName(cold))


def kinds_of(several: DataFrame) -> DataFrame:
    """(ah, ch, n, doc_id, th, pos) of the different surroundings of anchors: how many places have them, and one that stands for all."""
    kinds = several.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "pos")).alias("rep"))
    return written(kinds.select("ah", "ch", "n", "rep.*"))


def repeated(slim: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi): covered spans in bytes, one or more for each anchor that occurs again; they may pass the text's end."""
    again = places(slim)
    several = again.where("several")
    kinds = kinds_of(several)
    over = written(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MOST).select("ah"))
    if over.isEmpty():
        found = by_array(surroundings(kinds, texts))
    else:
        found = by_array(surroundings(kinds.join(over, "ah", "left_anti"), texts)).union(by_string(surroundings(kinds.join(over, "ah", "left_semi"), texts)))
    whole = F.array(F.struct(F.lit(-SIDE).alias("lo"), F.lit(LENGTH).alias("hi"))).cast(SPANS)
    alone = found.join(kinds.where("n > 1").select("ah", "ch"), ["ah", "ch"], "left_anti")
    spans = written(alone.union(kinds.where("n > 1").select("ah", "ch", whole.alias("spans"))))
    part = several.join(spans, ["ah", "ch"]).select(*KEY, "pos", F.explode("spans").alias("s")).select(*KEY, (F.col("pos") + F.col("s.lo")).alias("lo"), (F.col("pos") + F.col("s.hi")).alias("hi"))
    full = again.where("not several").select(*KEY, (F.col("pos") - SIDE).alias("lo"), (F.col("pos") + LENGTH).alias("hi"))
    return full.union(part)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(name, length, doc_id, th, start) of every maximal repeat of 200 bytes or more around an anchor, with all its occurrences.

    A repeat's string is looked at as far as 176 bytes before its anchor and 200
    bytes from it; longer ones come in such parts, one for each anchor in them.
    Rows of one name are the occurrences of one string: name is a hash of it, th
    one of the text, start the byte that it starts at; rows of one id and one text
    are told as one. Nulls, empty tables and columns are as in remove_repeats.
    Anchors of more than MOST surroundings, too, go to one array each here.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    again = places(slim).select(*KEY, "pos", "ah", "ch")
    # Surroundings that several places have stand in the array twice, so that they repeat there as well.
    pieces = written(surroundings(kinds_of(again), packed(slim)))
    every = by_array(pieces.union(pieces.where("n > 1")), groups=True).distinct()
    made = again.join(every, ["ah", "ch"])
    return made.select(F.hex("name").alias("name"), "length", *KEY, (F.col("pos") + F.col("lo")).cast("long").alias("start")).distinct()


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a), min(size, b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with ``keep_text`` also the remaining bytes, as ``kept``.

    Null texts count as empty. Repeated rows are texts of their own, so each
    removes the other. Texts under 200 bytes keep all. Very long texts are read
    whole, one at a time. Ids may be null or shared. Ties don't arise: every byte in
    a repeat goes. An empty table gives no rows; extra columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = packed(slim)
    lists = repeated(slim, texts).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(lists, [texts[k].eqNullSafe(lists[k]) for k in KEY], "left").select(texts["doc_id"], "z", "spans")
    schema = OUT + ", kept binary" * keep_text
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                rows = []
                for doc_id, z, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = zstandard.ZstdDecompressor().decompress(z)
                    cut = merged([(s["lo"], s["hi"]) for s in spans or ()], len(raw))
                    edges = [0, *(x for s in cut for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc_id, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()) + (kept,) * keep_text)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return joined.mapInArrow(run, schema)
