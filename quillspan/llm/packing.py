"""Operator 1: variable-capacity best-fit packing.

Documents become pieces no longer than the largest permitted sequence length;
pieces are dealt at random, by hash, into shards of a fixed expected size, and
each shard is packed on its own. One plan chooses the length of every bin jointly with
its contents: each permitted length is filled on trial, longest items first, and
the one of least cost per unit of its contents is opened. In the other plans, which
are best-fit decreasing, every permitted length
is tried as the one to open bins with (the least cost per unit first); each
plan's bins are then downsized to the cheapest length that still holds their
contents, and the plan of least total cost wins.

Only ids and lengths move through the shuffle, never texts. A shard's size does
not depend on any key of the data, so no group of rows makes it larger.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (2048, 4096, 8192, 16384)
SHARD_PIECES = 2048
OUT = "doc_id long, piece long, start long, length long, shard long, bin long, capacity long, offset long"


def unit_cost(capacity: int) -> float:
    """A sequence costs its length and a fixed 64 units of overhead."""
    return capacity + 64.0


def best_fit(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float], opening: int) -> list[tuple[int, int]]:
    """(bin, offset) per item, for items in descending order; ``opening`` is the preferred size of a new bin.

    An item goes to the open bin that it leaves least room in (ties: the bin
    opened first). Else a bin is opened: the preferred size if it holds the item,
    else the size of least cost that does.
    """
    rooms: list[int] = []
    at: dict[int, list[int]] = {}
    sizes, used, placed = sorted(capacities), [], []
    for length in lengths:
        k = bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop(0)
            if not at[room]:
                rooms.pop(k)
        else:
            room = opening if opening >= length else min((c for c in sizes if c >= length), key=lambda c: (cost(c), c))
            b = len(used)
            used.append(0)
        placed.append((b, used[b]))
        used[b] += length
        rest = room - length
        if not at.get(rest):
            insort(rooms, rest)
            at[rest] = [b]
        else:
            insort(at[rest], b)
    return placed


def mixed_fit(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float]) -> list[tuple[int, int]]:
    """(bin, offset) per item, for items in descending order, with the size of every bin chosen for what it will hold.

    For the longest item left, each capacity that holds it is filled on trial with
    the longest items that still fit; the bin that costs least per unit of its
    contents is opened, at the size that these need (ties: the larger one).
    """
    left = sorted((n, -i) for i, n in enumerate(lengths))  # ascending; of equal items the first stands last
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    b = 0
    while left:
        best: tuple[float, int, list[int]] | None = None
        for capacity in sorted(capacities, reverse=True):
            if capacity < left[-1][0]:
                break
            taken, room, at = [], capacity, len(left) - 1
            while at >= 0:
                taken.append(at)
                room -= left[at][0]
                at = min(at, bisect_left(left, (room + 1, float("-inf")))) - 1
            used = capacity - room
            rate = min(cost(c) for c in capacities if c >= used) / max(1, used)
            if best is None or rate < best[0] - 1e-12:
                best = (rate, used, taken)
        offset = 0
        for k in best[2]:
            n, i = left[k]
            placed[-i] = (b, offset)
            offset += n
        for k in best[2]:
            left.pop(k)
        b += 1
    return placed


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = unit_cost) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) per item; the cheapest, after downsizing, of a plan that mixes sizes and one for each opening size."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    items = [lengths[i] for i in order]
    best, least = [], float("inf")
    plans = [lambda: mixed_fit(items, capacities, cost)]
    plans += [lambda c=c: best_fit(items, capacities, cost, c) for c in sorted(capacities, key=lambda c: (cost(c) / c, -c))]
    for plan in plans:
        placed = plan()
        load: dict[int, int] = {}
        for i, (b, _) in zip(order, placed, strict=True):
            load[b] = load.get(b, 0) + lengths[i]
        size = {b: min((c for c in capacities if c >= n), key=lambda c: (cost(c), c)) for b, n in load.items()}
        if (total := sum(map(cost, size.values()))) < least:
            best, least = [(b, size[b], at) for b, at in placed], total
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(lengths)
    for i, x in zip(order, best, strict=True):
        out[i] = x
    return out


def best_fit_pack(
    docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = unit_cost, shard_pieces: int = SHARD_PIECES, content: bool = False,
) -> DataFrame:
    """One row per piece: its document and span there, its shard, bin, the bin's final capacity, and its offset in the bin.

    ``length`` defaults to the UTF-8 bytes of ``text``, the units of a byte-level
    model. A document longer than the largest capacity is split into full pieces
    and a rest; nothing is dropped. Null or empty texts give one piece of length
    0, null ids stay null, repeated rows are packed as often as they occur, and an
    empty table gives no rows. Extra columns are ignored. Ties in length go by id,
    then by place.

    With ``content`` (and the default length) each piece's bytes come along: they
    are cut where the text is and move with the piece, so a shard has its pieces'
    bytes, SHARD_PIECES times the largest capacity at most on average.
    """
    if content and length is not None:
        raise ValueError("content goes with the length in bytes")
    length = F.octet_length("text") if length is None else length
    top, sizes = max(capacities), tuple(sorted(capacities))
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8") if content else F.lit(None).cast("binary")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"), raw.alias("raw"))
    number = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("n", F.lit(1)) - 1) / top))
    cut = lambda i: F.struct(i.alias("piece"), F.substring("raw", (i * top + 1).cast("int"), F.lit(top)).alias("content"))
    pieces = slim.select("doc_id", "n", F.inline(F.transform(number, cut)))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("length"), *["content"] * content)
    out = OUT + ", content binary" * content
    total = slim.agg(F.sum(F.floor((F.greatest("n", F.lit(1)) - 1) / top) + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    # The hash takes the length too, so that rows that share an id (a null one, say) still spread.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit(17)), F.lit(shards)))

    def run(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        got = pack(rows["length"].take(order).to_pylist(), sizes, cost)
        back = pc.sort_indices(order)  # the rows stay as they came, so their bytes aren't copied
        for i, name in enumerate(("bin", "capacity", "offset")):
            rows = rows.append_column(name, pa.array([x[i] for x in got], pa.int64()).take(back))
        return rows.select([x.split()[0] for x in out.split(", ")])

    return dealt.groupBy("shard").applyInArrow(run, out)
