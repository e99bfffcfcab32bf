"""Frozen variable-order byte context trees, one per class, scored with numpy.

The tree of one class gives each byte a probability after its last ``order``
bytes. With T continuations seen after a context, D of them distinct, and c of
this byte, a node at depth k says

    escape (prediction by partial matching, method C):
        c / (T + D)  if c > 0, else  D / (T + D) * P[k-1]
    blend (Witten-Bell smoothing):
        (c + D * P[k-1]) / (T + D)

and P[k-1] itself where the context was never seen; below the root every byte
has 1/256. Statistics are frozen, so the code length of a byte depends on the
last ``order + 1`` bytes alone: it is worked out once per gram, for all classes
together, and a text is scored by table lookups. Grams seen in no class walk
down the tree, adding each context's escape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: So many bytes times classes are scored at once.
BLOCK = 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15)


class Keys:
    """Row number of each known key: open addressing at a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self.first(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]  # of several for one slot, the last stays
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + np.uint64(1)) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MULT) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for unknown keys."""
        at = self.first(keys)
        got = self.slots[at]
        if not len(self.keys):
            return got
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            got[todo] = self.slots[at[todo]]
            now = got[todo]
            todo = todo[(now >= 0) & (self.keys[now] != keys[todo])]
        return got


def spread(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of the last order + 1 bytes, number of the text) of every byte; each text starts after ``order`` zero bytes."""
    return next(spread_blocks(texts, order, max(1, sum(map(len, texts)))), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))


def spread_blocks(texts: list[bytes], order: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``spread`` gives, in blocks of ``size`` bytes: it takes some 40 times the memory of the bytes themselves."""
    pad = b"\0" * order
    raw = np.frombuffer(pad + pad.join(texts) if texts else pad, dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    total = int(ends[-1]) if texts else 0
    for a in range(0, total, size):
        at = np.arange(a, min(a + size, total), dtype=np.int64)
        owner = np.searchsorted(ends, at, side="right")
        at += order * (owner + 1)
        keys = np.zeros(len(at), dtype=np.uint64)
        for j in range(order + 1):
            keys |= raw[at - j].astype(np.uint64) << np.uint64(8 * j)
        yield keys, owner


def low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * n)) - 1)


class ContextModel:
    def __init__(self, samples: dict[str, list[bytes]], order: int = 4, blend: bool = False):
        self.fit({c: np.unique(spread(texts, order)[0], return_counts=True) for c, texts in samples.items()}, order, blend)

    @classmethod
    def counted(cls, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = 4, blend: bool = False, base: ContextModel | None = None) -> ContextModel:
        """The model of texts counted elsewhere: for each class the different keys that ``spread`` gives, and how often each occurs.

        With a ``base`` of lower order, its nodes are taken from there. ``grams`` may
        then be a part, if it has all that have the same ``base.order + 1`` bytes before
        the last; the model holds for bytes after any of these.
        """
        model = cls.__new__(cls)
        model.fit(grams, order, blend, base)
        return model

    def fit(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int, blend: bool, base: ContextModel | None = None) -> None:
        self.classes, self.order = sorted(grams), order
        n = len(self.classes)
        counts = [grams[c] for c in self.classes]
        self.grams: list[tuple[Keys, np.ndarray]] = list(base.grams) if base else []
        self.escapes: list[tuple[Keys, np.ndarray]] = list(base.escapes) if base else []
        below = base.grams[-1][1] if base else None  # bits of the grams one byte shorter
        for k in range(len(self.grams) + 1, order + 2):
            keys = np.unique(np.concatenate([low(u, k) for u, _ in counts] or [np.zeros(0, np.uint64)]))
            seen = np.zeros((len(keys), n))
            for j, (u, c) in enumerate(counts):
                np.add.at(seen[:, j], np.searchsorted(keys, low(u, k)), c)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
                lower = np.full((len(keys), n), 1 / 256) if below is None else np.exp2(-below[np.searchsorted(self.grams[-1][0].keys, low(keys, k - 1))])
                share = seen / np.maximum(total + distinct, 1)[of]
                p = share + escape[of] * lower if blend else np.where(seen > 0, share, escape[of] * lower)
                below = -np.log2(p)
            self.grams.append((Keys(keys), below))
            self.escapes.append((Keys(contexts), -np.log2(escape)))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text under every class, in the order of ``classes``."""
        out = np.zeros((len(texts), len(self.classes)))
        for keys, owner in spread_blocks(texts, self.order, max(1, BLOCK // max(1, len(self.classes)))):
            cost, first = self.each(keys), owner[0]
            for j in range(len(self.classes)):
                added = np.bincount(owner - first, weights=cost[:, j])
                out[first : first + len(added), j] += added
        return out

    def each(self, keys: np.ndarray) -> np.ndarray:
        cost = np.zeros((len(keys), len(self.classes)))
        todo = np.arange(len(keys))
        for k in range(self.order + 1, 0, -1):
            table, bits = self.grams[k - 1]
            now = low(keys[todo], k)
            row = table.find(now)
            known = row >= 0
            cost[todo[known]] += bits[row[known]]
            todo, now = todo[~known], now[~known]
            if not len(todo):
                return cost
            table, bits = self.escapes[k - 1]
            row = table.find(now >> np.uint64(8))
            known = row >= 0
            cost[todo[known]] += bits[row[known]]
        cost[todo] += 8.0
        return cost
