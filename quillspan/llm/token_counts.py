"""Operator 3: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
position; dynamic programming then carries only the best score and its number
of pieces. Rules of the tokenizer kept exactly: scores are doubles, summed from
the left; of paths of equal score to one position the one whose last piece
starts first stays (a later one must be strictly better); an unknown character
costs the lowest score less 10 and is one unknown piece; runs of unknown
characters count as one piece, or as their UTF-8 bytes under byte fallback.

Texts are cut before each blank, as the tokenizer's own pre-tokenizer does, and
the count of each distinct word is kept, so the dynamic programme runs once for
each distinct word of a task. Row-local: no shuffle.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

BLANK = "▁"
WORDS = re.compile(f"{BLANK}[^{BLANK}]*")
BYTE = re.compile(r"<0x[0-9A-F]{2}>")
SCHEMA = "n_tokens long, n_unknown long, log_prob double"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of a sentencepiece file in id order. The file's scores are ranks, so a piece's log-probability is Zipf's: -ln(2 - rank score)."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=path)
    return tuple((sp.id_to_piece(i), -math.log(2.0 - sp.get_score(i))) for i in range(sp.get_piece_size()))


class Counter:
    """Counts pieces of one vocabulary; see the module for the rules."""

    def __init__(self, pieces: tuple[tuple[str, float], ...], byte_fallback: bool = True, unk: str = "<unk>"):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unk = min(s for _, s in pieces) - 10.0
        known = {p for p, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.memo: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """(pieces, unknown characters, score)."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for end, (length, score) in self.auto.iter(word):
            ends[end + 1].append((length, score))
            if length == 1:
                single[end] = True
        best, count, unknown, last = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            top, source, unk = None, 0, False
            found = sorted(ends[i], reverse=True)  # the longest starts first
            for length, score in found:
                got = score + best[i - length]
                if top is None or got > top:
                    top, source = got, i - length
            if not single[i - 1]:
                got = self.unk + best[i - 1]
                if top is None or got > top:
                    top, source, unk = got, i - 1, True
            best[i], last[i], unknown[i] = top, unk, unknown[source] + unk
            if unk:
                count[i] = count[source] + (len(word[i - 1].encode("utf-8", "surrogatepass")) if self.bytes else not last[source])
            else:
                count[i] = count[source] + 1
        return count[n], unknown[n], best[n]

    def __call__(self, text: str | None) -> tuple[int, int, float]:
        tokens = unknown = 0
        score = 0.0
        if text:
            for word in WORDS.findall(BLANK + text.replace(" ", BLANK) if text[0] not in (" ", BLANK) else text.replace(" ", BLANK)):
                got = self.memo.get(word)
                if got is None:
                    got = self.word(word)
                    if len(word) <= 64:
                        if len(self.memo) >= 300_000:
                            self.memo.clear()
                        self.memo[word] = got
                tokens, unknown, score = tokens + got[0], unknown + got[1], score + got[2]
        return tokens, unknown, score


@lru_cache(maxsize=2)
def counter(pieces: tuple[tuple[str, float], ...], byte_fallback: bool) -> Counter:
    return Counter(pieces, byte_fallback)


def count_tokens(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", byte_fallback: bool = True) -> DataFrame:
    """(id, n_tokens, n_unknown, log_prob) for every row.

    The vocabulary is read once, on the driver, and sent as a broadcast variable:
    its size is that of a tokenizer file. Null and empty texts have no tokens;
    repeated rows are counted each; an empty table gives no rows; extra columns
    are ignored.
    """
    from .common import per_text

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(texts):
        count = counter(sent.value, byte_fallback)
        got = [count(t) for t in texts]
        return [[x[0] for x in got], [x[1] for x in got], [float(x[2]) for x in got]]

    return per_text(docs, text, [id_col], SCHEMA, run)
