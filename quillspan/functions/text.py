"""Scalar text functions as Spark columns: tokens, numbers, labels and word sets.

Everything here stays in the JVM. Case folding is lower-casing plus the one
expansion that matters for the supported alphabets; ``functions.decode`` has the
full Unicode forms for other input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SIGNED = r"[+\-−]?\p{Nd}+(?:[.,:/-]\p{Nd}+)*(?:[%‰])?"
NUMBER = rf"(?<!{WORD})(?:\({SPACE}*{SIGNED}{SPACE}*\)|{SIGNED})(?!{WORD})"
TOKEN = rf"{NUMBER}|{WORD}+"
LETTERS = r"[\p{L}\p{N}]+"
#: Words that carry no topic in schema routing.
ROUTING_STOP = ("and", "for", "in", "of", "the", "this", "to", "with")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Case folding for comparison."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """Collapse white space and drop soft hyphens, for text in normal form."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), f"{SPACE}+", " "))


def minus(text: Column) -> Column:
    return F.replace(text, F.lit("−"), F.lit("-"))


def tight(token: Column) -> Column:
    """An accounting parenthesis without inner blanks."""
    return F.when(token.startswith("("), F.regexp_replace(token, f"{SPACE}+", "")).otherwise(token)


def tokens(text: Column) -> Column:
    """Numbers with sign, inner punctuation and percent sign; accounting parentheses; words."""
    return F.transform(F.regexp_extract_all(minus(fold(text)), F.lit(TOKEN), F.lit(0)), tight)


def numbers(text: Column) -> Column:
    """Number strings of the text as written."""
    return F.transform(F.regexp_extract_all(minus(text), F.lit(NUMBER), F.lit(0)), tight)


def label_key(label: Column) -> Column:
    return F.array_join(F.regexp_extract_all(fold(label), F.lit(LETTERS), F.lit(0)), " ")


def camel_split(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")


def name_variants(name: Column) -> Column:
    """The word phrases of a name as it stands and with camel case split, without repetition."""
    words = [F.regexp_extract_all(fold(squeeze(n)), F.lit(LETTERS), F.lit(0)) for n in (name, camel_split(name))]
    return F.filter(F.array_distinct(F.array(*words)), lambda p: F.size(p) > 0)


def routing_words(text: Column) -> Column:
    """Distinct words that may route a text to a schema."""
    split = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(fold(split), F.lit(LETTERS), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, ROUTING_STOP)))


def dice(shared: Column, left: Column, right: Column, empty: Column | None = None) -> Column:
    """2 * shared / (left + right); ``empty`` (0 unless given) where both sides are empty."""
    total = left + right
    return F.when(total > 0, 2 * shared / total).otherwise(F.lit(0.0) if empty is None else empty)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, text): overlapping character blocks, the last ending at the text's end."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))


def pointer_part(key: Column) -> Column:
    """One part of a JSON pointer, escaped."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def redact(text: Column) -> Column:
    """Keys and bearer tokens masked in messages."""
    hidden = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[redacted]")
    return F.regexp_replace(hidden, r"(?i)((?:api[_-]?key|token|secret|password)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;]+", "$1[redacted]")


def visual_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def banned_next(ids: Column, n: int, window: int) -> Column:
    """Tokens that would repeat an n-gram of the last ``window`` ids."""
    recent = F.when(F.size(ids) > window, F.slice(ids, F.size(ids) - window + 1, F.lit(window))).otherwise(ids)

    def body(seq: Column) -> Column:
        tail = F.slice(seq, F.size(seq) - n + 2, F.lit(n - 1))
        starts = F.sequence(F.lit(1), F.size(seq) - n + 1)
        same = F.filter(starts, lambda i: F.slice(seq, i, F.lit(n - 1)) == tail)
        return F.array_sort(F.array_distinct(F.transform(same, lambda i: F.element_at(seq, i + n - 1))))

    long_enough = F.filter(F.array(recent), lambda s: F.size(s) >= n)
    return F.coalesce(F.get(F.transform(long_enough, body), F.lit(0)), F.slice(ids, F.lit(1), F.lit(0)))
