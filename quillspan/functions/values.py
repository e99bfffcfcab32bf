"""Typed field values as Spark columns: types, canonical forms, shapes, boxes.

Numbers stay strings from end to end, so no precision is lost. A canonical
number is the JSON list [digits, unit, currency].
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, fold, let, minus, squeeze

#: Literals that stand for a missing value.
MISSING = ("", "-", "—", "n/a", "na", "null", "none", "<redacted>", "[redacted]")
#: Identifiers that are compared without blanks and in capitals.
COMPACT = ("IBAN", "BBAN", "BIC", "ISIN", "LEI", "UETR")
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SHORT = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def value_type(name: Column) -> Column:
    """The type that a field name suggests."""
    key = F.regexp_replace(fold(name), "[^a-z0-9]", "")
    has = lambda *parts: key.rlike("|".join(parts))
    identifier = key.isin("iban", "bban", "bic", "isin", "lei", "uetr", "account") | has("identifier", "identification", "accountnumber")
    return (
        F.when(identifier, "identifier").when(key.endswith("date"), "date").when(has("currency"), "currency")
        .when(has("amount", "balance"), "amount").when(has("price", "quantity", "rate"), "number").otherwise("text")
    )


def date_value(value: Column, order: Column) -> Column:
    """ISO date, ``?`` if day and month can't be told apart, null if it is no date."""
    parts = lambda i: F.regexp_extract(value, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", i)
    numeric = value.rlike(r"^\d{1,2}(/\d{1,2}/|-\d{1,2}-)\d{4}$")
    mixed = value.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$") & ~numeric
    a, b = (F.nullif(parts(i), F.lit("")).cast("int") for i in (1, 2))
    unclear = order.isNull() & (a <= 12) & (b <= 12) & (a != b)
    day_first = F.coalesce(order == "dmy", F.lit(False)) | (order.isNull() & ((a > 12) | (a == b)))
    day, month = F.when(day_first, a).otherwise(b), F.when(day_first, b).otherwise(a)
    iso = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d"), "yyyy-MM-dd")
    by_number = F.when(unclear, "?").otherwise(iso(parts(3), month.cast("string"), day.cast("string")))
    year_first = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
    sorted_form = iso(*(F.regexp_extract(value, year_first, i) for i in (1, 3, 4)))
    low = F.lower(value)

    def worded(pattern: str, day: int, month: int, year: int) -> Column:
        name = F.substring(F.regexp_extract(low, pattern, month), 1, 3)
        number = ((F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), name) + 3) / 4).cast("int")
        return iso(F.regexp_extract(low, pattern, year), number.cast("string"), F.regexp_extract(low, pattern, day))

    first, later = rf"^(\d{{1,2}})\s+({MONTHS}|{SHORT})\s+(\d{{4}})$", rf"^({MONTHS}|{SHORT})\s+(\d{{1,2}}),\s*(\d{{4}})$"
    return (
        F.when(value.rlike(year_first), sorted_form).when(numeric, by_number).when(mixed, F.when(unclear, "?"))
        .when(low.rlike(first), worded(first, 1, 2, 3)).when(low.rlike(later), worded(later, 2, 1, 3))
    )


#: currency, bracket, sign, digits, decimals, bracket, unit, currency
AMOUNT = r"^(?:([A-Za-z]{3})\s+)?(\(?)\s*([+-]?)(\p{Nd}+|\p{Nd}{1,3}(?:,\p{Nd}{3})+)((?:\.\p{Nd}+)?)\s*(\)?)\s*([%‰]?)(?:\s+([A-Za-z]{3}))?$"


def number_value(value: Column) -> Column:
    """[digits, unit, currency] as JSON, null if it is no number. Dots are decimal; commas only group by three."""
    # One match gives all parts; none of them can hold the mark between them.
    groups = "\x1f".join(f"${i}" for i in range(1, 9))
    return let(minus(value), lambda text: F.when(text.rlike(AMOUNT), let(F.split(F.regexp_replace(text, AMOUNT, groups), "\x1f", -1), amount)))


def amount(parts: Column) -> Column:
    """The number whose parts AMOUNT has found."""
    part = lambda i: F.get(parts, F.lit(i - 1))
    bracket = part(2) != ""
    whole = F.regexp_replace(F.replace(part(4), F.lit(","), F.lit("")), r"^0+(?=\p{Nd})", "")
    digits = F.concat(whole, F.regexp_replace(part(5), r"\.?0*$", ""))
    signed = let(digits, lambda d: F.concat(F.when((bracket | (part(3) == "-")) & (d != "0"), "-").otherwise(""), d))
    currency = F.upper(F.when(part(1) != "", part(1)).otherwise(part(8)))
    quoted = F.when(currency == "", "null").otherwise(F.concat(F.lit('"'), currency, F.lit('"')))
    # JSON text, with units beyond ASCII escaped.
    unit = F.when(part(7) == "‰", "\\u2030").otherwise(part(7))
    return F.when(bracket == (part(6) != ""), F.concat(F.lit('["'), signed, F.lit('", "'), unit, F.lit('", '), quoted, F.lit("]")))


def typed_value(value: Column, kind: Column, name: Column, order: Column) -> Column:
    """(value, error) of a field's text under its type."""
    return let(squeeze(value), lambda clean: typed_clean(clean, kind, name, order))


def typed_clean(clean: Column, kind: Column, name: Column, order: Column) -> Column:
    parts = F.struct(F.when(kind == "date", date_value(clean, order)).alias("date"), F.when(kind.isin("number", "amount"), number_value(clean)).alias("number"), fold(clean).isin(*MISSING).alias("gone"))
    return let(parts, lambda v: chosen(clean, kind, name, v["date"], v["number"], v["gone"]))


def chosen(clean: Column, kind: Column, name: Column, date: Column, number: Column, gone: Column) -> Column:
    code = F.when(clean.rlike("^[A-Za-z]{3}$"), F.upper(clean))
    identifier = F.when(F.upper(name).isin(*COMPACT), F.upper(F.regexp_replace(clean, f"{SPACE}+", ""))).otherwise(clean)
    none = F.lit(None).cast("string")
    numeric = kind.isin("number", "amount")
    out = (
        F.when(gone, none).when(kind == "identifier", identifier).when(kind == "currency", code).when(numeric, number)
        .when(kind == "date", F.when(date != "?", date)).otherwise(fold(clean))
    )
    error = (
        F.when(gone, "missing_value").when((kind == "currency") & code.isNull(), "invalid_currency").when(numeric & number.isNull(), "invalid_number")
        .when((kind == "date") & (date == "?"), "ambiguous_date").when((kind == "date") & date.isNull(), "invalid_date")
    )
    return F.struct(out.alias("value"), error.alias("error"))


def canonical_value(value: Column, kind: Column, name: Column, order: Column, literal: Column) -> Column:
    """(value, error) under a field's comparison policy: the raw text if it is compared literally."""
    plain = F.struct(F.when(F.trim(value) != "", value).alias("value"), F.when(F.trim(value) == "", "missing_value").alias("error"))
    return F.when(literal, plain).otherwise(typed_value(value, kind, F.substring_index(name, ".", -1), order))


def looks_like_value(value: Column, kind: Column, order: Column) -> Column:
    text = F.trim(F.regexp_replace(F.trim(value), ";+$", ""))
    date = date_value(squeeze(text), order)
    return (
        F.when(kind.isin("amount", "number"), text.rlike(r"^([A-Za-z]{3}\s+)?[+\-−(]?\s*\p{Nd}"))
        .when(kind == "currency", text.rlike("^[A-Za-z]{3}$"))
        .when(kind == "date", text.rlike(r"^\p{Nd}") | (date.isNotNull() & (date != "?")))
        .when(kind == "identifier", text.rlike(r"^\p{Nd}") | text.rlike(r"^[A-Za-z]{1,6}\p{Nd}[\p{L}\p{N}_ -]*$"))
        .otherwise(False)
    )


def box_valid(box: Column) -> Column:
    inside = F.forall(box, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    at = lambda i: F.get(box, F.lit(i))
    return F.coalesce((F.size(box) == 4) & inside & (at(0) < at(2)) & (at(1) < at(3)), F.lit(False))


def iou(page_a: Column, box_a: Column, page_b: Column, box_b: Column) -> Column:
    """Intersection over union; 0 on different pages or without a box."""
    at = lambda b, i: F.get(b, F.lit(i))
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(at(box_a, hi), at(box_b, hi)) - F.greatest(at(box_a, lo), at(box_b, lo)))
    area = lambda b: (at(b, 2) - at(b, 0)) * (at(b, 3) - at(b, 1))
    both = side(0, 2) * side(1, 3)
    return F.when(page_a.eqNullSafe(page_b) & box_a.isNotNull() & box_b.isNotNull(), both / (area(box_a) + area(box_b) - both)).otherwise(0.0)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bits_apart(a: str, b: str) -> int:
    """The edit distance of two texts by Myers' bit vectors: a column of the table is one number, so the longer text's length costs little."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or not b:
        return len(a) - len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    score, last = len(a), 1 << (len(a) - 1)
    mask = 2 * last - 1
    up, down = mask, 0
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        right, left = down | (~(diagonal | up) & mask), up & diagonal
        score += 1 if right & last else -1 if left & last else 0
        right, left, same = right << 1 | 1, left << 1, same | down
        up, down = (left | ~(same | right)) & mask, right & same & mask
    return score


def long_edit_distance(a: Column, b: Column) -> Column:
    """``edit_distance`` of long texts, in Python: Spark's own fills the table cell by cell."""

    @F.pandas_udf("int")
    def apart(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else bits_apart(x, y) for x, y in zip(left, right, strict=True)], dtype="Int32")

    return apart(a, b)
