"""Whether a text looks like a value of a type, inside a worker that reads lines one after another. Same rules as values.looks_like_value."""

from __future__ import annotations

import re
from datetime import date

from .values import MONTHS, SHORT

#: How a value starts, or is, by its type; a date that starts with its month must be one.
SHAPES = {
    "number": re.compile(r"(?:[A-Za-z]{3}\s+)?[+\-−(]?\s*\d"),
    "currency": re.compile(r"[A-Za-z]{3}$"),
    "identifier": re.compile(r"\d|[A-Za-z]{1,6}\d[\w -]*$"),
    "date": re.compile(rf"\d|(?P<month>{MONTHS}|{SHORT})\s+(?P<day>\d{{1,2}}),\s*(?P<year>\d{{4}})$", re.IGNORECASE),
}
SHAPES["amount"] = SHAPES["number"]


def shaped(value: str, kind: str) -> bool:
    met = SHAPES[kind].match(value.strip().rstrip(";").strip()) if kind in SHAPES else None
    if met and kind == "date" and met["month"]:
        try:
            date(int(met["year"]), SHORT.split("|").index(met["month"][:3].lower()) + 1, int(met["day"]))
        except ValueError:
            return False
    return met is not None
