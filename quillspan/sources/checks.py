"""Validation of control files: profiles, saved bundles, service addresses, selections of methods.

Each check lists all that is wrong, in tables of rules where it can; ``demand``
turns a list into an error. Control files are small and checked on the driver;
bundles are checked where they are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal, InvalidOperation
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_key
from ..functions.values import canonical_value
from ..operators.extraction import profile_labels
from ..operators.vocabulary import KINDS

Rule = tuple[Callable[[Any], bool], str]

filled = lambda v: isinstance(v, str) and bool(v.strip())
truth = lambda v: isinstance(v, bool)
names = lambda v: isinstance(v, list) and all(map(filled, v))
positive = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v > 0

#: Record keys that a profile has unless it names others.
RECORD_KEYS = ("Record", "Item", "Transaction ID")
#: What a field's settings may be. Those of the first table must be there.
NEEDED: dict[str, Rule] = {
    "value_type": (KINDS.__contains__, "a known type"), "critical": (truth, "true or false"), "weight": (positive, "finite and above 0"), "rationale": (filled, "what an error costs"),
}
OPTIONAL: dict[str, Rule] = {
    "aliases": (names, "a list of names"), "comparison": (lambda v: v in ("typed", "literal"), "typed or literal"), "date_order": (lambda v: v in (None, "dmy", "mdy"), "dmy or mdy"),
    "required": (truth, "true or false"), "requires": (names, "a list of fields"), "constraints": (lambda v: isinstance(v, dict), "an object"), "ontology_id": (lambda v: True, "an id"),
}
CONSTRAINTS = frozenset(("pattern", "enum", "minimum", "maximum"))


def demand(problems: Iterable[str]) -> None:
    if found := list(problems):
        raise ValueError("; ".join(found))


def limit(value: Any) -> Decimal | None:
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def constraint_problems(rules: dict, kind: str) -> Iterator[str]:
    if extra := set(rules) - CONSTRAINTS:
        yield f"unknown constraints {sorted(extra)}"
    if "pattern" in rules:
        try:
            re.compile(rules["pattern"])
        except (re.error, TypeError) as e:
            yield f"no pattern: {e}"
    if "enum" in rules and not (names(rules["enum"]) and rules["enum"]):
        yield "enum must list values"
    bounds = {k: limit(rules[k]) for k in ("minimum", "maximum") if k in rules}
    if bounds and kind not in ("amount", "number"):
        yield "bounds go with numbers"
    if None in bounds.values():
        yield "bounds must be finite numbers"
    elif len(bounds) == 2 and bounds["minimum"] > bounds["maximum"]:
        yield "minimum above maximum"


def field_problems(name: str, spec: Any, others: dict) -> Iterator[str]:
    if not filled(name) or not isinstance(spec, dict):
        yield "needs a name and an object"
        return
    if extra := set(spec) - set(NEEDED) - set(OPTIONAL):
        yield f"unknown settings {sorted(extra)}"
    for key, (sound, what) in {**NEEDED, **OPTIONAL}.items():
        if (key in spec or key in NEEDED) and not sound(spec.get(key)):
            yield f"{key} must be {what}"
    links = spec.get("requires", [])
    if names(links) and (len(set(links)) < len(links) or name in links or set(links) - set(others)):
        yield "requires must name other fields of the profile, each once"
    if isinstance(spec.get("constraints", {}), dict):
        yield from constraint_problems(spec.get("constraints", {}), spec.get("value_type"))


def profile_problems(spark: SparkSession, bundle: Any) -> list[str]:
    """What is wrong with a file of profiles. Values of enums and labels are read by the engine's own columns."""
    if not isinstance(bundle, dict) or type(bundle.get("schema_version")) is not int or bundle["schema_version"] != 1:
        return ["profiles need schema_version 1"]
    profiles = bundle.get("profiles")
    if not isinstance(profiles, dict) or not profiles:
        return ["there must be a profile"]
    found, enums, labels = [], [], []
    for name, profile in profiles.items():
        if not filled(name) or not isinstance(profile, dict):
            found.append(f"{name!r}: a profile needs a name and an object")
            continue
        put = lambda problem, name=name: found.append(f"{name}: {problem}")
        if profile.get("review_status") not in ("draft", "example", "reviewed"):
            put("review_status must be draft, example or reviewed")
        elif profile["review_status"] == "reviewed" and not filled(profile.get("reviewed_by")):
            put("reviewed_by is missing")
        if not names(profile.get("competency_questions")) or not profile["competency_questions"]:
            put("competency_questions must say what the profile is for")
        fields, keys = profile.get("fields"), profile.get("record_key_labels", list(RECORD_KEYS))
        if not names(keys) or not keys:
            put("record_key_labels must list labels")
            keys = []
        if not isinstance(fields, dict) or not fields:
            put("there must be a field")
            continue
        if not any(isinstance(s, dict) and s.get("critical") is True for s in fields.values()):
            put("there must be a critical field")
        wrong = [f"{f}: {p}" for f, s in fields.items() for p in field_problems(f, s, fields)]
        found += [f"{name}/{w}" for w in wrong]
        if not wrong:
            enums += [(f"{name}/{f}", f, s["value_type"], s.get("date_order"), s.get("comparison") == "literal", v) for f, s in fields.items() for v in s.get("constraints", {}).get("enum", [])]
            try:
                labels += [(name, label, True) for label in profile_labels(profile)] + [(name, k, False) for k in keys]
            except ValueError as e:
                put(str(e))
    if enums:
        rows = spark.createDataFrame(enums, "place string, field string, kind string, date_order string, literal boolean, value string")
        typed = rows.withColumn("t", canonical_value(F.col("value"), F.col("kind"), F.col("field"), F.col("date_order"), F.col("literal")))
        found += [f"{r['place']}: enum has {r['value']!r}: {r['error']}" for r in typed.where("t.error is not null").select("place", "value", "t.error").collect()]
    if labels:
        rows = spark.createDataFrame(labels, "profile string, label string, is_field boolean").withColumn("label", label_key(F.col("label")))
        both = rows.groupBy("profile", "label").agg(F.count_distinct("is_field").alias("n")).where("n > 1")
        found += [f"{r['profile']}: {r['label']!r} is a field's label and a record key's" for r in both.collect()]
    return found


def bundle_problems(bundle: Any) -> list[str]:
    """What is wrong with a saved bundle: its families, its panel, and whether its documents have the same methods with pages."""
    if not isinstance(bundle, dict):
        return ["a bundle is an object"]
    data, families, panel = (bundle.get(k) for k in ("data", "families", "panel"))
    if not isinstance(data, dict) or not data:
        return ["there must be a document"]
    if not isinstance(families, dict) or not families or not all(isinstance(v, list) and v and all(isinstance(f, str) and f for f in v) for v in families.values()):
        return ["every method needs names of families"]
    if not isinstance(panel, list) or not panel or not all(isinstance(m, str) for m in panel):
        return ["the panel must list methods"]
    found = []
    if len(set(panel)) < len(panel) or set(panel) - set(families):
        found.append("the panel must name known methods, each once")
    voters = [families[m] for m in panel if m in families]
    if any(len(v) != 1 for v in voters):
        found.append("a method of several families can't vote")
    if len({v[0] for v in voters}) < 2:
        found.append("the panel needs two families")
    paged = {}
    for document, methods in data.items():
        if not isinstance(methods, dict) or set(methods) != set(families):
            found.append(f"{document}: its methods aren't those of the families")
            continue
        for method, record in methods.items():
            if not isinstance(record, dict) or "pages" not in record:
                found.append(f"{document}/{method}: pages are missing (null for a text without pages)")
            elif record["pages"] is None:
                if not isinstance(record.get("document_text"), str):
                    found.append(f"{document}/{method}: document_text is missing")
            elif not isinstance(record["pages"], list) or not record["pages"]:
                found.append(f"{document}/{method}: there must be a page")
        paged[document] = frozenset(m for m, r in methods.items() if isinstance(r, dict) and r.get("pages") is not None)
    if len(set(paged.values())) > 1:
        found.append("a method must have pages in all documents or in none")
    elif any(set(panel) - p for p in paged.values()):
        found.append("the panel's methods must have pages")
    return found


#: What the settings of a scoring run may be.
SETTINGS: dict[str, Rule] = {
    "entity_weight": (lambda v: positive(v) and v >= 1, "finite and 1 or more"), "overlap_weight": (lambda v: (positive(v) or v == 0) and not isinstance(v, bool) and v <= 1, "from 0 to 1"),
    "context": (lambda v: type(v) is int and 1 <= v <= 128, "an integer from 1 to 128"), "mode": (lambda v: v in ("regions", "values", "mentions"), "regions, values or mentions"),
    "weighting": (lambda v: v in ("document", "page"), "document or page"),
}


def setting_problems(settings: dict) -> list[str]:
    """What is wrong with the settings of a scoring run."""
    return [f"{k} is no setting" for k in settings if k not in SETTINGS] + [f"{k} must be {SETTINGS[k][1]}" for k, v in settings.items() if k in SETTINGS and not SETTINGS[k][0](v)]


def address_problems(url: str) -> list[str]:
    """A service's address must be https, or http on this machine, without credentials, query or fragment."""
    parts = urlsplit(url)
    local = parts.scheme == "http" and parts.hostname in ("localhost", "127.0.0.1", "::1")
    found = [] if parts.scheme == "https" or local else ["use https, or http on this machine"]
    return found + ["no credentials, query or fragment"] * any((parts.username, parts.password, parts.query, parts.fragment))


def projected(pages: DataFrame, methods: list[str] | None = None, documents: list | None = None) -> DataFrame:
    """The pages of some methods and documents; names given twice are an error."""
    for column, wanted in (("method", methods), ("document", documents)):
        if wanted is not None:
            demand([f"{column}s are named twice: {wanted}"] * (len(set(wanted)) < len(wanted)))
            pages = pages.where(F.col(column).isin(list(wanted)))
    return pages
