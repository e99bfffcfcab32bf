"""What services send back: their texts without marks, and what is wrong with a model's reply. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE

#: Line ends, the marks of a block, and the types of images by suffix.
LINE_END = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}])"
HEADER = r"(?md)^<\|det\|>{kind}(?:[^\S\n]*\[[^\]\n]*\])?[^\S\n]*<\|/det\|>[^\S\n]*(.*)$"
IMAGES = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml"}
STATES = ("found", "unlocated", "ambiguous")
RESPONSE = "pages array<struct<markdown:string,tables:array<struct<id:string,content:string>>,images:array<struct<id:string,image_base64:string>>>>"
REPLY = "decisions array<struct<field_id:string,critical:boolean,status:string,reason:string,occurrences:array<struct<value:string,evidence:string,occurrence:int>>>>"
#: Noncharacters that stand for a block's head, and for the head of a block that shows an image.
BLOCK, PICTURE = "\ufdd1", "\ufdd0"
PAGE_BREAK = "\n\n---\n\n"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def without_grounding(text: Column) -> Column:
    """A text without boxes, references and the mark of its end."""
    for name in ("det", "ref"):
        text = F.regexp_replace(text, rf"(?s)<\|{name}\|>.*?<\|/{name}\|>", "")
    return stripped(F.replace(text, F.lit("<|endoftext|>"), F.lit("")))


def blocks_text(text: Column) -> Column:
    """The blocks of a text with a head before each, a blank line between; images go, and blank lines within blocks.

    A head becomes one mark that takes the line end before and behind it; an
    image's mark with nothing behind it opens no block.
    """
    lines = F.regexp_replace(F.regexp_replace(text, f"(?<!{SPACE}){SPACE}*{LINE_END}", "\n"), rf"^\n|(?<!{SPACE}){SPACE}+$", "")
    marked = F.regexp_replace(F.regexp_replace(lines, HEADER.replace("{kind}", "image"), PICTURE), HEADER.replace("{kind}", r"[^<\s]+"), f"{BLOCK}$1")
    either = f"[{PICTURE}{BLOCK}]"
    for pattern, put in ((rf"\n?({either})", "$1"), (rf"({either})\n", "$1"), (rf"{PICTURE}(?={either}|\z)", ""), (f"^{either}", ""), (either, "\n\n")):
        marked = F.regexp_replace(marked, pattern, put)
    return stripped(marked)


def response_text(response: Column) -> Column:
    """The pages of a service's answer as one Markdown text, with tables and images in their places."""

    def filled(text: Column, items: Column, put) -> Column:
        return F.aggregate(F.coalesce(items, F.array()), text, lambda t, x: F.coalesce(put(t, x), t))

    def table(text: Column, x: Column) -> Column:
        return F.when(x["id"] != "", F.replace(text, F.concat(F.lit("["), x["id"], F.lit("]("), x["id"], F.lit(")")), F.coalesce(x["content"], F.lit(""))))

    def image(text: Column, x: Column) -> Column:
        types = F.create_map(*[F.lit(v) for pair in IMAGES.items() for v in pair])
        kind = F.coalesce(F.try_element_at(types, F.lower(F.regexp_extract(x["id"], r"\.([^.]+)$", 1))), F.lit("image/jpeg"))
        data = F.when(x["image_base64"].startswith("data:"), x["image_base64"]).otherwise(F.concat(F.lit("data:"), kind, F.lit(";base64,"), x["image_base64"]))
        return F.when((x["id"] != "") & (x["image_base64"] != ""), F.replace(text, F.concat(F.lit("]("), x["id"], F.lit(")")), F.concat(F.lit("]("), data, F.lit(")"))))

    pages = F.coalesce(F.from_json(response, RESPONSE)["pages"], F.array())
    return F.array_join(F.transform(pages, lambda p: filled(filled(F.coalesce(p["markdown"], F.lit("")), p["tables"], table), p["images"], image)), PAGE_BREAK)


def reply_problem(reply: Column, allowed: Column) -> Column:
    """What is wrong with a model's reply on the fields ``allowed``, an array of ids; null if nothing is."""
    items = F.from_json(reply, REPLY)["decisions"]
    ids = F.transform(items, lambda d: d["field_id"])
    unknown = F.exists(items, lambda d: d.isNull() | d["field_id"].isNull() | d["critical"].isNull() | ~F.coalesce(F.array_contains(allowed, d["field_id"]), F.lit(False)))
    unsound = F.exists(items, lambda d: ~F.coalesce(d["status"].isin(*STATES) & (stripped(d["reason"]) != ""), F.lit(False)))
    unproven = F.exists(items, lambda d: d["occurrences"].isNull() | ((d["status"] == "found") != (F.size(d["occurrences"]) > 0)))
    return (
        F.when(items.isNull(), "no_decisions").when(unknown, "unknown_field").when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_field")
        .when(unsound, "unsound_status").when(unproven, "evidence_and_status_differ")
    )
