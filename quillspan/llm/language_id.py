"""Operator 7: language identification by prediction by partial matching.

For each language a byte context tree is fitted to a bounded sample of labelled
documents; a text gets the language whose frozen tree codes it in the fewest
bits. Scoring is row-local, with the model as a broadcast variable whose size is
bounded by that of the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text
from .context_model import ContextModel

#: The bound of the sample: so many documents of a language are expected in it, of so many bytes each at most.
DOCS_PER_LANG, DOC_BYTES = 300, 65536
#: So many labels are learned, the most frequent ones; texts of the others get the nearest of these.
MOST_LABELS = 256
SCHEMA = "lang_pred string, score double, bits_per_byte double"
#: score is a posterior; the code lengths behind it are scaled to those of a text of so many bytes.
SCALE = 32


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text, so as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, label: str, text: str, where: Column, key: str, per_class: int, most_bytes: int) -> dict[str, list[bytes]]:
    """Whole texts by label: about ``per_class`` of each of the MOST_LABELS most frequent, chosen by a hash of ``key`` and the text, ``most_bytes`` each at most."""
    mine = docs.where(where & F.col(label).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= most_bytes)).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30)).alias("h")
    )
    counted = mine.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["label"]: r["n"] for r in counted.orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_class / n) * (1 << 30)))])
    rows = mine.where(F.col("h") < F.element_at(share, F.col("label"))).collect()
    out: dict[str, list[bytes]] = {k: [] for k in sizes}
    for r in sorted(rows, key=lambda r: (r["h"], r["text"])):
        out[r["label"]].append(r["text"].lower().encode("utf-8", "surrogatepass"))
    return {k: v for k, v in out.items() if v}


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", order: int = 4) -> ContextModel | None:
    """The model of the documents that aren't held out; None where none of them has a label and a text."""
    got = sample(docs, lang, text, ~held_out(id_col), id_col, DOCS_PER_LANG, DOC_BYTES)
    return ContextModel(got, order) if got else None


def identify(docs: DataFrame, model: ContextModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, then lang_pred, score (0 to 1) and bits_per_byte, for every row.

    ``und`` with score 0 goes to a null text, one without letters, and to all if
    there is no model. Ties go to the first label in order. Very long texts are
    coded in blocks of bounded memory, from start to end. Repeated rows get the same
    result each; an empty table gives no rows. Columns of ``keep`` may have the
    added names, which then get underscores. Extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        model = sent.value
        lang, score, rate = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
        if at:
            raw = [texts[i].lower().encode("utf-8", "surrogatepass") for i in at]
            size = np.array([len(x) for x in raw])
            bits = model.bits(raw)
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            chance = 1 / np.exp2(-(bits - least[:, None]) * np.minimum(1, SCALE / size)[:, None]).sum(axis=1)
            for i, b, c, r in zip(at, best, chance, least / size, strict=True):
                lang[i], score[i], rate[i] = model.classes[b], round(float(c), 6), round(float(r), 6)
        return [lang, score, rate]

    return per_text(docs, text, keep, SCHEMA, run)


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, then predict every row of ``docs``."""
    return identify(docs, train(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
