"""A transcription panel derived from the shipped tables.

The tables hold no competing transcriptions, so one is made of ``conversations``:
a conversation is a document, a turn a page, and five methods write it down, four
of them with fixed, different mistakes. References and predictions of field
values come from ``orders`` in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("alpha", "beta", "delta", "epsilon", "gamma")
FAMILIES = {"alpha": ("A",), "beta": ("B",), "gamma": ("C",), "delta": ("A",), "epsilon": ("A", "B")}
PANEL = ("alpha", "beta", "delta", "gamma")
#: Weight, critical, type of each field of the orders profile; an amount requires its status.
FIELDS = {
    "Amount": (5.0, True, "amount", ("Status",)),
    "Date": (2.0, True, "date", ()),
    "Priority": (1.0, False, "text", ()),
    "Status": (1.0, True, "identifier", ()),
}
PREDICTORS = {"plain": "X", "noisy": "Y"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_every(words: Column, n: int) -> Column:
    return F.filter(words, lambda _, i: (i + 1) % n != 0)


def swapped(words: Column) -> Column:
    """Words 3 and 4 exchanged, where there are four."""
    return F.when(
        F.size(words) >= 4,
        F.concat(F.slice(words, 1, 2), F.slice(words, 4, 1), F.slice(words, 3, 1), F.slice(words, F.lit(5), F.size(words))),
    ).otherwise(words)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, page, method, text, status): the panel's pages, one row each. Narrow: each turn makes its five rows in place."""
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), (F.col("turn") + 1).alias("page"), "text")
    words = F.split("text", " ")
    beta = F.array_join(without_every(words, 7), " ")
    versions = {
        "alpha": F.col("text"),
        "beta": beta,
        "delta": F.upper(F.replace(F.array_join(swapped(words), " "), F.lit("ß"), F.lit("ss"))),
        "epsilon": F.when(F.col("page") % 2 == 1, F.col("text")).otherwise(beta),
        "gamma": F.replace(F.col("text"), F.lit("en"), F.lit("em")),
    }
    failed = (F.col("document") % 10 == 0) & (F.col("page") == 1)
    cut = (F.col("document") % 15 == 0) & (F.col("page") == 2)
    status = {"gamma": F.when(failed, "failed").otherwise("complete"), "beta": F.when(cut, "truncated").otherwise("complete")}
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("method"),
            (F.when(failed, "").otherwise(x) if m == "gamma" else x).alias("text"),
            status.get(m, F.lit("complete")).alias("status"),
        )
        for m, x in versions.items()
    ])
    return talk.select("document", "page", F.inline(rows))


def families(spark: SparkSession) -> DataFrame:
    """(method, family): a row for each family of a method; five methods, so tiny."""
    return spark.createDataFrame([(m, f) for m, fs in FAMILIES.items() for f in fs], "method string, family string")


def panel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, FAMILIES[m][0]) for m in PANEL], "method string, family string")


def profile(spark: SparkSession) -> DataFrame:
    """(field, weight, critical, kind, requires): the orders profile."""
    return spark.createDataFrame([(f, *v) for f, v in FIELDS.items()], "field string, weight double, critical boolean, kind string, requires array<string>")


def cents(price: Column) -> Column:
    """A price as digits, a dot and two digits, from whole cents, so that every engine prints the same."""
    whole = F.round(price * 100).cast("long")
    return F.concat(F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def box(key: Column, field: int) -> Column:
    """A box in tenths of the page, made of the order's number."""
    left, top = (key % 5) / 10, F.lit(field / 10)
    return F.array(left.cast("double"), top.cast("double"), (left + 0.3).cast("double"), (top + 0.1).cast("double"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, record, field, status, value, page, bbox, template_id, split): four annotated fields for each order."""
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("document"), F.col("o_orderkey").alias("record"),
        F.struct(cents(F.col("o_totalprice")).alias("Amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
                 F.col("o_orderpriority").alias("Priority"), F.col("o_orderstatus").alias("Status")).alias("v"),
    )
    state = F.when(F.col("record") % 23 == 0, "unreadable").when(F.col("record") % 29 == 0, "absent").otherwise("present")
    rows = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            (state if f == "Priority" else F.lit("present")).alias("status"),
            F.col(f"v.{f}").alias("value"),
            box(F.col("record"), i).alias("bbox"),
        )
        for i, f in enumerate(FIELDS)
    ])
    out = orders.select("document", "record", F.inline(rows))
    return out.select(
        "document", "record", "field", "status", F.when(F.col("status") == "present", F.col("value")).alias("value"),
        (F.col("record") % 3 + 1).alias("page"), "bbox", (F.col("document") % 10).alias("template_id"),
        F.when(F.col("document") % 10 < 6, "test").when(F.col("document") % 10 < 8, "train").otherwise("validation").alias("split"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, document, idx, record, field, value, page, bbox): ``plain`` copies the references, ``noisy`` errs by rule.

    ``idx`` is the place in the document's list; of several candidates the least counts first.
    """
    ref = references(spark, sf_dir).where("status <> 'absent'").withColumn("value", F.coalesce("value", F.lit("?")))
    place = F.create_map(*[F.lit(x) for i, f in enumerate(FIELDS) for x in (f, i)])
    base = ref.select("document", "record", "field", "value", "page", "bbox", (F.col("record") * 100 + F.element_at(place, F.col("field")) * 10).alias("idx"))
    key, amount = F.col("record"), F.col("field") == "Amount"
    wrong = F.when(amount & (key % 7 == 0), F.concat(F.lit("9"), F.col("value"))).when((F.col("field") == "Date") & (key % 19 == 0), "  ").otherwise(F.col("value"))
    kept = base.where(~((F.col("field") == "Status") & (key % 11 == 0)))
    noisy = kept.select(
        "document", F.when(amount & (key % 17 == 0), key + 1).otherwise(key).alias("record"), "field", wrong.alias("value"),
        F.when(key % 13 == 5, F.col("page") + 1).otherwise(F.col("page")).alias("page"),
        F.when(key % 5 == 1, F.transform("bbox", lambda x: x * 0.5)).otherwise(F.col("bbox")).alias("bbox"), "idx",
    )
    twice = base.where(amount & (key % 13 == 0)).withColumn("idx", F.col("idx") + 1).withColumn("value", F.concat(F.lit("1"), F.col("value")))
    columns = ["document", "idx", "record", "field", "value", "page", "bbox"]
    return base.select(F.lit("plain").alias("method"), *columns).union(noisy.union(twice.select(noisy.columns)).select(F.lit("noisy").alias("method"), *columns))
