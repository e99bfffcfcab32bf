from pyspark.sql import functions as F

from quillspan.functions import values
from quillspan.operators import benchmark as B

REF = "document long, record long, field string, status string, value string, page long, bbox array<double>, template_id long, split string"
PRED = "method string, document long, idx long, record long, field string, value string, page long, bbox array<double>"
TRUTH = {"Amount": "100", "Currency": "USD", "Account": "001"}


def refs(spark, status=None):
    status = status or {}
    return spark.createDataFrame([(1, 1, f, status.get(f, "present"), v if status.get(f, "present") == "present" else None, 1, [0.0, 0.0, 0.5, 0.5], 1, "test") for f, v in TRUTH.items()], REF)


def preds(spark, rows):
    return spark.createDataFrame([("m", 1, i, r, f, v, 1, [0.0, 0.0, 0.5, 0.5]) for i, (r, f, v) in enumerate(rows)], PRED)


def profile(spark, currency_critical=True):
    rows = [("Amount", 5.0, True, "amount", ["Currency"]), ("Currency", 1.0, currency_critical, "currency", []), ("Account", 1.0, currency_critical, "identifier", [])]
    return spark.createDataFrame(rows, "field string, weight double, critical boolean, kind string, requires array<string>")


def total(spark, rows, status=None, **kw):
    counts = B.counters(refs(spark, status), preds(spark, rows), profile(spark, **kw))
    return B.ratios(counts.groupBy("method").agg(*[F.sum(c).alias(c) for c in B.COUNTERS if c in counts.columns])).first()


GOOD = [(1, f, v) for f, v in TRUTH.items()]


def test_all_right(spark):
    t = total(spark, GOOD)
    assert t["weighted_critical_field_accuracy"] == 1 and t["correct_documents"] == t["eligible_documents"] == 1 and t["relationship_accuracy"] == 1


def test_wrong_amount(spark):
    t = total(spark, [(1, "Amount", "999"), *GOOD[1:]])
    assert round(t["weighted_critical_field_accuracy"], 9) == round(2 / 7, 9) and t["wrong_values"] == 1 and t["correct_relationships"] == 0 and t["correct_documents"] == 0


def test_duplicate_gets_no_credit(spark):
    t = total(spark, [GOOD[0], *GOOD])
    assert round(t["weighted_critical_field_accuracy"], 9) == round(2 / 7, 9) and t["extra_fields"] == 1 and t["value_precision"] == 0.5


def test_wrong_record(spark):
    r, p = refs(spark), preds(spark, [(2, "Amount", "100"), *GOOD[1:]])
    extra = B.extras(r, p, profile(spark), B.matches(r, p, profile(spark))).collect()
    assert [x["reason"] for x in extra] == ["wrong_record"]
    assert total(spark, [(2, "Amount", "100"), *GOOD[1:]])["missing_fields"] == 1


def test_wrong_currency_breaks_the_amount(spark):
    t = total(spark, [GOOD[0], (1, "Currency", "EUR"), GOOD[2]], currency_critical=True)
    assert t["correct_values"] == 2 and round(t["weighted_critical_field_accuracy"], 9) == round(1 / 7, 9)


def test_unreadable(spark):
    t = total(spark, GOOD, {"Currency": "unreadable"})
    assert t["ignored_unreadable_predictions"] == 1 and t["eligible_documents"] == 0 and t["all_critical_fields_correct_document_rate"] is None


def test_blank_is_missing_and_extra(spark):
    t = total(spark, [(1, "Amount", " "), (1, "Currency", "US1"), GOOD[2]])
    assert (t["missing_fields"], t["wrong_values"], t["correct_values"], t["extra_fields"]) == (1, 1, 1, 1)


def canon(spark, value, kind, name="x", order=None):
    df = spark.createDataFrame([(value,)], "v string")
    return tuple(df.select(values.typed_value(F.col("v"), F.lit(kind), F.lit(name), F.lit(order).cast("string")).alias("t")).first()["t"])


def test_typed_values(spark):
    long = "123456789012345678901234567890123456789"
    cases = {
        (f"({long})", "amount"): f'["-{long}", "", null]', (f"-{long}", "amount"): f'["-{long}", "", null]', ("USD 1,000.50", "amount"): '["1000.5", "", "USD"]', ("7 eur", "amount"): '["7", "", "EUR"]',
        ("1,00", "number"): "invalid_number", ("(5", "number"): "invalid_number", ("007", "number"): '["7", "", null]', ("5‰", "number"): r'["5", "\u2030", null]', ("12.50%", "number"): '["12.5", "%", null]', ("-0.0", "number"): '["0", "", null]',
        ("gb 12 ab", "identifier", "IBAN"): "GB12AB", ("gb 12 ab", "identifier"): "gb 12 ab", ("usd", "currency"): "USD", ("usdx", "currency"): "invalid_currency",
        ("2026-02-30", "date"): "invalid_date", ("3/4/2024", "date"): "ambiguous_date", ("3/4/2024", "date", "x", "dmy"): "2024-04-03", ("3/4/2024", "date", "x", "mdy"): "2024-03-04", ("13/4/2024", "date"): "2024-04-13",
        ("4/4/2024", "date"): "2024-04-04", ("2024/1/5", "date"): "2024-01-05", ("March 5,2024", "date"): "2024-03-05", ("5 march 2024", "date"): "2024-03-05", ("n/a", "text"): "missing_value", ("A  b", "text"): "a b", ("Straße", "text"): "strasse",
    }
    for given, want in cases.items():
        value, error = canon(spark, *given)
        assert want in (value, error) and (value is None) == (error is not None), given


def test_edit_distance_and_boxes(spark):
    df = spark.createDataFrame([("kitten", "sitting", [0.0, 0.0, 0.5, 0.5], [0.25, 0.0, 0.75, 0.5])], "a string, b string, x array<double>, y array<double>")
    row = df.select(values.edit_distance(F.col("a"), F.col("b")).alias("d"), values.iou(F.lit(1), F.col("x"), F.lit(1), F.col("y")).alias("i"), values.iou(F.lit(1), F.col("x"), F.lit(2), F.col("y")).alias("o"), values.box_valid(F.array(F.lit(0.5), F.lit(0.0), F.lit(0.4), F.lit(1.0))).alias("v")).first()
    assert row["d"] == 3 and round(row["i"], 9) == round(1 / 3, 9) and row["o"] == 0 and row["v"] is False
