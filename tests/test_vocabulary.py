import itertools
import pickle
import random
import re

import numpy as np
import pytest

from quillspan.operators import alignment, extraction, regions
from quillspan.operators.discovery import located
from quillspan.operators.vocabulary import WORD, Vocabulary, compiled, mentions, weighted_overlap

ONTOLOGY = {"concepts": {"Account": {"name": "Account", "fields": ["IBAN", "Account Number"]}, "Trade": {"fields": ["Settlement Date", "Amount", "Currency"]}}}
ROOT = compiled(ONTOLOGY)


def test_weighted_overlap():
    assert weighted_overlap(["iban", "hello"], ["typo", "hello"], ROOT, 3.0)[0] == pytest.approx(1 / 3)
    assert weighted_overlap(["iban", "hello"], ["iban", "typo"], ROOT, 3.0)[0] == pytest.approx(3 / 4)


def test_longest_phrase_wins():
    words = "account number and settlement date and iban".split()
    assert mentions(words, ROOT) == {"account number": 1, "settlement date": 1, "iban": 1}


def test_phrases_are_found_as_by_scanning():
    """Leftmost and longest, word by word, against a scan that tries every phrase at every word."""
    rng = random.Random(6)
    for _ in range(300):
        names = {" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(5)}
        vocabulary = compiled({"concepts": {n: {} for n in names}})
        text = "".join(rng.choice("abc") + rng.choice(["", "", " ", "-", "; ", "_"]) for _ in range(14))
        words = list(WORD.finditer(text))
        want, i = [], 0
        while i < len(words):
            hits = [k for k in range(i + 1, len(words) + 1) if " ".join(m[0] for m in words[i:k]) in names and re.fullmatch(r"[a-c]+([ _-]+[a-c]+)*", text[words[i].start() : words[k - 1].end()])]
            if hits:
                want.append((words[i].start(), words[max(hits) - 1].end()))
            i = max(hits, default=i + 1)
        assert [x[:2] for x in pickle.loads(pickle.dumps(vocabulary)).found(text)] == want, (names, text)
    assert list(Vocabulary({}).found("a b")) == []


@pytest.fixture
def read(spark):
    def one(text):
        found, issues = extraction.read_pages(spark.createDataFrame([(1, text)], "unit long, text string"), ROOT, ["unit"])
        return found.orderBy("seq").collect(), issues.collect()

    return one


def test_inline_values_and_sections(read):
    found, _ = read("Amount: 100 Currency: USD")
    assert [(f["field"], f["value"], f["valid"]) for f in found] == [("Trade.Amount", '["100", "", null]', True), ("Trade.Currency", "USD", True)]
    found, _ = read("Amount: n/a")
    assert [(f["value"], f["valid"], f["error"]) for f in found] == [(None, False, "missing_value")]


def test_tables_bind_by_row_key(read):
    found, issues = read("Item\tAmount\tCurrency\nA1\t100\tUSD\nB2\t200\tEUR\nC3\t1")
    assert [(f["record"], f["field"], f["raw_value"]) for f in found] == [("a1", "Trade.Amount", "100"), ("a1", "Trade.Currency", "USD"), ("b2", "Trade.Amount", "200"), ("b2", "Trade.Currency", "EUR")]
    assert [i["reason"] for i in issues] == ["table_column_count"]


def test_label_then_value_on_the_next_line(read):
    assert [f["value"] for f in read("Settlement Date:\n2024-05-06")[0]] == ["2024-05-06"]


def test_words_in_prose_are_no_labels(read):
    assert read("the amount was settled in a currency of choice")[0] == []


def test_shapes_as_in_columns(spark):
    from pyspark.sql import functions as F

    from quillspan.functions import values
    from quillspan.functions.shapes import shaped

    texts = ["100", "EUR 5", "usd", "USDX", "-3;", "(7)", "March 3, 2020", "feb 30, 2021", "Sep 9,2021", "sept 9, 2021", "soon", "AB12 x", "A-1", "", "5 May"]
    rows = spark.createDataFrame([(t, k) for t in texts for k in ("number", "amount", "currency", "date", "identifier", "text")], "t string, k string")
    for r in rows.select("t", "k", F.coalesce(values.looks_like_value(F.col("t"), F.col("k"), F.lit(None).cast("string")), F.lit(False)).alias("s")).collect():
        assert shaped(r["t"], r["k"]) == r["s"], r


PAGE = "document long, method string, page long, text string"


def test_profile_extraction(spark):
    profile = {"fields": {"Amount": {"aliases": ["Total"]}, "Date": {}}, "record_key_labels": ["Order"]}

    def got(text):
        pages = spark.createDataFrame([(1, "m", 1, text)], PAGE)
        found = extraction.profile_predictions(pages, profile).orderBy("idx").collect()
        return [(r["field"], r["record"], r["value"], r["line"]) for r in found], [(r["line"], r["reason"]) for r in extraction.profile_issues(pages, profile).collect()]

    assert got("Order\tTotal\n7\t100\n\tx\n\nDate: 2024-01-01\nTotal =\n5") == ([("Amount", "7", "100", 2), ("Date", "document", "2024-01-01", 5), ("Amount", "document", "5", 6)], [(3, "invalid_table_row")])
    # A line without tabs ends a table; a value line may be no label, pair or table row, nor stand after a blank line.
    assert got("Order\tTotal\nplain\n7\t100\nTotal\n\n5\nDate\nTotal\n9\nDate\t2024") == ([("Amount", "document", "9", 8), ("Date", "document", "2024", 10)], [])
    assert got("x\tTotal\nDate\tTotal\nDate:\nTotal: 3") == ([("Date", "document", "", 3), ("Amount", "document", "3", 4)], [(1, "table_requires_record_key"), (2, "table_requires_record_key")])
    assert got("") == got(None) == ([], [])
    with pytest.raises(Exception, match="several key columns"):
        got("Order\tTotal\tOrder\n1\t2\t3")
    with pytest.raises(ValueError):
        extraction.profile_labels({"fields": {"A": {"aliases": ["x"]}, "B": {"aliases": ["x"]}}})


def test_hyphen_repair(spark):
    rows = [(1, "a", 1, "the trans-\nport of good-\r\n s, a non-\nword\u00a0x"), (1, "b", 1, "Transport of goods"), (2, "a", 1, "trans-\nport"), (2, "b", 1, None)]
    pages = spark.createDataFrame(rows, PAGE)
    got = {(r["document"], r["method"]): r["text"] for r in alignment.repair_hyphens(pages).collect()}
    assert got == {(1, "a"): "the transport of goods, a non- word x", (1, "b"): "Transport of goods", (2, "a"): "trans- port", (2, "b"): ""}


def test_assignment_is_optimal():
    rng = random.Random(14)
    for _ in range(200):
        r, c = rng.randint(1, 5), rng.randint(1, 5)
        w = np.array([[rng.choice([0, rng.random()]) for _ in range(c)] for _ in range(r)])
        got = sum(w[i, j] for i, j in regions.assignment(w))
        pad = np.zeros((max(r, c), max(r, c)))
        pad[:r, :c] = w
        best = max(sum(pad[i, p[i]] for i in range(len(pad))) for p in itertools.permutations(range(len(pad))))
        assert got == pytest.approx(best)


def test_region_weights_are_shared():
    text = "one two iban three four iban five six account seven"
    found, selected = regions.regions(text, ROOT, 2)
    total = np.zeros(len(regions.spans(text, ROOT)[0]))
    for r in found:
        total[r.start : r.end] += r.weights
    assert set(np.round(total[total > 0], 9)) == {1.0} and int((total > 0).sum()) == selected


def test_region_agreement():
    a = regions.regions("pay to iban 123 now please", ROOT)
    assert regions.agreement(a, a)["agreement"] == pytest.approx(1.0)
    assert regions.agreement(a, regions.regions("nothing here", ROOT))["agreement"] == 0.0


def test_evidence_spans():
    assert located("x € 00123 and 00123", "and 00123", "00123", 1) == (14, 19)
    assert located("a 00123", "a 00123", "123x", 1) is None
