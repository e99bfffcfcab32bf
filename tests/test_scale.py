"""What lets queries grow: no table is broadcast for the size of the file behind it, no step is done twice, batches stay small."""

import random
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from quillspan.functions import values
from quillspan.operators import alignment, benchmark, corroboration, discovery, extraction
from quillspan.plans import registry
from quillspan.sources import fixtures

DIR = "/root/testdata/sf0.001"

VALUES = "unit long, field string, record string, occurrence int, value_type string, value string, valid boolean"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_compared_without_joins(spark):
    """Nulls are values of their place, invalid values and issues only count in the total, repeated values meet as often as both sides have them."""
    row = lambda unit, field, value, valid=True, record=None: (unit, field, record, 1, "text", value, valid)
    left = spark.createDataFrame([row(1, "A", "x"), row(1, "A", "x"), row(1, "B", None, False), row(2, "A", "y", True, "r"), row(3, "C", "z")], VALUES)
    right = spark.createDataFrame([row(1, "A", "x"), row(1, "B", None, False), row(2, "A", "y", True, "r"), row(2, "A", "y")], VALUES)
    issues = spark.createDataFrame([(2, 3), (4, 1)], "unit long, n long")
    made = extraction.value_agreement(left, right, issues, ["unit"])
    assert sorted(tuple(r) for r in made.collect()) == [(1, 5, 1, 0.4), (2, 6, 1, 2 / 6), (3, 1, 0, 0.0), (4, 1, 0, 0.0)]
    fields = extraction.field_agreement(left, right)
    assert sorted(tuple(r) for r in fields.collect()) == [("A", 3, 3, 2, 2 / 3), ("B", 1, 1, 0, 0.0), ("C", 1, 0, 0, 0.0)]
    assert "Join" not in plan(made) and "Join" not in plan(fields)


def test_backend_text_of_indented_documents(spark, tmp_path):
    texts = ["  first line\n second  ", "\t\n \n\tx\r\n\r\ny", " ", None, "", "plain\n\n  more", "\u3000wide", "\x1fx\x85 y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rel = duckdb.connect().execute(f"WITH documents AS (FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')), {registry.oracle_sql()['f23_backend_text'].removeprefix('WITH ')}")
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r) for r in registry.queries()["f23_backend_text"](spark, str(tmp_path)).select(names).collect()) == want


def joins(df):
    return [line for line in plan(df).splitlines() if "Join " in line]


def test_fields_are_dealt_once_and_joined_with_short_lists_only(spark):
    """Every reference and prediction moves once, by its record; only the profile and rules are joined, by broadcast."""
    refs, preds, profile = fixtures.references(spark, DIR), fixtures.predictions(spark, DIR), fixtures.profile(spark)
    rules = spark.createDataFrame([("Amount", True, None, None, 1000.0, 400000.0)], "field string, required boolean, pattern string, enum array<string>, minimum double, maximum double")
    counts, matched = benchmark.counters(refs, preds, profile), benchmark.matches(refs, preds, profile)
    for df in (counts, matched, benchmark.relations(matched), benchmark.violations(preds, profile, rules, refs), registry.queries()["j25_page_routing"](spark, DIR)):
        assert plan(df).count("RepartitionByExpression") <= 1 and all("strategy=broadcast" in j for j in joins(df))
    assert all("strategy=broadcast" in j or "strategy=merge" in j for j in joins(benchmark.extras(refs, preds, profile)))


def test_null_keys_and_methods_meet_nothing(spark):
    refs = spark.createDataFrame([(1, None, "A", "present", "x", 1, None), (1, 2, "A", "present", "x", 1, None), (1, 2, "B", "unreadable", None, 1, None)], "document long, record long, field string, status string, value string, page long, bbox array<double>")
    rows = [("m", 1, 0, None, "A", "x"), (None, 1, 1, 2, "A", "x"), ("m", 1, 2, 2, "B", "?"), ("m", 1, 3, 2, "C", "y"), ("m", 1, 4, None, "A", "x")]
    preds = spark.createDataFrame([(*r, 1, None) for r in rows], "method string, document long, idx long, record long, field string, value string, page long, bbox array<double>")
    profile = spark.createDataFrame([("A", 1.0, True, "text", []), ("B", 1.0, True, "text", [])], "field string, weight double, critical boolean, kind string, requires array<string>")
    assert sorted(tuple(r) for r in benchmark.matches(refs, preds, profile).select(F.coalesce("record", F.lit(0)), "method", "reason").collect()) == [(0, "m", "missing"), (2, "m", "missing")]
    extra = benchmark.extras(refs, preds, profile).collect()
    assert sorted((r["idx"], r["reason"], r["unknown_field"]) for r in extra) == [(0, "wrong_record", False), (1, "duplicate", False), (3, "extra", True), (4, "wrong_record", False)]
    made = {(r["method"], r["field"]): r for r in benchmark.counters(refs, preds, profile).collect()}
    assert [made["m", "A"][c] for c in ("reference_fields", "predicted_fields", "extra_fields", "missing_fields")] == [2, 2, 2, 2]
    assert [made["m", "B"][c] for c in ("reference_fields", "predicted_fields", "ignored_unreadable_predictions", "unreadable_fields")] == [0, 0, 1, 1]
    assert (made["m", None]["eligible_documents"], made["m", None]["eligible_records"], made["m", "C"]["extra_fields"], made[None, "A"]["extra_fields"]) == (0, 1, 1, 1)


def test_alignment_is_that_of_difflib():
    draw = random.Random(7)
    for n in range(400):
        words = "abcdefghijklmnop"[: draw.choice((1, 2, 4, 16))]
        a = [draw.choice(words) for _ in range(draw.randrange(30))]
        b = [w for w in a if draw.random() < 0.8] if n % 2 else [draw.choice(words) for _ in range(draw.randrange(30))]
        x, y = alignment.lettered([a, b])
        want = SequenceMatcher(None, a, b, autojunk=False)
        assert isinstance(x, str) and alignment.opcodes(x, y) == want.get_opcodes() and alignment.aligned(x, y).ratio() == want.ratio()
        back = SequenceMatcher(None, b, a, autojunk=False)
        assert alignment.similarity(x, y) == ((want.ratio() + back.ratio()) / 2 if a or b else 0.0)


def test_passages_are_read_once_and_folded_within_their_rows(spark):
    """The summary needs the passages' rows once, and nothing but short lists is joined."""
    found, rolled, summary = corroboration.corroborate(fixtures.pages(spark, DIR), fixtures.families(spark), fixtures.panel(spark))
    for df in (found, rolled, summary):
        assert plan(df).count("MapInArrow") == 1 and all("strategy=broadcast" in j for j in joins(df))
    states = corroboration.family_states(corroboration.passage_evidence(fixtures.pages(spark, DIR), list(fixtures.PANEL)), fixtures.panel(spark))
    assert all("strategy=broadcast" in j for j in joins(states))


def test_edit_distance_of_long_texts(spark):
    """Near texts, texts that differ in length only, and texts of nothing in common: what the whole table says, null for null."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("aeinrté ü😀") for _ in range(draw.randrange(1, 9)))
    pairs = [(None, "a"), ("a", None), ("", ""), ("", "x" * 90), ("x" * 40, "y" * 300), ("x" * 200, "y" * 200)]
    for n in range(150):
        a = [word() for _ in range(draw.randrange(60))]
        b = [w for w in a if draw.random() < 0.9] if n % 3 == 0 else [w.replace("n", "m") for w in a] if n % 3 == 1 else [word() for _ in range(draw.randrange(60))]
        pairs.append((" ".join(a), " ".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select(values.long_edit_distance(F.col("a"), F.col("b")).alias("got"), values.edit_distance(F.col("a"), F.col("b")).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_shortlists_are_counted_within_a_block(spark):
    """Ties go by id, rows of one block count together, a block without words gets the least ids, and no pair of block and schema is grouped."""
    blocks = spark.createDataFrame([(1, "alpha beta beta"), (1, "Gamma"), (2, None), (3, "delta alpha")], "block_id long, text string")
    schemas = spark.createDataFrame([("a", "none of it"), ("b", "gamma beta"), ("c", "alpha delta"), ("d", "alpha"), ("e", None)], "schema_id string, text string")
    made = discovery.shortlist(blocks, schemas, 3)
    want = {1: [("b", 2), ("c", 1), ("d", 1)], 2: [("a", 0), ("b", 0), ("c", 0)], 3: [("c", 2), ("d", 1), ("a", 0)]}
    assert sorted(tuple(r) for r in made.collect()) == sorted((b, s, n, i) for b, x in want.items() for i, (s, n) in enumerate(x, 1))
    assert plan(made).count("Aggregate") == 1 and not joins(made)
