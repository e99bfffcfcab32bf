from pyspark.sql import functions as F

from quillspan.functions import decode, text
from quillspan.operators import alignment, consensus, panel


def pages(spark, texts, document=1, page=1):
    return spark.createDataFrame([(document, page, m, t, "complete") for m, t in texts.items()], "document long, page long, method string, text string, status string")


def ranks(spark, texts):
    scores = consensus.pair_scores(pages(spark, texts))
    rows = consensus.tolerant_rank(consensus.consensus(scores), "score", "method", 1e-12).collect()
    return {r["method"]: (r["rank"], round(100 * r["score"], 6)) for r in rows}


def test_ranking_of_two_equal_and_one_different(spark):
    assert ranks(spark, {"a": "alpha beta", "b": "alpha beta", "c": "gamma delta"}) == {"a": (1, 50.0), "b": (1, 50.0), "c": (3, 0.0)}


def test_empty_pairs_are_zero(spark):
    assert {s for _, s in ranks(spark, {"a": "invoice 00123", "b": "", "c": ""}).values()} == {0.0}


def test_accounting_parentheses_are_literal(spark):
    row = consensus.pair_scores(pages(spark, {"a": "amount (100.00)", "b": "amount 100.00"})).first()
    assert row["token_overlap"] < 1 and row["numeric_agreement"] == 0


def test_repeated_numbers(spark):
    made = consensus.pairs(consensus.signatures(pages(spark, {"a": "100 100 200", "b": "100 200"})))
    row = made.select(consensus.shared(F.col("l.numbers"), F.col("r.numbers")).alias("s"), consensus.beyond(F.col("l.numbers"), F.col("r.numbers")).alias("d")).first()
    assert 2 * row["s"] / 5 == 0.8 and row["d"] == ["100"]


def test_one_equal_token_is_full_agreement(spark):
    assert consensus.pair_scores(pages(spark, {"a": "same", "b": "same"})).first()["similarity"] == 1.0


def test_tokens(spark):
    df = spark.createDataFrame([("Straße −5% (1,000.50 ) 12:30 5-24be x_1",)], "t string")
    assert df.select(text.tokens(F.col("t")).alias("w")).first()["w"] == ["strasse", "-5%", "(1,000.50)", "12:30", "5", "24be", "x_1"]


def test_tolerance_chains(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.95), ("c", 0.9), ("d", 0.5), ("e", None)], "m string, s double")
    got = {r["m"]: r["rank"] for r in consensus.tolerant_rank(rows, "s", "m", 0.06).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 4, "e": 5}


def test_hyphens_need_corroboration(spark):
    for texts, want in ((["inter-\nnational", "international"], "international"), (["well-\nknown", "other"], "well- known")):
        got = alignment.repair_hyphens(pages(spark, dict(zip("ab", texts, strict=True)))).where("method = 'a'").first()
        assert got["text"] == want


def test_literal_markup_in_plain_text():
    raw = "Name <REDACTED> <p>literal</p> &lt;value&gt;"
    assert decode.flat_text(raw, "plain") == raw
    assert decode.flat_text("<p>a</p><x>b &amp; c", "html") == " a <x>b & c"
    assert decode.line_text("|a|b|\n|-|-|\n|1|2|", "markdown") == "a\tb\n\n1\t2"


def test_sequence_similarity_of_swapped_pages(spark):
    row = alignment.sequence_similarity(pages(spark, {"a": "one two three", "b": "one two three"})).first()
    assert row["sequence_similarity"] == 1.0


def test_hybrid_candidate_is_scored_by_other_families(spark):
    rows = [("a", "h", 1.0), ("b", "h", 1.0), ("c", "h", 0.2), ("d", "h", 0.4), ("e", "h", 0.9)]
    pairs = spark.createDataFrame([(1, 1, x, y, s) for x, y, s in rows], "document long, page long, left string, right string, similarity double")
    families = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "C"), ("e", "D"), ("h", "A"), ("h", "B")], "method string, family string")
    voters = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "C"), ("e", "D")], "method string, family string")
    got = {r["method"]: r["score"] for r in panel.panel_scores(pairs, families, voters).collect()}
    assert round(got["h"], 9) == 60.0


def test_family_sensitivity(spark):
    rows = [("a", "b", 0.2), ("a", "c", 0.6), ("b", "c", 0.5)]
    pairs = spark.createDataFrame([(1, 1, x, y, s) for x, y, s in rows], "document long, page long, left string, right string, token_overlap double")
    fam = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "method string, family string")
    got = {(r["excluded"], r["method"]): r["score"] for r in panel.family_sensitivity(pairs, fam).collect()}
    assert round(got[None, "a"], 9) == 40.0 and round(got["C", "a"], 9) == 20.0
    assert panel.complete_matrix(pairs, fam).count() == 0
    assert panel.complete_matrix(pairs.limit(2), fam).count() == 1
