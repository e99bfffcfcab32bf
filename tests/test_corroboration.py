import pytest

from quillspan.operators import corroboration as K


def inputs(spark, texts, families, status=None):
    status = status or {}
    pages = spark.createDataFrame([(1, 1, m, t, status.get(m, "complete")) for m, t in texts.items()], "document long, page long, method string, text string, status string")
    fam = spark.createDataFrame(list(families.items()), "method string, family string")
    return pages, fam


def run(spark, texts, families, status=None, **policy):
    pages, fam = inputs(spark, texts, families, status)
    found, rolled, summary = K.corroborate(pages, fam, fam, **policy)
    return found.orderBy("method", "passage").collect(), rolled.collect(), summary.first()


def test_three_families(spark):
    rows, _, summary = run(spark, dict.fromkeys("abc", "Account 001\nAmount 900"), {"a": "A", "b": "B", "c": "C"})
    mine = [r for r in rows if r["method"] == "a"]
    assert len(mine) == 2 and all(r["supporting_family_count"] == 3 and r["other_family_support_count"] == 2 for r in mine)
    assert (mine[1]["token_start"], mine[1]["token_end"]) == (2, 4) and summary["corroborated"] == 6


def test_conflict_is_flagged_but_corroborated(spark):
    rows, _, _ = run(spark, {"a": "Amount 900", "b": "Amount 900", "c": "Amount 900", "d": "Amount 100"}, dict(zip("abcd", "ABCD", strict=True)))
    a = rows[0]
    assert a["supporting_family_count"] == 3 and a["required_family_count"] == 2 and a["status"] == "corroborated" and a["flags"] == ["conflicting_readings"]


def test_failed_and_truncated_stay_in_the_denominator(spark):
    rows, _, _ = run(spark, dict.fromkeys("abcdef", "Amount 900"), dict(zip("abcdef", "ABCDEF", strict=True)), {"e": "failed", "f": "truncated"}, min_fraction=0.5)
    assert rows[0]["supporting_family_count"] == 4 and rows[0]["total_family_count"] == 6 and rows[0]["required_family_count"] == 3


def test_repeats_are_ambiguous(spark):
    rows, _, _ = run(spark, dict.fromkeys("abc", "same " * 50), {"a": "A", "b": "B", "c": "C"}, passage_tokens=3)
    sixth = next(r for r in rows if r["method"] == "a" and r["passage"] == 6)
    assert sixth["ambiguous_families"] == ["B", "C"] and sixth["status"] == "uncertain"


def test_all_empty(spark):
    rows, rolled, summary = run(spark, dict.fromkeys("abc", ""), {"a": "A", "b": "B", "c": "C"})
    assert rows == [] and summary["empty_page_outputs"] == 3
    assert all(r["status"] == "uncertain" and r["uncertainty_reasons"] == ["no_text_returned"] for r in rolled)


def test_policy():
    for bad in ({"min_families": 1}, {"min_families": True}, {"min_fraction": 2}, {"passage_tokens": 0}):
        with pytest.raises(ValueError):
            K.check_policy(**{"min_families": 2, "min_fraction": 0.0, "passage_tokens": 40} | bad)


def test_hybrids_cannot_vote(spark):
    pages, _ = inputs(spark, dict.fromkeys("ab", "x"), {"a": "A", "b": "B"})
    fam = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "B")], "method string, family string")
    with pytest.raises(ValueError):
        K.corroborate(pages, fam, spark.createDataFrame([("a", "A"), ("b", "B")], "method string, family string"))
