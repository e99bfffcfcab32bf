import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import sinks
from quillspan.sources import checks, json_io
from quillspan.streaming import resume


def test_strict_json():
    assert json_io.strict_json('﻿{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            json_io.strict_json(bad)


def test_bundle(spark, tmp_path):
    bundle = {"data": {"d": {"a": {"pages": ["x", "y"], "statuses": ["complete", "failed"]}, "b": {"pages": None, "document_text": "z"}, "c": {"pages": ["v"]}}}, "families": {"a": ["A"], "b": ["B"], "c": ["C"]}, "panel": ["a", "c"]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    pages, families, panel = json_io.read_bundle(spark, str(tmp_path / "b.json"))
    rows = {(r["method"], r["page"]): (r["text"], r["status"]) for r in pages.collect()}
    assert rows == {("a", 1): ("x", "complete"), ("a", 2): ("y", "failed"), ("b", None): ("z", "complete"), ("c", 1): ("v", "complete")}
    assert families.count() == 3 and {r["family"] for r in panel.collect()} == {"A", "C"}
    (tmp_path / "b.json").write_text(json.dumps(bundle | {"panel": ["a"]}))
    with pytest.raises(Exception, match="two families"):
        json_io.read_bundle(spark, str(tmp_path / "b.json"))[1].count()
    (tmp_path / "b.json").write_text(json.dumps(bundle).replace('"panel"', '"families"', 1))
    with pytest.raises(Exception, match="repeated key"):
        json_io.read_bundle(spark, str(tmp_path / "b.json"))[1].count()


def test_bundle_problems():
    one = {"a": {"pages": ["x"]}, "b": {"pages": ["y"]}}
    good = {"data": {"d": one, "e": one}, "families": {"a": ["A"], "b": ["B"]}, "panel": ["a", "b"]}
    assert checks.bundle_problems(good) == []
    for change, said in (
        ({"data": {}}, "a document"), ({"families": {"a": [], "b": ["B"]}}, "families"), ({"panel": ["a", "a"]}, "each once"), ({"panel": ["a", "z"]}, "known methods"), ({"panel": "ab"}, "list methods"),
        ({"families": {"a": ["A", "B"], "b": ["B"]}}, "can't vote"), ({"families": {"a": ["A"], "b": ["A"]}}, "two families"), ({"data": {"d": {"a": {"pages": ["x"]}}}}, "aren't those"),
        ({"data": {"d": one, "e": one | {"b": {"pages": None, "document_text": "t"}}}}, "all documents or in none"), ({"data": {"d": one | {"b": {"pages": None}}}}, "document_text"), ({"data": {"d": one | {"b": {"pages": []}}}}, "a page"),
        ({"data": {"d": one | {"b": {}}}}, "pages are missing"), ({"data": {"d": one | {"b": {"pages": None, "document_text": "t"}}}}, "must have pages"),
    ):
        assert any(said in p for p in checks.bundle_problems(good | change)), (change, said)


def test_profile_problems(spark):
    field = {"value_type": "amount", "critical": True, "weight": 2, "rationale": "costs money"}

    def said(fields=None, schema_version=1, **profile):
        whole = {"review_status": "draft", "competency_questions": ["what is owed?"], "fields": fields or {"Total": field}} | profile
        return " ".join(checks.profile_problems(spark, {"schema_version": schema_version, "profiles": {"p": whole}}))

    assert said() == "" and said({"Total": field, "Due": field | {"value_type": "date", "requires": ["Total"], "constraints": {"enum": ["2024-01-05"]}}}) == ""
    for problem, words in (
        (said(schema_version=True), "schema_version"), (said(review_status="done"), "review_status"), (said(review_status="reviewed"), "reviewed_by"), (said(competency_questions=[]), "competency_questions"),
        (said({"Total": field | {"critical": False}}), "a critical field"), (said({"Total": field | {"colour": 1}}), "colour"), (said({"Total": field | {"value_type": "money"}}), "value_type"), (said({"Total": field | {"weight": True}}), "weight"),
        (said({"Total": field | {"weight": float("inf")}}), "weight"), (said({"Total": field | {"rationale": " "}}), "rationale"), (said({"Total": field | {"aliases": [""]}}), "aliases"), (said({"Total": field | {"requires": ["Total"]}}), "requires"),
        (said({"Total": field | {"constraints": {"pattern": "("}}}), "pattern"), (said({"Total": field | {"constraints": {"enum": ["x"]}}}), "invalid_number"), (said({"Total": field | {"constraints": {"minimum": 2, "maximum": 1}}}), "minimum"),
        (said({"Total": field | {"constraints": {"minimum": "NaN"}}}), "finite"), (said({"Due": field | {"value_type": "date", "constraints": {"minimum": 1}}}), "numbers"), (said({"Item": field}), "record key"),
        (said({"Total": field, "Sum": field | {"aliases": ["total"]}}), "two fields"), (said(record_key_labels=[]), "record_key_labels"),
    ):
        assert words in problem, (problem, words)
    with pytest.raises(ValueError, match="schema_version"):
        checks.demand(checks.profile_problems(spark, []))


def test_addresses_and_selections(spark):
    assert checks.address_problems("https://a.example/v1") == checks.address_problems("http://localhost:8000") == []
    for bad in ("http://a.example", "ftp://localhost", "https://u:p@a.example", "https://a.example/?k=1", "https://a.example/#x"):
        assert checks.address_problems(bad)
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "document long, method string")
    assert checks.projected(pages, ["a"], [1]).count() == 1 and checks.projected(pages).count() == 3
    with pytest.raises(ValueError):
        checks.projected(pages, ["a", "a"])


def test_page_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t")
    (tmp_path / "b.json").write_text('{"lines": ["p", {"text": "q"}]}')
    (tmp_path / "c.bin").write_text("no")
    rows = {r["path"].rsplit("/", 1)[1]: (r["text"], r["input_format"]) for r in json_io.read_pages(spark, str(tmp_path / "[ab].*")).collect()}
    assert rows == {"a.md": ("# t", "markdown"), "b.json": ("p\nq", "plain")}
    with pytest.raises(Exception, match="not a file of"):
        json_io.read_pages(spark, str(tmp_path)).collect()
    for value, want in (
        ("s", ("s", "markdown")), ([{"content": "a"}, {"content": None}], ("a\n", "markdown")), ({"pages": [{"text": "t"}]}, ("t", "plain")), ({"full_page_text": ["m"], "input_format": "html"}, ("m", "markdown")),
        ({"markdown": "x [t1](t1) [t2](u)", "tables": [{"id": "t1", "content": "|a|"}]}, ("x |a| [t2](u)", "markdown")), ({"lines": ["a", {"text": "b"}, {"lines": ["c"]}]}, ("a\nb\nc", "plain")),
    ):
        assert json_io.page_from_json(value) == want
    for bad in ({"pages": ["a", "b"]}, {"pages": "a"}, {"full_page_text": None}, [{"text": "a"}], {"other": 1}, 5, None):
        with pytest.raises(ValueError):
            json_io.page_from_json(bad)


def test_graph_and_manifest(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [\n{"id": "1", "type": "BusinessComponent", "name": "A"},\n{"id": "2", "type": "BusinessElement", "name": "B", "parent_id": "1"}\n]}')
    assert [r["id"] for r in json_io.read_graph(spark, str(tmp_path / "g.json")).orderBy("id").collect()] == ["1", "2"]
    files = json_io.discover_files(spark, str(tmp_path))
    assert json_io.verify_manifest(files, files).count() == 0
    changed = files.withColumn("sha256", F.lit("x"))
    assert [r["problem"] for r in json_io.verify_manifest(changed, files).collect()] == ["changed"]


def test_sinks(spark, tmp_path):
    with pytest.raises(Exception, match="not finite"):
        sinks.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "bad"))
    one = spark.createDataFrame([(1,)], "x int")
    sinks.write_draft(one, str(tmp_path / "d"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_draft(one, str(tmp_path / "d"))


def test_resume_and_stream(spark, tmp_path):
    schema = "document long, page long, method string, text string"
    pages = spark.createDataFrame([(1, p, "a", "x") for p in range(4)], schema)
    out = str(tmp_path / "done")
    work = lambda df: df.withColumn("n", F.length("text"))
    assert resume.extend(spark, pages.where("page < 2"), out, work) == 2
    assert resume.extend(spark, pages, out, work) == 2
    assert resume.extend(spark, pages, out, work) == 0
    pages.write.json(str(tmp_path / "in"))
    resume.follow(spark, str(tmp_path / "in"), schema, out, str(tmp_path / "cp"), work).awaitTermination(60)
    assert spark.read.parquet(out).count() == 4


def test_exports():
    import quillspan

    assert all(callable(getattr(quillspan, n)) for n in quillspan.__all__)
