import pytest
from pyspark.sql import functions as F

from quillspan.operators import extraction, responses, sinks
from quillspan.sources import checks, json_io
from quillspan.streaming import resume

DET = "<|det|>{} [1, 2]<|/det|>{}\n"


def values(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_blocks(spark):
    d = DET.format
    cases = {
        "": "", " a \n\n  b\t\n": "a\n  b", d("title", " x ") + "y": "x\ny", "a\n" + d("text", "b") + "c": "a\n\nb\nc", d("image", "gone") + "x": "x", "a\n" + d("image", "") + d("image", ""): "a",
        "a\n" + d("text", "") + d("text", "b"): "a\n\n\n\nb", "a\n" + d("image", "p") + "caption\n" + d("text", "b"): "a\n\ncaption\n\nb", "see <|det|>x<|/det|> here": "see <|det|>x<|/det|> here", "a\r\nb\x0bc": "a\nb\nc",
    }
    assert values(spark, responses.blocks_text, list(cases)) == list(cases.values())


def test_grounding_and_responses(spark):
    assert values(spark, responses.without_grounding, [" <|ref|>a\nb<|/ref|><|det|>[1]<|/det|> x<|endoftext|>", None]) == ["x", None]
    answers = [
        '{"pages": [{"markdown": "a [t](t) ![p](p.PNG)", "tables": [{"id": "t", "content": "|1|"}, {"id": null}], "images": [{"id": "p.PNG", "image_base64": "AA"}]}, {"markdown": "b ![q](q.x)", "images": [{"id": "q.x", "image_base64": "data:z"}]}]}',
        '{"pages": []}', "{}", '{"pages": [{"tables": null}]}',
    ]
    assert values(spark, responses.response_text, answers) == ["a |1| ![p](data:image/png;base64,AA)\n\n---\n\nb ![q](data:z)", "", "", ""]


def test_replies(spark):
    found = '{"field_id": "a", "critical": false, "reason": "r", "status": "found", "occurrences": [{"value": "v", "evidence": "v", "occurrence": 0}]}'
    none = '{"field_id": "b", "critical": true, "reason": "r", "status": "ambiguous", "occurrences": []}'
    cases = {f"[{found}, {none}]": None, "[]": None, f"[{none}, {none}]": "repeated_field", "[null]": "unknown_field", f'[{none.replace("ambiguous", "lost")}]': "unsound_status", f'[{found.replace("found", "unlocated")}]': "evidence_and_status_differ", "5": "no_decisions"}
    texts = [f'{{"decisions": {c}}}' for c in cases]
    assert values(spark, lambda t: responses.reply_problem(t, F.array(F.lit("a"), F.lit("b"))), texts) == list(cases.values())


def test_column_pairs(spark):
    texts = ["Doc No.:\nDate\n: 7\n\n:2024", "Date\n:x", "Doc No\n: 7", "Doc No.\nDate\n: 7", "Date\nDate\n:1\n:2", "Doc No.\nDate\nx\n: 1\n: 2", "GST No.\nDate\n:1\n:2", ": 1\nDate:", "", None]
    pages = spark.createDataFrame([(i, "m", 1, t) for i, t in enumerate(texts)], "document int, method string, page int, text string")
    made = extraction.column_pairs(pages, {"Doc No.": "N", "Date": "D", "GST No.": None}, ("Doc No.", "Date")).collect()
    assert sorted((r["document"], r["field"], r["value"], r["at"]) for r in made) == [(0, "D", "2024", 4), (0, "N", "7", 2), (1, "D", "x", 1), (2, "N", "7", 1)]


def test_reports_and_replaced_tables(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 2), (None, 1)], "name string, n int")
    sinks.write_report(sinks.markdown_report(rows, "T", ["n"]), str(tmp_path / "md"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["# T", "", "| name | n |", "| --- | --- |", "|  | 1 |", "| b\\|c | 2 |"]
    assert [r["line"] for r in sinks.html_report(rows.select(F.lit("<&>").alias("x")).limit(1), "T", ["x"]).orderBy("place").collect()][2] == "<tr><td>&lt;&amp;&gt;</td></tr>"
    for n in (1, 2):
        sinks.replace_json(spark.range(n), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["md", "t"]
    manifest = spark.createDataFrame([("p", "x")], "path string, sha256 string")
    sinks.keep_manifest(manifest, str(tmp_path / "m"))
    sinks.keep_manifest(manifest, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="changed"):
        sinks.keep_manifest(manifest.withColumn("sha256", F.lit("y")), str(tmp_path / "m"))


def test_settings_and_sources(spark):
    assert checks.setting_problems({"entity_weight": 1, "overlap_weight": 1, "context": 128, "mode": "values", "weighting": "document"}) == []
    for wrong in ({"entity_weight": 0.5}, {"overlap_weight": -0.1}, {"overlap_weight": True}, {"context": 0}, {"mode": 1}, {"weighting": None}, {"colour": 1}):
        assert len(checks.setting_problems(wrong)) == 1
    files = spark.createDataFrame([("p", '﻿{"d": {"a": {"pages": ["x"]}}, "d": {"b": {"pages": ["y", null]}}}')], "path string, value string")
    assert sorted((r["document"], r["method"], r["page"], r["text"]) for r in json_io.corpora(files).where("text is not null").collect()) == [("d", "b", 1, "y")]
    assert values(spark, json_io.json_problem, ['{"a": 1}', '{"a": -Infinity}', "{"]) == [None, "not a finite number: -Infinity", "no JSON"]
    pages = spark.createDataFrame([(1, "a", 2, "y"), (1, "a", 1, "x"), (1, "a", 3, None)], "document long, method string, page long, text string")
    assert [r["text"] for r in resume.assembled(pages).collect()] == ["x\n\n---\n\ny\n\n---\n\n"]
