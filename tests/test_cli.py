import json

import pytest

from quillspan import cli


def test_batch_and_saved_bundle(spark, tmp_path):
    page = "Account 001\nAmount 900"
    data = {"d": {m: {"pages": [page], "input_format": "plain"} for m in "abc"}}
    (tmp_path / "corpus.json").write_text("﻿" + json.dumps(data), encoding="utf-8")
    cli.main(["batch", str(tmp_path / "corpus.json"), str(tmp_path / "out")])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/ranking")).collect()
    assert {r["rank"] for r in rows} == {"1"} and len(rows) == 3
    bundle = {"data": data, "families": {m: [m.upper()] for m in "abc"}, "panel": list("abc")}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    cli.main(["evaluate-saved", str(tmp_path / "bundle.json"), str(tmp_path / "saved")])
    assert spark.read.option("header", True).csv(str(tmp_path / "saved/passages")).count() == 6
    assert spark.read.json(str(tmp_path / "saved/summary")).first()["corroborated"] == 6


def test_single_page_files(spark, tmp_path):
    for name, text in (("a", "alpha beta"), ("b", "alpha beta"), ("c", "gamma delta")):
        (tmp_path / f"{name}.txt").write_text(text)
    cli.main(["page", str(tmp_path / "out"), *(str(tmp_path / f"{n}.txt") for n in "abc")])
    got = {r["method"]: float(r["score"]) for r in spark.read.option("header", True).csv(str(tmp_path / "out/ranking")).collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": 0.0}


def test_unknown_command():
    with pytest.raises(SystemExit):
        cli.main(["nothing", "x"])
