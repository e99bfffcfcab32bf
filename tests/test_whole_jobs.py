"""Registered queries on whole inputs, against brute force on small tables of their own."""

from itertools import combinations

from quillspan.operators import consensus, statistics
from quillspan.plans import registry
from quillspan.plans.consensus import rounded, scores
from quillspan.sources import fixtures


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def talk(spark, folder, texts):
    rows = [(1 + i // 3, i % 3, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_region_errors_of_whole_texts(spark, tmp_path):
    head = "a plain start that no method reads in another way at all here"
    texts = [f"{head} {'open gate ' * 12}", f"{head} é ü ñ öffentlich straße", "kurz", f"{head}, same", "über zwölf ärgerliche größen öfter", "x" * 90]
    got = {(r["method"], r["document"]): r for r in registry.queries()["j09_region_errors"](spark, talk(spark, tmp_path, texts)).collect()}
    versions = {"beta": lambda t: " ".join(w for i, w in enumerate(t.split(" "), 1) if i % 7), "gamma": lambda t: t.replace("en", "em")}
    for method, made in versions.items():
        for document in (1, 2):
            pairs = [(t, made(t)) for t in texts[3 * document - 3 : 3 * document]]
            r = got[method, document]
            assert (r["regions"], r["correct_regions"]) == (3, sum(a == b for a, b in pairs))
            assert (r["region_characters"], r["region_edit_distance"]) == (sum(len(a) for a, _ in pairs), sum(edits(a, b) for a, b in pairs))


def test_bootstrap_of_2000_repetitions(spark, tmp_path):
    folder = talk(spark, tmp_path, [f"one two three {'seven eight open ' * (i % 4)}{i} end" for i in range(12)])
    want = rounded(statistics.bootstrap(consensus.page_scores(scores(spark, folder)), 2000), "share_first", "low", "high").collect()
    got = registry.queries()["a31_bootstrap"](spark, folder).collect()
    assert len(got) == 5 and sorted(got) == sorted(want)


def test_changes_and_repairs_of_the_whole_panel(spark, tmp_path):
    """Every pair of methods whose words differ has changes, and every method's pages are repaired."""
    folder = talk(spark, tmp_path, ["seven open gates were left ajar by the old keeper", "nothing odd in any of these seven words here", "an ending of some other words that go on and on"])
    words = {(r["page"], r["method"]): r["text"].casefold().split() for r in fixtures.pages(spark, folder).collect()}
    want = {(p, a, b) for p in (1, 2, 3) for a, b in combinations(fixtures.METHODS, 2) if words[p, a] != words[p, b]}
    changes = registry.queries()["j12_changes"](spark, folder)
    assert {tuple(r)[1:4] for r in changes.collect()} == want and len({x[1:] for x in want}) == 10
    repaired = registry.queries()["j03_hyphen_repair"](spark, folder).collect()
    assert sorted((r["page"], r["method"]) for r in repaired) == [(p, m) for p in (1, 2, 3) for m in fixtures.METHODS]


def test_discovery_in_whole_documents(spark, tmp_path):
    texts = [f"a start {'of many words ' * 9}and its own end", "short", None, "", "ab" * 50, "x" * 41, "é" * 40 + "y" * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["block_id"], r["field_id"]): (r["schema_id"], r["span_start"], r["span_end"], r["issue"]) for r in registry.queries()["f21_x06_discovery"](spark, str(tmp_path)).collect()}
    assert len(got) == 2 * len(texts)
    for i, t in enumerate(texts):
        _, start, end, issue = got[str(i), "head"]
        assert got[str(i), "lost"] == (f"r{i % 2}", None, None, "not_in_evidence")
        assert (end, issue) == ((len(t), None) if t else (None, "not_in_evidence")) and (not t or start in (0, len(t) - 40))
    assert got["0", "head"][1] == len(texts[0]) - 40
