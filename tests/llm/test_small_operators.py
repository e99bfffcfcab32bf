"""Packing, token counts, fingerprints, contamination, urls and languages against brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, imatch, language_id, packing, token_counts, url_filter
from quillspan.llm.queries import PIECES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, node long, k0 string"


def docs(spark, rows):
    """Rows (id, text), with extra columns that clash with internal names."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in rows], DOCS)


ODD = [(None, "abc def"), (1, None), (2, ""), (3, "a" * 70000), (3, "a" * 70000), (4, "ß €uro 日本"), (5, "\n\n")]


def test_packing_is_whole_and_fits(spark):
    rows = packing.best_fit_pack(docs(spark, ODD)).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5}
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 140000
    bins = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"], r["capacity"]), []).append((r["offset"], r["length"]))
    for (_, _, capacity), parts in bins.items():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in itertools.pairwise(parts))
        used = parts[-1][0] + parts[-1][1]
        assert used <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= used)
    assert packing.best_fit_pack(docs(spark, [])).count() == 0
    whole = {}
    for r in packing.best_fit_pack(docs(spark, [(i, t) for i, t in enumerate(t for _, t in ODD)]), content=True).orderBy("start").collect():
        assert len(r["content"]) == r["length"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["content"])
    assert whole == {i: (t or "").encode() for i, (_, t) in enumerate(ODD)}


def test_mixed_plan_opens_the_cheapest_bin_for_its_contents():
    placed = packing.mixed_fit([10, 6, 4, 3, 1], [4, 10, 16], float)
    assert placed == [(0, 0), (0, 10), (1, 0), (2, 0), (2, 3)]  # 16 full, 4 full, 4 full
    assert packing.mixed_fit([], [4], float) == [] and packing.mixed_fit([0, 0], [4], float) == [(0, 0), (0, 0)]
    rng = random.Random(9)
    for _ in range(50):
        items = sorted((rng.randint(0, 12) for _ in range(30)), reverse=True)
        bins = {}
        for n, (b, at) in zip(items, packing.mixed_fit(items, (4, 7, 12), float), strict=True):
            assert bins.get(b, 0) == at
            bins[b] = at + n
        assert max(bins.values()) <= 12


def test_best_fit_takes_the_tightest_open_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], [10], packing.unit_cost, 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]


def test_packing_is_near_the_least_cost():
    rng = random.Random(3)
    for _ in range(30):
        sizes, items = (4, 7, 12), [rng.randint(1, 12) for _ in range(6)]
        got = packing.pack(items, sizes, float)
        cost = sum({b: c for b, c, _ in got}.values())
        best = min(cost_of(p, sizes) for p in partitions_of(items))
        assert best <= cost <= 1.5 * best


def partitions_of(items):
    if not items:
        yield []
        return
    first, *rest = items
    for p in partitions_of(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


def cost_of(bins, sizes):
    return sum(min((c for c in sizes if c >= sum(b)), default=10**9) for b in bins)


@pytest.mark.skipif(not Path(PIECES).exists(), reason="no vocabulary file")
def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    vocab = token_counts.vocabulary(PIECES)
    exact = Tokenizer(models.Unigram([tuple(v) for v in vocab], unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    rng = random.Random(1)
    texts = ["Hello  world", "ñandú 日本語 \U0001f600\U0001f600", "", " lead", "a\nb\tc", "x" * 300] + ["".join(rng.choice("abcdeñ €\n日x") for _ in range(60)) for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, list(enumerate(texts))), PIECES).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(exact.encode(t, add_special_tokens=False).ids), t
    assert decoders is not None
    odd = {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs(spark, [(1, None), (2, "")]), PIECES).collect()}
    assert odd == {(1, 0), (2, 0)}


def test_token_count_ties():
    """Equal scores: the last piece that starts first stays."""
    c = token_counts.Counter((("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -9.0)), byte_fallback=False)
    assert c.word("ab")[0] == 1 and c.word("abab")[0] == 2
    assert c.word("zz")[:2] == (1, 2)


def test_edited_texts_in_order(spark):
    rows = [(7, "one two three four five six"), (3, None), (5, "alpha beta gamma delta"), (9, "x"), (-2, "é" * 9), (11, "one two three four five six")]
    got = {r["doc_id"]: r for r in imatch.compare_edited(docs(spark, rows)).collect()}
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[7]["fingerprint"] == got[11]["fingerprint"]
    assert imatch.compare_edited(docs(spark, [])).count() == 0
    assert imatch.compare_edited(docs(spark, [(1, "a b c d e")])).first()["near_next"] == 1.0


def test_fingerprints_equal_brute_force(spark):
    """Lexicon band, subsets, hashes, marker and likeness, worked out again from the texts alone."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=[60 - i for i in range(60)], k=rng.randint(3, 40))) for _ in range(30)]
    texts += [None, "", "?!", "only rare here", "Only RARE here", texts[0], texts[0], "long " * 30_000 + texts[1]]
    band = (0.1, 0.4)
    rows = list(enumerate(texts))
    df = {}
    for _, t in rows:
        for w in set(re.findall(r"\w+", (t or "").lower())):
            df[w] = df.get(w, 0) + 1
    lexicon = {w for w, n in df.items() if max(2, math.ceil(band[0] * len(rows))) <= n <= max(2, math.floor(band[1] * len(rows)))}
    assert 5 < len(lexicon) < len(df)

    def told(words):
        x = hashlib.blake2b(" ".join(sorted(words)).encode(), digest_size=4).hexdigest()
        return x if words else "0" * 8

    def fingerprint(t):
        every = set(re.findall(r"\w+", t.lower()))
        kept = every & lexicon
        if every and not kept:
            return ["f" * 8, told(every)] + ["0" * 8] * 55
        subsets = [kept] + [{w for w in kept if xxhash.xxh64_intdigest(w, seed=1 + 8 * k + i) % 2**d == 0} for k, d in enumerate((1, 3, 5, 6, 7, 8, 9)) for i in range(8)]
        return [told(x) for x in subsets]

    def likeness(x, y):
        if x == y:
            return 1.0
        used = [[(p, q) for p, q in zip(x[i : i + 8], y[i : i + 8], strict=True) if {p, q} != {"0" * 8}] for i in range(1, 57, 8)]
        shares = [sum(p == q for p, q in u) / len(u) for u in used if len(u) >= 4]
        every = [p == q for p, q in zip(x, y, strict=True) if {p, q} != {"0" * 8}]
        return round(max(shares) if shares else sum(every) / len(every), 6)

    got = {r["doc_id"]: r for r in imatch.compare_edited(docs(spark, rows), band).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        mine, changed, other = fingerprint(t), fingerprint(edited), fingerprint(after)
        assert got[i]["fingerprint"] == "".join(mine) and got[i]["edited_fingerprint"] == "".join(changed)
        assert (got[i]["near_edited"], got[i]["near_next"]) == (likeness(mine, changed), likeness(mine, other))


def test_fingerprints_tell_edits_from_others(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = imatch.compare_edited(base).select("near_edited", "near_next").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)
    odd = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs(spark, ODD)).where("doc_id in (1, 2)").collect()}
    assert odd[1] == odd[2] == imatch.NONE * imatch.SIZE


def test_contamination_in_any_order(spark):
    a, b = "the quick brown fox jumps over the lazy dog near a river bank", "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, a), (2, b), (3, "too short"), (4, None)], "item_id long, text string")
    words = a.split()
    rows = [(1, f"intro {a} outro"), (2, " ".join(words[7:] + ["and"] + words[:7])), (3, " ".join(words[:6])), (4, None), (5, ""), (6, f"{b} {a} {b}"), (None, a), (1, f"intro {a} outro")]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(docs(spark, rows), bench).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 1), (6, 1), (6, 2)]
    whole = decontaminate.annotate(docs(spark, rows).withColumn("found", F.lit(1)), bench, "items", block_bytes=10)
    assert sum(len(r["items"]) for r in whole.collect()) == 6 and "found" in whole.columns
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs(spark, []), bench).count() == 0


def test_contamination_equals_brute_force(spark):
    """Greedy tiling of every document with every item, as published; passages reordered, cut, repeated and mixed."""
    rng = random.Random(13)
    word = lambda: f"v{rng.randrange(400)}"
    items = [[word() for _ in range(rng.randint(5, 18))] for _ in range(12)]
    items.append(items[0][:9] + items[1][:6])
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 3)):
            item = rng.choice(items)
            cut = rng.randint(0, len(item))
            parts += rng.choice([item, item[cut:] + item[:cut], item[: cut + 1], item * 2, [w for w in item if rng.random() > 0.1]]) + [word() for _ in range(rng.randint(0, 4))]
        texts.append(parts)
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*items, *texts] for w in t))}
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            covered = sum(x[2] for x in greedy([number[w] for w in item], [number[w] for w in t], 5))
            if covered >= 0.8 * len(item) - 1e-9:
                want[d, k] = (len(item), covered)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    long = " ".join([*texts[0], *["x"] * 60_000, *items[2]])
    rows = [*enumerate(" ".join(t) for t in texts), (99, long)]
    found = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_covered"]) for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert {k: v for k, v in found.items() if k[0] != 99} == want and len(want) > 30 and (99, 2) in found


def test_contamination_by_short_items(spark):
    bench = spark.createDataFrame([(1, "too short"), (2, "Paris"), (3, "a b c d"), (4, "?!"), (5, "a b c d e"), (6, "too short")], "item_id long, text string")
    rows = [(1, "it is too short, really"), (2, "short too paris"), (3, "a b c x d"), (4, "x a b c d"), (5, "a b c d e"), (6, "?!"), (7, "Too short")]
    found = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_covered"], r["n_tiles"], r["coverage"]) for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert found == {(1, 1): (2, 2, 1, 1.0), (1, 6): (2, 2, 1, 1.0), (2, 2): (1, 1, 1, 1.0), (4, 3): (4, 4, 1, 1.0), (5, 3): (4, 4, 1, 1.0), (5, 5): (5, 5, 1, 1.0), (7, 1): (2, 2, 1, 1.0), (7, 6): (2, 2, 1, 1.0)}


def test_tiles_equal_greedy_search():
    import numpy as np

    rng = random.Random(5)
    for _ in range(100):
        item, doc = [np.array([rng.randint(0, 3) for _ in range(n)], dtype=np.uint64) for n in (14, 30)]
        hits = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if (item[i : i + 3] == doc[j : j + 3]).all()]
        assert sum(t[2] for t in decontaminate.tiles(item, doc, hits, 3)) == sum(t[2] for t in greedy(item, doc, 3))


def greedy(item, doc, least):
    """Greedy string tiling as published: all matches of the largest length, marked in order, until none is left."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            a[i + k] = b[j + k] = True
        out.append((i, j, n))


URLS = [
    (1, "http://A.Example.ORG/es/x?q"), (2, "https://sub.example.org/en/12"), (3, "https://example.org"), (4, "ftp://x.com/fr/1#a"), (5, "http://x.com/de/1"), (6, None), (7, "no scheme"),
    (8, "http://notexample.org/es/1"), (9, "http://a.net/?x=/es/"), (10, "http://example.org/en/2"), (8, "http://notexample.org/es/1"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "z") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [got[i]["rule"] for i in range(2, 11)] == ["example.org/en/1", None, "com/fr/", "com/de/", None, None, "org/", None, "org/"]
    assert (got[6]["host"], got[6]["path"]) == ("", "") == (got[7]["host"], got[7]["path"]) and got[9]["path"] == "/"
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df.where("page_id = 9")).collect()} == {"allow"}


def test_url_models_separate_what_rules_label(spark):
    rows = [(i, f"http://site{i}.net/{'sport/results' if i % 2 else 'casino/bonus'}/{i}") for i in range(400)]
    rules = [url_filter.Rule("allow", f"site{i}.net", "/") if i % 2 else url_filter.Rule("block", f"site{i}.net", "/") for i in range(40)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert all((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in got)


def test_url_threshold_has_the_least_balanced_error(monkeypatch):
    monkeypatch.setattr(url_filter, "rate", lambda model, urls: np.array([float(u) for u in urls]))
    rng = random.Random(15)
    for _ in range(100):
        good, bad = ([round(rng.gauss(m, 1), 1) for _ in range(rng.randint(1, 12))] for m in (1, -1))
        error = lambda cut: sum(x < cut for x in good) / len(good) + sum(x >= cut for x in bad) / len(bad)  # noqa: B023, E731
        cut = url_filter.calibrated(None, {"allow": [str(x).encode() for x in good], "block": [str(x).encode() for x in bad]})
        assert error(cut) <= min(error(x + e) for x in good + bad for e in (-0.01, 0.01)) + 1e-9


def test_url_verdicts_follow_ratio_and_threshold(spark):
    rows = [(i, f"http://site{i}.{'org' if i % 3 else 'com'}/{'fr' if i % 2 else 'de'}/{'sport' if i % 3 else 'casino'}{i}") for i in range(80)]
    rows += [(100 + i, f"http://other.net/{w}{i}") for i, w in enumerate(["sport", "casino", "de", "x"] * 5)] + [(200, None), (200, None), (201, "http://a.net/" + "z" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    judged = df.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    judged = judged.withColumn("by_rule", url_filter.rule_of(F.col("host"), F.col("path"), url_filter.RULES, "verdict"))
    model, least = url_filter.train(judged, "url", "by_rule", "page_id")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(rows)
    for r, url in ((r, dict(rows)[r["page_id"]] or "") for r in got if r["rule"] is None):
        bits = dict(zip(model.classes, model.bits([url.lower().encode()])[0], strict=True))
        assert r["ratio"] == pytest.approx((bits["block"] - bits["allow"]) / max(1, len(url)), abs=1e-6)
        assert r["verdict"] == ("allow" if r["ratio"] >= least else "block")


def test_url_models_and_threshold_rest_on_every_label(spark):
    """Thousands of labels of each verdict, some repeated, one very long: all are counted, and all rated by the models of the other folds."""
    from quillspan.llm.context_model import ContextModel

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeiounstr") for _ in range(4))
    labels = [("allow", f"http://a.org/{word()}/{word()}") for _ in range(7500)] + [("block", f"http://a.org/{word()}/{'q' if i % 2 else ''}{word()}") for i in range(7000)]
    labels += labels[::500] + [("block", "http://y.com/de/" + "xyz" * 2000)]
    df = spark.createDataFrame([(i, v, u) for i, (v, u) in enumerate(labels)] + [(-1, None, "http://b.net/"), (-2, "allow", None)], "page_id long, v string, url string")
    model, least = url_filter.train(df, "url", "v", "page_id")
    asked = [u.encode() for u in ["http://b.net/", "http://x.com/de/xyzxyz", "http://a.org/", *(u for _, u in labels[::400])]]
    of = lambda rows: ContextModel({k: [u.encode() for v, u in rows if v == k] for k in ("allow", "block")}, 5, blend=True)
    np.testing.assert_allclose(model.bits(asked), of(labels).bits(asked), rtol=1e-12)
    fold = dict(df.select("url", F.expr("pmod(xxhash64(url), 4)")).where("url is not null").collect())
    assert set(fold.values()) == {0, 1, 2, 3}
    good, bad = [], []
    for f in range(4):
        others = of([(v, u) for v, u in labels if fold[u] != f])
        for v, to in (("allow", good), ("block", bad)):
            bits = others.bits(mine := [u.encode() for w, u in labels if w == v and fold[u] == f])
            to += [round(x, 6) for x in (bits[:, 1] - bits[:, 0]) / [len(u) for u in mine]]
    assert (len(good), len(bad)) == (7515, 7015)
    good, bad, values = np.sort(good), np.sort(bad), np.unique(good + bad)
    cuts = np.concatenate([[values[0] - 1e-9], (values[1:] + values[:-1]) / 2, [values[-1] + 1e-9]])
    error = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = cuts[error <= error.min() + 1e-12]
    assert 0.01 < error.min() < 0.99 and least == pytest.approx(best[np.abs(best).argmin()], abs=1e-9)


def test_url_threshold_by_steps_is_that_of_single_rates(spark):
    rng = random.Random(32)
    for n, places in ((3, 1), (60, 3), (3000, 4), (3000, 6)):
        rows = [(round(rng.gauss(m, 0.01), places), int(m > 0), int(m < 0)) for m in (0.003, -0.003) for _ in range(n)]
        rates = spark.createDataFrame(rows, "ratio double, good long, bad long").groupBy("ratio").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        each = np.array(sorted(map(tuple, rates.collect())))
        assert url_filter.threshold(rates) == pytest.approx(url_filter.least_error(each[:, 0], each[:, 0], each[:, 1], each[:, 2]), abs=1e-12)


def test_url_models_too_large_to_broadcast_are_joined(spark, monkeypatch):
    rows = [(i, f"http://site{i % 90}.{'org' if i % 3 else 'com'}/{'fr' if i % 2 else 'de'}/{'sport' if i % 3 else 'casino'}{i}") for i in range(200)]
    rows += [(300 + i, f"http://other.net/{w}{i}") for i, w in enumerate(["sport", "casino", "\u00df\u20ac", "\U0001f600"] * 5)]
    rows += [(400, None), (400, None), (401, "http://a.net/" + "z" * 50_000), (402, ""), (403, "~"), (404, "http://b.com/de/" + "z" * 5000)]
    for table in (rows, URLS, [(1, "http://x.com/de/1"), (2, "http://x.com/de/1"), (3, "http://a.org/b"), (4, "http://a.org/c"), (5, "http://b.net/1")]):
        df, seen = spark.createDataFrame(table, "page_id long, url string"), []
        for most, short in ((1_000_000, 0), (0, 0), (0, 1_000_000)):
            monkeypatch.setattr(url_filter, "MOST_GRAMS", most)
            monkeypatch.setattr(url_filter, "MOST_SHORT", short)
            seen.append(sorted(url_filter.filter_urls(df).collect(), key=lambda r: (r["page_id"], r["host"], r["path"])))
        assert [len(x) for x in seen] == [len(table)] * 3
        for a, b in [*zip(seen[0], seen[1], strict=True), *zip(seen[0], seen[2], strict=True)]:
            assert a[:5] == b[:5] and (a["ratio"] is None) == (b["ratio"] is None) and (a["ratio"] or 0) == pytest.approx(b["ratio"] or 0, abs=2e-6)


def test_languages_need_letters_and_labels(spark):
    """Signs that count as words but aren't letters give no language; a label without a text isn't learned; scores are posteriors."""
    rows = [(i, w * 20, l) for i, (w, l) in enumerate([("the cat sat ", "en"), ("le chat noir ", "fr")] * 30)] + [(900, "\u00b2 \u00bd \u2460 \u2167 12", "en"), (901, None, "xx"), (902, "le chat", None), (902, "le chat", None)]
    got = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "fr"
    assert {r["lang_pred"] for r in got.values()} == {"und", "en", "fr"} and all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    clash = language_id.identify(docs(spark, [(1, "a cat")]).withColumnRenamed("source", "lang_pred"), None, ["doc_id", "lang_pred"])
    assert clash.columns[:2] == ["doc_id", "lang_pred"] and len(set(clash.columns)) == 5 and clash.first()["lang_pred"] == "s"


def test_language_accuracy_and_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = language_id.language_id(base).join(base.select("doc_id", "lang"), "doc_id").where("held_out")
    assert made.where("lang_pred = lang").count() >= 0.98 * made.count()
    odd = language_id.language_id(docs(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "hello there"), (None, "hi"), (4, "hello there")])).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and len(odd) == 6
    assert language_id.language_id(docs(spark, [])).count() == 0


def test_code_lengths_equal_a_plain_tree():
    import math

    from quillspan.llm.context_model import ContextModel

    samples = {"a": [b"abracadabra", b"abc"], "b": [b"xyzzy", b"abxy"]}
    for blend in (False, True):
        model = ContextModel(samples, 2, blend)

        def p(cls, context, byte, blend=blend):
            below = p(cls, context[1:], byte) if context else 1 / 256
            seen = [t[i] for raw in samples[cls] for t in [b"\0\0" + raw] for i in range(2, len(t)) if t[i - len(context) : i] == context]
            if not seen:
                return below
            n, d, c = len(seen), len(set(seen)), seen.count(byte)
            return (c + d * below) / (n + d) if blend else c / (n + d) if c else d / (n + d) * below

        for text in (b"abra", b"zzz", b"q", b"xyabc\0"):
            want = [sum(-math.log2(p(c, (b"\0\0" + text)[i : i + 2], text[i])) for i in range(len(text))) for c in model.classes]
            assert model.bits([text])[0].tolist() == pytest.approx(want)


def test_large_ids_are_packed_unchanged_beside_null_ones(spark):
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**60) - 1]
    rows = packing.best_fit_pack(docs(spark, [(i, "abc") for i in ids]), content=True).collect()
    assert {r["doc_id"] for r in rows} == set(ids) and all(bytes(r["content"]) == b"abc" for r in rows)
    assert sorted(r["offset"] for r in rows) == [0, 3, 6, 9] and {(r["bin"], r["capacity"]) for r in rows} == {(0, 2048)}
    # Longest first, then by id, then by piece; nulls last.
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["offset"])] == [-(2**60) - 1, 2**53 + 1, 2**53 + 3, None]


def test_scoring_texts_takes_bounded_memory():
    import tracemalloc

    from quillspan.llm.context_model import ContextModel, spread, spread_blocks

    rng = random.Random(4)
    texts = [b"", *(bytes(rng.choices(b"abcdefgh \xc3\xa9", k=n)) for n in (400_000, 1, 0, 3, 600_000)), b""]
    model = ContextModel({c: [bytes(rng.choices(c.encode() + b"abc ", k=500))] for c in "dxyz"}, 4)
    tracemalloc.start()
    try:
        bits = model.bits(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20 << 20  # of all bytes at once: 46 MB
    keys, owner = spread(texts, 4)
    cost = model.each(keys)
    np.testing.assert_allclose(bits, [[cost[owner == i, j].sum() for j in range(4)] for i in range(len(texts))], rtol=1e-9)
    parts = list(spread_blocks(texts, 4, 1000))
    assert (np.concatenate([k for k, _ in parts]) == keys).all() and (np.concatenate([o for _, o in parts]) == owner).all()
    assert [len(x) for x in spread([b"", b""], 4)] == [0, 0] == [len(x) for x in spread([], 4)]


def test_a_kept_text_goes_to_python_once(spark):
    from quillspan.llm.common import per_text

    rows = docs(spark, ODD[:5])
    for keep in (["doc_id", "text", "lang"], ["doc_id"]):
        made = per_text(rows, "text", keep, "k0 long, text string", lambda t: [[len(x or "") for x in t], t])
        assert made.columns == [*keep, "k0", "text_" if "text" in keep else "text"]
        sent = re.search(r"MapInArrow.*\n[^\[]*\[(.*)\]", made._jdf.queryExecution().analyzed().toString()).group(1)
        assert len(re.findall(r"text#\d+ AS", sent)) == 1
        assert sorted(map(str, (r[0] for r in made.collect()))) == sorted(str(i) for i, _ in ODD[:5])
        assert all(r["k0"] == len(r[-1] or "") for r in made.collect())
