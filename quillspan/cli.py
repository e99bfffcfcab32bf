"""Command line, for spark-submit or python -m quillspan.cli: thin fronts over the operators.

    evaluate-saved BUNDLE OUT      panel scores and passage corroboration of a saved bundle
    batch CORPUS OUT               consensus ranking of an aligned corpus
    page OUT FILE...               consensus ranking of one page's files, one for each method
    benchmark REFS PREDS PROFILE OUT   scores of predictions (parquet or JSON tables)
    compare-variants SCORES BASE OUT   score differences from a baseline variant
    extract-profile CORPUS PROFILE OUT labelled values of a corpus
    init-reference FOLDER PROFILE OUT  an unannotated reference draft with source hashes
    family-sensitivity PAIRS FAMILIES OUT  scores without one family at a time
    compile-schemas GRAPH OUT      a field catalogue of a graph export
    identify-critical-fields BLOCKS CATALOG OUT   the schemas that text blocks are routed to
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import benchmark, consensus, corroboration, discovery, extraction, panel, sinks
from .sources import checks, json_io


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)


def ranked(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    scores = consensus.pair_scores(pages)
    ranking = consensus.tolerant_rank(consensus.consensus(scores), "score", "method", 1e-12)
    return ranking.withColumn("score", 100 * F.col("score")).orderBy("rank", "method"), consensus.pair_summary(scores)


def evaluate_saved(spark: SparkSession, bundle: str, out: str) -> None:
    pages, families, voters = json_io.read_bundle(spark, bundle)
    paged = pages.where("page is not null")
    whole = pages.groupBy("document", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    by_page = panel.panel_scores(consensus.pair_scores(paged), families, voters)
    by_document = panel.panel_scores(consensus.pair_scores(whole.withColumn("page", F.lit(1))), families, voters)
    keyed = paged.withColumn("document", F.xxhash64("document")).withColumn("page", F.col("page").cast("long"))
    found, rolled, summary = corroboration.corroborate(keyed, families, voters)
    names = paged.select(F.col("document").alias("name"), F.xxhash64("document").alias("document")).distinct()
    named = lambda df: df.join(names, "document").withColumn("document", F.col("name")).drop("name")
    sinks.write_evaluation(out, named(found), named(rolled), summary, corroboration.ranking(found, by_page, by_document))


def batch(spark: SparkSession, corpus: str, out: str) -> None:
    ranking, summary = ranked(json_io.read_corpus(spark, corpus))
    sinks.write_csv(ranking, f"{out}/ranking")
    sinks.write_json(summary, f"{out}/pairwise_summary")
    sinks.write_report(sinks.markdown_report(ranking, "Consensus ranking", ["rank", "method"]), f"{out}/report")


def page(spark: SparkSession, out: str, *files: str) -> None:
    parts = [json_io.read_pages(spark, f).select(F.lit(Path(f).stem).alias("method"), "text") for f in files]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    ranking, summary = ranked(rows.select(F.lit("page").alias("document"), F.lit(1).alias("page"), "method", "text"))
    sinks.write_csv(ranking, f"{out}/ranking")
    sinks.write_json(summary, f"{out}/pairwise_summary")


def score(spark: SparkSession, refs: str, preds: str, profile: str, out: str) -> None:
    r, p, f = (read_table(spark, x) for x in (refs, preds, profile))
    counts = benchmark.counters(r, p, f)
    sinks.write_json(benchmark.ratios(benchmark.rollup(counts.where("field is not null"), r.select("document", "template_id").distinct())), f"{out}/results")
    ranking = consensus.tolerant_rank(benchmark.method_scores(counts.where("field is not null")), "score", "method", 1e-10)
    sinks.write_csv(ranking.orderBy("rank"), f"{out}/ranking")
    sinks.write_report(sinks.markdown_report(ranking, "Field scores", ["rank", "method"]), f"{out}/report")


def compare_variants(spark: SparkSession, scores: str, baseline: str, out: str) -> None:
    sinks.write_json(benchmark.variant_differences(read_table(spark, scores), baseline), out)


def one_profile(spark: SparkSession, path: str) -> dict:
    """The profile of a file: the only one of a file of profiles, which is checked, or a profile by itself."""
    rules = json_io.strict_json(Path(path).read_text(encoding="utf-8"))
    if "profiles" not in rules:
        return rules
    checks.demand(checks.profile_problems(spark, rules))
    (only,) = rules["profiles"].values()
    return only


def extract_profile(spark: SparkSession, corpus: str, profile: str, out: str) -> None:
    rules = one_profile(spark, profile)
    pages = json_io.read_corpus(spark, corpus)
    keyed = pages.select(F.xxhash64("document").alias("document"), "method", F.col("page").cast("long").alias("page"), "text")
    sinks.write_json(extraction.profile_predictions(keyed, rules, "markdown"), out)


def init_reference(spark: SparkSession, folder: str, profile: str, out: str) -> None:
    rules = one_profile(spark, profile)
    sinks.write_draft(sinks.reference_draft(json_io.discover_files(spark, folder), list(rules["fields"])), out)


def family_sensitivity(spark: SparkSession, pairs: str, families: str, out: str) -> None:
    rows = read_table(spark, pairs)
    measure = "primary_similarity" if "primary_similarity" in rows.columns else "combined_similarity"
    sinks.write_json(panel.family_sensitivity(rows, read_table(spark, families), measure), out)


def compile_schemas(spark: SparkSession, graph: str, out: str) -> None:
    sinks.write_json(discovery.catalog_from_graph(json_io.read_graph(spark, graph)), out)


def route(spark: SparkSession, blocks: str, catalog: str, out: str) -> None:
    fields = read_table(spark, catalog)
    schemas = fields.groupBy("schema_id").agg(F.concat_ws(" ", F.first("schema_name"), F.collect_list("field_name")).alias("text"))
    sinks.write_json(discovery.shortlist(read_table(spark, blocks), schemas), out)


COMMANDS: dict[str, Callable[..., None]] = {
    "evaluate-saved": evaluate_saved, "batch": batch, "page": page, "benchmark": score, "compare-variants": compare_variants, "extract-profile": extract_profile,
    "init-reference": init_reference, "family-sensitivity": family_sensitivity, "compile-schemas": compile_schemas, "identify-critical-fields": route,
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("paths", nargs="+")
    got = parser.parse_args(args)
    COMMANDS[got.command](SparkSession.builder.appName("quillspan").getOrCreate(), *got.paths)


if __name__ == "__main__":
    main()
