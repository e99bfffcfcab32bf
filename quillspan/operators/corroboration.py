"""Which passages of a method's pages do independent families support?

The worker aligns each method with each panel member and says, for every passage
and peer, what the alignment shows. Families, passages, pages and the summary are
folded from those evidence rows: what concerns one passage within its row, the
rest by ordinary aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .alignment import UNIT, by_page, each_page, lettered, opcodes

NEAR, SHOWN = 8, 80
STATES = ("complete", "failed", "truncated")
HEAD = (
    "document long, page long, method string, passage int, token_start int, token_end int, text string, context_before string, context_after string, source_status string"
)
PEERS = "array<struct<peer:string,state:string,peer_token_start:int,peer_token_end:int,peer_text:string,peer_text_truncated:boolean>>"
FLIP = {"insert": "delete", "delete": "insert"}


def check_policy(min_families: int, min_fraction: float, passage_tokens: int) -> None:
    if isinstance(min_families, bool) or not isinstance(min_families, int) or min_families < 2:
        raise ValueError("min_families must be an integer of 2 or more")
    if isinstance(min_fraction, bool) or not isinstance(min_fraction, (int, float)) or not 0 <= min_fraction <= 1:
        raise ValueError("min_fraction must be a number from 0 to 1")
    if isinstance(passage_tokens, bool) or not isinstance(passage_tokens, int) or not 1 <= passage_tokens <= 128:
        raise ValueError("passage_tokens must be an integer from 1 to 128")


class Words:
    """A method's page: its tokens, its passages, and which phrases occur once."""

    def __init__(self, lines: list[list[str]], limit: int):
        self.words: list[str] = []
        self.letters: str | list[str] = []
        self.spans: list[tuple[int, int]] = []
        for line in lines:
            first = len(self.words)
            self.words += list(line)
            self.spans += [(a, min(a + limit, len(self.words))) for a in range(first, len(self.words), limit)]
        self.once: dict[str | tuple[str, ...], bool] = {}

    def unique(self, phrase: str | list[str]) -> bool:
        """Whether ``phrase``, a part of a page's letters, occurs once."""
        key = phrase if isinstance(phrase, str) else tuple(phrase)
        if key not in self.once:
            if isinstance(phrase, str):
                first = self.letters.find(phrase)
                self.once[key] = first >= 0 and self.letters.find(phrase, first + 1) < 0
            else:
                starts = (i for i, w in enumerate(self.words) if w == phrase[0] and self.words[i : i + len(phrase)] == phrase)
                self.once[key] = next(starts, None) is not None and next(starts, None) is None
        return self.once[key]


def evidence(mine: Words, peer: Words, start: int, end: int, codes: list[tuple]) -> tuple[str, int, int, str, bool]:
    """(state, peer start, peer end, peer text, cut) of the passage from ``start`` to ``end``.

    Support needs the whole passage in one equal block, and its surroundings in
    that block once on either side. A replacement, or an insertion strictly inside, conflicts.
    """
    touching = []
    for kind, a, b, c, d in codes:
        if kind == "equal" and a <= start and end <= b:
            around = mine.letters[max(a, start - NEAR) : min(b, end + NEAR)]
            state = "support" if mine.unique(around) and peer.unique(around) else "ambiguous"
            lo, hi = c + start - a, c + end - a
            return state, lo, hi, " ".join(peer.words[lo:hi]), False
        if max(a, start) < min(b, end) or (kind == "insert" and start < a < end):
            touching.append((kind, c + max(0, start - a), d - max(0, b - end)) if kind == "equal" else (kind, c, d))
    state = "conflict" if any(k in ("replace", "insert") for k, _, _ in touching) else "missing"
    lo = min((x for _, x, _ in touching), default=0)
    hi = max((x for _, _, x in touching), default=lo)
    return state, lo, hi, " ".join(peer.words[lo : min(hi, lo + SHOWN)]), hi - lo > SHOWN


def passage_rows(pages: DataFrame, panel: list[str], passage_tokens: int = 40) -> DataFrame:
    """A row for each passage of each method, with ``peers``: what the alignment with each panel member shows. Pages without text give none."""
    lined = pages.withColumn("lines", F.transform(F.split("text", r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"), tokens))
    rows = by_page(lined, "lines", "status")
    voters = sorted(panel)

    def work(document: int, page: int, methods: list[dict]) -> Iterator[tuple]:
        read = {m["method"]: Words(m["lines"] or [], passage_tokens) for m in methods}
        status = {m["method"]: m["status"] for m in methods}
        for x, letters in zip(read.values(), lettered([x.words for x in read.values()]), strict=True):
            x.letters = letters
        known: dict[tuple, list[tuple]] = {}
        for method in sorted(read):
            mine = read[method]
            for number, (start, end) in enumerate(mine.spans, 1):
                w, peers = mine.words, []
                text = " ".join(w[start:end])
                for peer in voters:
                    if status.get(peer, "complete") != "complete" or peer not in read:
                        found = ("unavailable", None, None, None, False)
                    elif peer == method:
                        found = ("support", start, end, text, False)
                    else:
                        # Equal texts are aligned once. Aligned is the method that comes first by name.
                        one, two = (method, peer) if method < peer else (peer, method)
                        a, b = read[one].letters, read[two].letters
                        pair = (a, b) if isinstance(a, str) else (one, two)
                        if pair not in known:
                            known[pair] = opcodes(a, b)
                        codes = known[pair] if one == method else [(FLIP.get(k, k), c, d, a, b) for k, a, b, c, d in known[pair]]
                        found = evidence(mine, read[peer], start, end, codes)
                    peers.append(dict(zip(PEER, (peer, *found), strict=True)))
                yield document, page, method, number, start, end, text, " ".join(w[max(0, start - NEAR) : start]), " ".join(w[end : end + NEAR]), status[method], peers

    return each_page(rows, f"{HEAD}, peers {PEERS}", work)


PEER = ("peer", "state", "peer_token_start", "peer_token_end", "peer_text", "peer_text_truncated")


def passage_evidence(pages: DataFrame, panel: list[str], passage_tokens: int = 40) -> DataFrame:
    """A row for each passage of each method and each panel member; pages without text give none."""
    rows = passage_rows(pages, panel, passage_tokens)
    return rows.select(*[c for c in rows.columns if c != "peers"], F.inline("peers"))


PASSAGE = ["document", "page", "method", "passage"]
SHARED = ["token_start", "token_end", "text", "context_before", "context_after", "source_status"]


def family_state(states: Column) -> Column:
    """The state of a family whose members have ``states``: all must support, else the worst told."""
    has = lambda s: F.array_contains(states, s)
    return (
        F.when(F.forall(states, lambda x: x == "support"), "support").when(has("conflict") | (has("support") & has("missing")), "conflict")
        .when(has("ambiguous"), "ambiguous").when(has("unavailable"), "unavailable").otherwise("missing")
    )


def family_states(found: DataFrame, panel: DataFrame) -> DataFrame:
    """One state for each passage and family, from those of its members: all must support; else the worst told."""
    joined = found.join(F.broadcast(panel.select(F.col("method").alias("peer"), "family")), "peer")
    states = F.collect_set("state").alias("states")
    members = F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer", F.struct("state", "peer_token_start", "peer_token_end", "peer_text", "peer_text_truncated"))))).alias("members")
    grouped = joined.groupBy(*PASSAGE, "family").agg(*[F.first(c).alias(c) for c in SHARED], states, members)
    return grouped.withColumn("state", family_state(F.col("states"))).drop("states")


def passages(rows: DataFrame, panel: dict[str, str], families: DataFrame, required: int) -> DataFrame:
    """``passage_rows`` as one row for each passage: families by state, status and flags. ``panel`` gives each member's family."""
    of_family = lambda f: F.transform(F.filter("peers", lambda p: p["peer"].isin(*[m for m, x in panel.items() if x == f])), lambda p: p["state"])
    told = rows.withColumn("told", F.array(*[F.struct(F.lit(f).alias("family"), family_state(of_family(f)).alias("state")) for f in sorted(set(panel.values()))]))
    of = lambda s: F.transform(F.filter("told", lambda t: t["state"] == s), lambda t: t["family"])
    names = {"support": "supporting", "conflict": "conflicting", "ambiguous": "ambiguous", "missing": "missing", "unavailable": "unavailable"}
    grouped = told.select(*PASSAGE, *SHARED, *[of(s).alias(f"{n}_families") for s, n in names.items()], F.size("told").alias("total_family_count"), F.to_json("told").alias("family_evidence"))
    own = F.broadcast(families.groupBy("method").agg(F.collect_set("family").alias("own")))
    some = lambda c: F.size(c) > 0
    out = grouped.join(own, "method").withColumns({
        "supporting_family_count": F.size("supporting_families"), "required_family_count": F.lit(required),
        "other_family_support_count": F.size(F.array_except("supporting_families", "own")),
        "uncertainty_reasons": F.array_compact(F.array(F.when(F.size("supporting_families") < required, "insufficient_family_support"))),
        "flags": F.array_compact(F.array(
            F.when(some("conflicting_families"), "conflicting_readings"), F.when(some("ambiguous_families"), "ambiguous_alignment"), F.when(F.col("source_status") != "complete", "incomplete_source")
        )),
    }).drop("own")
    out = out.withColumn("status", F.when(some("uncertainty_reasons"), "uncertain").otherwise("corroborated"))
    return out.select(*PASSAGE, *[c for c in out.columns if c not in PASSAGE])


def page_counts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each page of each method: its passages by status, and the statuses of its sources. Passages and pages meet in one grouping, so both are made once."""
    flagged, uncertain = F.size("flags") > 0, F.col("status") == "uncertain"
    told = found.select(*UNIT, "method", F.lit(1).alias("passage"), uncertain.alias("uncertain"), flagged.alias("flagged"), (flagged & ~uncertain).alias("both"), "uncertainty_reasons", "flags")
    rows = told.unionByName(pages.select(*UNIT, "method", F.coalesce("status", F.lit("")).alias("source"), F.col("status").isNull().alias("unknown")), allowMissingColumns=True)
    return rows.groupBy(*UNIT, "method").agg(
        F.count("passage").alias("passages"), F.count_if("uncertain").alias("uncertain_passages"), F.count_if("flagged").alias("flagged_passages"), F.count_if("both").alias("corroborated_with_flags"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("uncertainty_reasons")))).alias("reasons"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("found_flags"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct(F.when(~F.col("unknown"), F.col("source")).alias("source_status")))).alias("sources"),
    )


def page_rollup(counts: DataFrame) -> DataFrame:
    """One row for each page of each method; a page without passages is uncertain, since no text was returned."""
    every = counts.select("*", F.inline("sources"))
    empty = F.col("passages") == 0
    lost = F.when(F.col("source_status") != "complete", F.array(F.lit("incomplete_source"))).otherwise(F.array().cast("array<string>"))
    return every.select(
        *UNIT, "method", "source_status", "passages", "uncertain_passages", "flagged_passages",
        F.when(empty | (F.col("uncertain_passages") > 0), "uncertain").otherwise("corroborated").alias("status"), empty.alias("empty_output"),
        F.when(empty, F.array(F.lit("no_text_returned"))).otherwise(F.col("reasons")).alias("uncertainty_reasons"), F.when(empty, lost).otherwise(F.col("found_flags")).alias("flags"),
    )


def summary(counts: DataFrame) -> DataFrame:
    """One row of counts, zeros filled in."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return counts.agg(
        total(F.col("passages") - F.col("uncertain_passages")).alias("corroborated"), total("uncertain_passages").alias("uncertain"), total("flagged_passages").alias("flagged_passages"),
        total("corroborated_with_flags").alias("corroborated_with_flags"), total(F.when(F.col("passages") == 0, F.size("sources")).otherwise(0).cast("long")).alias("empty_page_outputs"),
    )


def required_families(panel: DataFrame, min_families: int, min_fraction: float) -> int:
    return max(min_families, math.ceil(min_fraction * panel.select("family").distinct().count()))


def corroborate(pages: DataFrame, families: DataFrame, panel: DataFrame, *, min_families: int = 2, min_fraction: float = 0.0, passage_tokens: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, pages, summary). The panel's members must be methods of one family each."""
    check_policy(min_families, min_fraction, passage_tokens)
    members = panel.select("method", "family").collect()
    voters = [r["method"] for r in members]
    if not voters or len(voters) != len(set(voters)):
        raise ValueError("the panel must name distinct methods")
    if families.join(F.broadcast(panel.select("method")), "method", "left_semi").groupBy("method").count().where("count > 1").take(1):
        raise ValueError("a method of several families can't vote")
    rows = passage_rows(pages, voters, passage_tokens)
    found = passages(rows, {r["method"]: r["family"] for r in members}, families, required_families(panel, min_families, min_fraction))
    counts = page_counts(pages, found)
    return found, page_rollup(counts), summary(counts)


def flat(found: DataFrame) -> DataFrame:
    """Passages for a table of text: lists joined, evidence left out."""
    lists = {f.name for f in found.schema.fields if f.dataType.typeName() == "array"}
    shown: list[Column] = [F.array_join(c, "; ").alias(c) if c in lists else F.col(c) for c in found.columns if c != "family_evidence"]
    return found.select(*shown)


def ranking(found: DataFrame, page_scores: DataFrame, document_scores: DataFrame) -> DataFrame:
    """(method, score, document_score, passage counts), best first, methods without a score last. Document-only methods have no passages, so nulls."""
    counts = found.groupBy("method").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if(F.col("status") == "corroborated").alias("corroborated"), F.count_if(F.size("flags") > 0).alias("flagged")
    )
    out = document_scores.select("method", F.col("score").alias("document_score")).join(page_scores, "method", "left").join(counts, "method", "left")
    return out.orderBy(F.col("score").desc_nulls_last(), "method")
