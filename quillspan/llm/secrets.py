"""Operator 4 [native]: secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
what every match must contain. The index is a table of postings (trigram, text)
over the lower-cased texts, kept for the trigrams that some rule asks for;
grouping the postings by text intersects the lists, and the queries turn them
into candidates. Only candidates meet the rule's regular expression; a rule
without a mandatory trigram (one of a bare character class) scans every text.

DataFrame functions only. Spans come without a search for positions: the lengths
of what lies between the matches and of the matches, summed up from the left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from re import _constants as K
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


class Rule(NamedTuple):
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; shorter ones are passed over, but use up their text."""

    kind: str
    pattern: str
    group: int
    least: int


#: The three base kinds, in order, then the kinds that are added.
#: A run of hex digits, or of capitals and digits after AKIA, is maximal, so asking for its length in the pattern drops the same matches.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}+", 0, 16),
)
#: A private key runs from its BEGIN line to its END line. Where another BEGIN or END, or none, comes first, it runs over the
#: header lines and the runs of base64 that follow, of which an earlier rule may have masked a part; the last may be short.
GAP = r"(?:\s|\\[nr])"
KEY_HEADERS = rf"(?:{GAP}++(?:Proc-Type|DEK-Info):[^\r\n]*+)*+"
KEY_BODY = rf"(?:{KEY_HEADERS}(?:{GAP}*+(?:[A-Za-z0-9+/=\[\]]{{16,}}+|\[SECRET\]))++(?:{GAP}++[A-Za-z0-9+/]++(?:=++|(?=[\r\n]|$)))?+)?"
ADDED = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----|{KEY_BODY})", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + ADDED
MASK = "[SECRET]"

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple[str, tuple]
MOST_LITERALS = 64


def both(kind: str, parts: Sequence[Query]) -> Query:
    """``parts`` joined by ``kind``, simplified."""
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or" and (True in flat or not flat):
        return True
    flat = list(dict.fromkeys(p for p in flat if p is not True))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def holds(literals: set[str]) -> Query:
    """What a text with one of ``literals`` in it must contain."""
    return both("or", [both("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(literals)])


def literals(op, arg) -> set[str] | None:
    """All strings that a node matches, in lower case, if they are few."""
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN and arg[0][0] is not K.NEGATE and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 4:
        return {chr(a).lower() for _, a in arg}
    if op is K.SUBPATTERN:
        return sequence(arg[3])[0]
    if op is K.BRANCH:
        each = [sequence(x)[0] for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1:
        inner = sequence(arg[2])[0]
        return None if inner is None else inner | {""} if arg[0] == 0 else inner
    return None


def sequence(items) -> tuple[set[str] | None, Query]:
    """(all strings matched, if few; what every match contains) of nodes one after another."""
    exact, run, found = True, {""}, []
    for op, arg in items:
        words = literals(op, arg)
        if words is not None and len(run) * len(words) <= MOST_LITERALS:
            run = {a + b for a in run for b in words}
            continue
        found.append(holds(run))
        exact, run = False, {""}
        if words is not None:
            run = words
        elif op is K.BRANCH:
            found.append(both("or", [sequence(x)[1] for x in arg[1]]))
        elif op is K.SUBPATTERN:
            found.append(sequence(arg[3])[1])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(sequence(arg[2])[1])
    found.append(holds(run))
    return (run if exact else None), both("and", found)


def trigram_query(pattern: str) -> Query:
    return sequence(_parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def met(query: Query, number: dict[str, int], present: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(present, number[query])
    parts = [met(q, number, present) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(text: Column, rule: Rule) -> Column:
    """An array of (gap, hit, kept): what lies before each match, the match, and whether it is long enough; last what follows, without a hit."""
    hit = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = hit if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hit.alias("hit"), value.alias("value"))
    return F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), (F.length(z["value"]) >= rule.least).alias("kept")))


CHUNK = 256
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans (code points, end exclusive). Sums run within chunks, and over the chunks, so a text of very many matches stays cheap."""
    empty = F.array().cast(SPAN)
    sizes = F.transform(
        F.filter(parts(text, rule), lambda p: p["hit"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["hit"]).cast("long").alias("hit"), p["kept"].alias("kept")),
    )
    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, p: a + p["gap"] + p["hit"])

    def within(chunk: Column, start: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            at = a["at"] + p["gap"]
            span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + p["hit"]).alias("end"))
            return F.struct((at + p["hit"]).alias("at"), F.when(p["kept"], F.concat(a["out"], F.array(span).cast(SPAN))).otherwise(a["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(start.alias("at"), empty.alias("out")), step, lambda a: a["out"])

    def chunked(z: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: F.slice(z, c * CHUNK + 1, F.lit(CHUNK)))

        def summed(cs: Column) -> Column:
            starts = F.aggregate(cs, F.array(F.lit(0).cast("long")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + total(c))))
            return let(starts, lambda s: F.flatten(F.transform(cs, lambda c, i: within(c, F.get(s, i)))))

        return F.when(F.size(z) == 0, empty).otherwise(let(chunks, summed))

    return let(sizes, chunked)


def masked(text: Column, rule: Rule) -> Column:
    """``text`` with the rule's spans replaced."""
    each = lambda p: F.concat(p["gap"], F.when(p["hit"].isNull(), "").when(p["kept"], MASK).otherwise(p["hit"]))
    return F.array_join(F.transform(parts(text, rule), each), "")


def postings(docs: DataFrame, key: Column, text: Column, grams: Sequence[str]) -> DataFrame:
    """(key, trigram number) for each of ``grams`` that a text has in lower case: each text is lower-cased once."""
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(grams)])
    present = let(F.lower(text), lambda t: F.transform(F.filter(numbered, lambda g: F.contains(t, g["g"])), lambda g: g["i"]))
    return docs.select(key.alias("key"), F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: Sequence[Query], grams: Sequence[str]) -> DataFrame:
    """(key, may): for each text that some query lets through, an array of whether each does. A list is as long as ``grams`` at most."""
    number = {g: i for i, g in enumerate(grams)}
    lists = index.groupBy("key").agg(F.collect_set("trigram").alias("present"))
    may = F.array(*[met(q, number, F.col("present")) for q in queries])
    return lists.select("key", may.alias("may")).where(F.exists("may", lambda x: x))


def with_candidates(docs: DataFrame, id_col: str, text: str, rules: Sequence[Rule]) -> tuple[DataFrame, str, list[Column]]:
    """(docs with one more column, its name, whether each rule may match a row).

    The key is a hash of id and text: of two rows with the same key either's
    candidates are both's, so a collision costs a needless check, never a match.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    asked = [i for i, q in enumerate(queries) if q is not True]
    may = fresh(docs, "may")
    if not asked:
        return docs.withColumn(may, F.lit(None).cast("array<boolean>")), may, [F.lit(True)] * len(rules)
    grams = sorted(set().union(*(trigrams(queries[i]) for i in asked)))
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    found = candidates(postings(docs, key, F.coalesce(F.col(f"`{text}`"), F.lit("")), grams), [queries[i] for i in asked], grams)
    name = fresh(docs, "key")
    found = found.withColumnRenamed("key", name).withColumnRenamed("may", may)
    joined = docs.withColumn(name, key).join(found, name, "left").drop(name)
    place = {i: k for k, i in enumerate(asked)}
    return joined, may, [F.coalesce(F.get(F.col(may), F.lit(place[i])), F.lit(False)) if i in place else F.lit(True) for i in range(len(rules))]


def scan(docs: DataFrame, name: str = "spans", id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the column ``name``: the spans of all rules, by start, then in the order of the rules.

    Null texts count as empty and have no spans; repeated rows and rows that share
    an id are scanned each; extra columns pass through.
    """
    joined, may, hits = with_candidates(docs, id_col, text, rules)
    value, empty = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.array().cast(SPAN)
    found = F.array_sort(F.concat(*[F.when(hit, spans(value, r, i)).otherwise(empty) for i, (r, hit) in enumerate(zip(rules, hits, strict=True))]))
    return joined.withColumn(name, found).drop(may)


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every span of every rule replaced in the text, rule after rule. Null texts stay null."""
    joined, may, hits = with_candidates(docs, id_col, text, rules)
    columns = joined.columns
    for rule, hit in zip(rules, hits, strict=True):
        now = F.col(f"`{text}`")
        joined = joined.withColumn(text, F.when(hit & now.isNotNull(), masked(now, rule)).otherwise(now))
    return joined.select(*[F.col(f"`{c}`") for c in columns if c != may])


def digest(docs: DataFrame, base: int = len(BASE)) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    found = scan(docs.select("doc_id", "text"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    first = F.filter("spans", lambda s: s["rank"] < base)
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(first), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
