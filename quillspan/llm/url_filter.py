"""Operator 9: URL filter by a ratio of character language models.

Host and path rules decide first. Urls that a rule allows or blocks are also the
labels for two Witten-Bell smoothed variable-order Markov models, which count
every one of them; a url without a rule is allowed if its log-likelihood ratio
per byte (accepted against rejected) reaches a threshold. The threshold is
calibrated on all labels as well: they are dealt to folds by a hash of the url,
and each is rated by models of the other folds, which haven't seen it. Row-local
apart from counting the labels and their rates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, hot_join, partitions, per_text, slices, written
from .context_model import ContextModel, spread

#: The models' classes, and the number of folds that the threshold's rates are made in.
VERDICTS, FOLDS = ("allow", "block"), 4
#: Models of more different grams than these aren't broadcast; rows meet them by joins.
MOST_GRAMS = 250_000
#: The joined models' nodes of 3 bytes are broadcast if there are no more than these, else those of 2, of which there are 65,536 at most.
MOST_SHORT = 250_000
#: So many different grams of the joined models are costed together, on average.
TOGETHER = 100_000
#: Rates are counted in steps of this width first, one by one only where the threshold may be.
STEP = 1e-3


class Grams(NamedTuple):
    """Models as a table (key, allow, block) of how often each gram occurs, with its number of rows and their order."""

    table: DataFrame
    size: int
    order: int


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule], value: str) -> Column:
    """The ``value`` (name or verdict) of the longest rule that fits; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, getattr(r, value)) if out is None else out.when(fits, getattr(r, value))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def rate(model: ContextModel, urls: list[bytes]) -> np.ndarray:
    """Log2-likelihood ratio per byte, accepted against rejected; 0 for an empty url."""
    bits = model.bits(urls)
    return (bits[:, model.classes.index("block")] - bits[:, model.classes.index("allow")]) / np.maximum(1, [len(u) for u in urls])


def coded(url: str | None) -> bytes:
    """What the models read of a url."""
    return (url or "").lower().encode("utf-8", "surrogatepass")


def least_error(lo: np.ndarray, hi: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold of least balanced error between ascending ranges lo to hi of rates, which hold so many good and bad urls each.

    It is midway between two ranges, or just outside all of them; of several the nearest to 0.
    """
    cuts = np.concatenate([[lo[0] - 1e-9], (lo[1:] + hi[:-1]) / 2, [hi[-1] + 1e-9]])
    error = errors(good, bad)
    best = cuts[error <= error.min() + 1e-12]
    return float(best[np.abs(best).argmin()])


def errors(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The balanced error of a threshold below each range, then above the last: the share of the good below it and of the bad above it."""
    below = [np.concatenate([[0], np.cumsum(x)]) for x in (good, bad)]
    return below[0] / below[0][-1] + 1 - below[1] / below[1][-1]


def calibrated(model: ContextModel, held: dict[str, list[bytes]]) -> float:
    """The threshold of least balanced error on urls held here."""
    good, bad = rate(model, held["allow"]), rate(model, held["block"])
    values = np.unique(np.concatenate([good, bad]))
    of = [np.bincount(np.searchsorted(values, x), minlength=len(values)) for x in (good, bad)]
    return least_error(values, values, *of)


def threshold(rates: DataFrame) -> float:
    """The threshold of least balanced error on all rates of a table (ratio, good, bad), a row for each rate with its numbers of urls.

    The driver gets the numbers by steps of STEP, then the single rates of those
    steps in which a threshold may be as good as the best one between steps.
    """
    step = F.floor(F.col("ratio") / STEP)
    sums = [F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    coarse = rates.groupBy(step.alias("step")).agg(*sums).toArrow().to_pandas().sort_values("step")
    good, bad = coarse["good"].to_numpy(), coarse["bad"].to_numpy()
    error = errors(good, bad)
    inside = error[:-1] - bad / bad.sum()  # no threshold within the step can be better
    open_steps = coarse["step"].to_numpy()[(inside <= error.min() + 1e-9) & (coarse["lo"] < coarse["hi"]).to_numpy()]
    chosen = rates.sparkSession.createDataFrame([(int(x),) for x in open_steps], "step long")
    fine = rates.withColumn("step", step).join(F.broadcast(chosen), "step").toArrow().to_pandas()
    rest = coarse[~coarse["step"].isin(open_steps)]
    lo, hi, good, bad = (np.concatenate([rest[c], fine[f]]) for c, f in (("lo", "ratio"), ("hi", "ratio"), ("good", "good"), ("bad", "bad")))
    order = np.argsort(lo)
    return least_error(lo[order], hi[order], good[order], bad[order])


def counted(labelled: DataFrame, order: int) -> DataFrame:
    """(key, c0, c1, ...): every gram of every url of (place, url), and how often it occurs in each place."""
    schema = arrow_schema("key long, place int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                place = part.column(0).to_numpy()
                keys, owner = spread([coded(u) for u in part.column(1).to_pylist()], order)
                for p in np.unique(place):
                    grams, n = np.unique(keys[place[owner] == p], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), p, np.int32)), pa.array(n)], schema=schema)

    found = labelled.select("place", "url").mapInArrow(run, "key long, place int, n long")
    of = [F.sum(F.when(F.col("place") == p, F.col("n")).otherwise(0)).alias(f"c{p}") for p in range(len(VERDICTS) * FOLDS)]
    return found.groupBy("key").agg(*of)


def model_of(counts: DataFrame, order: int, without: int | None = None) -> ContextModel | Grams:
    """The models of all folds, or of all but one."""
    n = [sum((F.col(f"c{len(VERDICTS) * f + j}") for f in range(FOLDS) if f != without), F.lit(0)).alias(v) for j, v in enumerate(VERDICTS)]
    grams = counts.select("key", *n).where(F.col("allow") + F.col("block") > 0)
    if (size := grams.count()) > MOST_GRAMS:
        return Grams(grams, size, order)
    return ContextModel.counted(arrays(grams.toArrow()), order, blend=True)


def arrays(grams: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The keys and numbers of either verdict."""
    keys = grams["key"].to_numpy().view(np.uint64)
    each = {v: grams[v].to_numpy() for v in VERDICTS}
    return {v: (keys[n > 0], n[n > 0]) for v, n in each.items()}


def train(pages: DataFrame, url: str, verdict: str, key: str, order: int = 5) -> tuple[ContextModel | Grams, float] | None:
    """(models, threshold) of all urls with a verdict, or None unless either verdict has two urls at least.

    Repeated urls are in one fold, whatever their ``key``. Where all urls of a
    verdict are in one fold, the models of all folds rate it.
    """
    place = len(VERDICTS) * F.pmod(F.xxhash64(F.col(url)), F.lit(FOLDS)) + F.when(F.col(verdict) == "block", 1).otherwise(0)
    mine = pages.where(F.col(verdict).isin(*VERDICTS) & F.col(url).isNotNull())
    labelled = written(mine.select(place.cast("int").alias("place"), F.col(url).alias("url")))
    sizes = np.zeros((FOLDS, len(VERDICTS)), dtype=np.int64)
    for r in labelled.groupBy("place").count().collect():
        sizes[divmod(r["place"], len(VERDICTS))] = r["count"]
    if sizes.sum(axis=0).min() < 2:
        return None
    counts = written(counted(labelled, order))
    block, rates = F.col("place") % len(VERDICTS), []
    for f in map(int, np.flatnonzero(sizes.sum(axis=1))):
        others = (sizes.sum(axis=0) - sizes[f]).min() > 0
        sent = shared(pages, model_of(counts, order, f if others else None))
        fold = rated(labelled.where(F.col("place").isin(*range(len(VERDICTS) * f, len(VERDICTS) * (f + 1)))), sent, "url", ["place"])
        rates.append(written(fold.groupBy("ratio").agg(F.sum(1 - block).alias("good"), F.sum(block).alias("bad"))))
        if isinstance(sent, Broadcast):
            sent.destroy()
    each = reduce(DataFrame.union, rates).groupBy("ratio").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return model_of(counts, order), threshold(each)


def shared(df: DataFrame, models: ContextModel | Grams | None) -> Broadcast | Grams:
    return models if isinstance(models, Grams) else df.sparkSession.sparkContext.broadcast(models)


def rated(df: DataFrame, models: Broadcast | Grams, url: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then ratio, to six places; 0 for an empty or null url, and without models."""
    if isinstance(models, Grams):
        return joined(df, models, url, keep)

    def run(urls):
        return [np.round(rate(models.value, [coded(u) for u in urls]), 6) if models.value else np.zeros(len(urls))]

    return per_text(df, url, keep, "ratio double", run)


def joined(df: DataFrame, models: Grams, url: str, keep: list[str]) -> DataFrame:
    """The same as ``rated`` with models of any size.

    What a gram costs depends on shorter grams, and on those that have the same few
    bytes before the last: the short ones are broadcast, the others dealt by a hash
    of these bytes. The costs then come to the rows' grams by a join.
    """
    order = models.order
    within = lambda key, n: key.bitwiseAND(F.lit((1 << 8 * n) - 1))
    base = 3 if models.table.select(within(F.col("key"), 3)).distinct().count() <= MOST_SHORT else 2
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"), *keep))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys, owner = spread([coded(u) for u in part.column(1).to_pylist()], order)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(keys.view(np.int64))], names=["row", "key"])

    grams = rows.select("row", "url").mapInArrow(split, "row long, key long")
    low = models.table.groupBy(within(F.col("key"), base).alias("key")).agg(*[F.sum(v).alias(v) for v in VERDICTS]).toArrow()
    sent = df.sparkSession.sparkContext.broadcast(ContextModel.counted(arrays(low), base - 1, blend=True))

    def cost(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"key": asked["key"], "n": asked["n"], "more": pa.array([], pa.float64())})
        model = ContextModel.counted(arrays(known), order, True, sent.value)
        bits = model.each(asked["key"].to_numpy().view(np.uint64))
        more = bits[:, model.classes.index("block")] - bits[:, model.classes.index("allow")]
        return pa.table({"key": asked["key"], "n": asked["n"], "more": pa.array(more)})

    group = F.pmod(F.xxhash64(within(F.shiftright("key", 8), base)), F.lit(max(partitions(df), models.size // TOGETHER)))
    asked = grams.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("group", group).groupBy("group")
    known = models.table.withColumn("group", group).groupBy("group")
    costs = written(asked.cogroup(known).applyInArrow(cost, "key long, n long, more double"))
    sums = hot_join(grams, costs, "key", "n", F.col("row")).groupBy("row").agg(F.round(F.sum("more") / F.count(F.lit(1)), 6).alias("ratio"))
    return rows.join(sums, "row", "left").select(*keep, F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, ratio) for every row.

    A null url has an empty host and path, no rule, and ratio 0. Where the rules
    label urls of one verdict only, or none, urls without a rule are allowed; so
    they are with less than two labels of either verdict. Very long urls are
    counted and rated whole. Repeated rows are judged each, and counted each where
    they are labels; extra columns are ignored.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"))
    judged = slim.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumns({v: rule_of(F.col("host"), F.col("path"), rules, c) for v, c in (("rule", "name"), ("by_rule", "verdict"))})
    made = train(judged, "url", "by_rule", "page_id")
    sent = shared(pages, made[0] if made else None)
    asked = judged.withColumn("asked", F.when(F.col("rule").isNull(), F.col("url")))
    done = rated(asked, sent, "asked", ["page_id", "host", "path", "rule", "by_rule"])
    least = made[1] if made else 0.0
    verdict = F.coalesce("by_rule", F.when(F.col("ratio") >= least, "allow").otherwise("block"))
    return done.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
