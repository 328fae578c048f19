"""Quality rules: text statistics and a learned decision list. DataFrame functions only.

``text_statistics`` computes per-document counts inside the row, without a shuffle. ``learn_rules``
fits an ordered list of threshold conjunctions to labelled documents by sequential covering:

* *grow*: on two thirds of the rows, add the condition (statistic, side, threshold) with the best
  FOIL gain until no good document is covered or nothing gains; thresholds are quantiles, and one
  grouped aggregation per step counts all of them;
* *prune*: on the other third, cut the conjunction back to its best prefix;
* a rule stays if its precision reaches ``min_precision`` on the growing part and, Laplace-corrected, on
  the pruning part, which it was not grown on (at 0.9 that asks for eight covered rows there or
  more); the rows it covers are set aside and the next rule is grown on the rest.

The result is a list of :class:`Rule`, each a readable conjunction and a Spark condition;
``first_rule`` turns the list into one ordered conditional expression.

Bound: the rules are fitted on ``max_labelled`` labelled documents in expectation, drawn by a hash of
the id (so reruns agree); statistics and verdicts cover every document.

Defined results: null text has zero words and fails the base rule; documents without a label, or with
a null id or null label, teach nothing; a repeated label row counts once, as bad if any is; with no
labelled document of either kind the list is empty and the base rule alone decides; ties between
conditions go to the statistic first by name, then the lower threshold; extra columns stay.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

BLANK = "[\\x20\\x09-\\x0D]"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleSettings:
    max_labelled: int = 20_000
    max_rules: int = 6
    max_conditions: int = 3
    quantiles: int = 24
    min_precision: float = 0.9
    min_words: int = 20
    max_repeat_pct: int = 30


@dataclass(frozen=True)
class Rule:
    """(statistic, '>=' or '<', threshold) conditions that all hold for a rejected document."""

    conditions: tuple[tuple[str, str, float], ...]

    def matches(self) -> Column:
        return _all(self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{name} {side} {at:.4g}" for name, side, at in self.conditions)


def _condition(name: str, side: str, at: float) -> Column:
    return F.col(name) >= F.lit(at) if side == ">=" else F.col(name) < F.lit(at)


def _all(conditions) -> Column:
    return reduce(operator.and_, [_condition(*c) for c in conditions], F.lit(True))


# -- statistics ------------------------------------------------------------------------------------


def _pairs(hashes: str, step: int) -> Column:
    """Hashes of windows twice as long, from the hashes of windows of ``step`` words."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` and the learnable ratios to every document.

    Words of repeated 8-word windows are found inside the row: window hashes by doubling (1, 2, 4, 8
    words), equal neighbours after sorting, then the length of the union of their windows. The sort
    runs only in documents where the distinct windows are fewer than the windows.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), body.alias("body"))
    rows = rows.select("row", "body", F.transform(
        F.filter(F.split("body", BLANK + "+", -1), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h1"),
        F.transform(F.filter(F.split("body", "\n", -1), lambda x: x.rlike(NOT_BLANK)), lambda x: F.xxhash64(x)).alias("lines"))
    rows = rows.select("row", F.size("h1").cast("long").alias("n_words"), "h1",
                       (F.length("body") - F.regexp_count("body", F.lit(BLANK))).cast("long").alias("word_chars"),
                       F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                       F.regexp_count("body", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
                       F.regexp_count("body", F.lit("!")).cast("long").alias("n_bangs"),
                       F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    n = F.greatest(F.size("h1") - 1, F.lit(0))
    twins = F.filter(F.zip_with(F.slice("h1", F.lit(1), n), F.slice("h1", F.lit(2), n), lambda a, b: a == b), lambda x: x)
    rows = rows.withColumn("n_twins", F.size(twins))
    for step, (a, b) in {1: ("h1", "h2"), 2: ("h2", "h4"), 4: ("h4", "h8")}.items():
        rows = rows.withColumn(b, _pairs(a, step)).drop(a)
    rows = rows.withColumn("sorted", F.when(
        F.size(F.array_distinct("h8")) < F.size("h8"),
        F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h8")
    n = F.greatest(F.size("sorted") - 1, F.lit(0))
    rows = rows.withColumn("equal", F.zip_with(
        F.slice("sorted", F.lit(1), n), F.slice("sorted", F.lit(2), n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))).drop("sorted")
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(F.flatten("equal")))).drop("equal")
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, p: F.struct((p + 8).alias("end"), (acc["total"] + p + 8 - F.greatest(p, acc["end"])).alias("total")),
        lambda acc: acc["total"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ratios = {
        "bang_ratio": F.col("n_bangs") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "mean_word_chars": F.col("word_chars") / words, "repeat_ratio": F.col("n_repeat_words") / words,
        "symbol_ratio": F.col("n_symbols") / words, "twin_ratio": F.col("n_twins") / words, "upper_ratio": F.col("n_upper") / chars}
    added = [*COUNTS, *RATIOS]
    # a generator of one row: filters on statistics stay above it instead of repeating their expressions below
    out = rows.select("row", F.struct(*COUNTS, *[v.alias(k) for k, v in ratios.items()]).alias("found"))
    out = out.select("row", F.inline(F.array("found")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


RATIOS = ("bang_ratio", "dup_line_ratio", "mean_word_chars", "repeat_ratio", "symbol_ratio", "twin_ratio", "upper_ratio")


def base_failed(s: RuleSettings = RuleSettings()) -> Column:
    return (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_pct * F.col("n_words"))


# -- learning --------------------------------------------------------------------------------------


def _labelled(docs: DataFrame, labels: DataFrame, s: RuleSettings, key: str, text: str, label_id: str, bad: Column) -> DataFrame:
    """Statistics of the sampled labelled documents that pass the base rule: ratios, bad, grow."""
    known = (labels.select(F.col(label_id).cast("long").alias("doc_id"), bad.alias("bad")).filter("doc_id IS NOT NULL AND bad IS NOT NULL")
             .groupBy("doc_id").agg(F.max("bad").alias("bad")))
    total = known.count()
    unit = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(unit < s.max_labelled / max(total, 1))
    # the sample is bounded by the parameter (two numbers a row), so it may be sent to every task
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    return stored(text_statistics(rows).filter(~base_failed(s)).select(
        *RATIOS, F.col("bad").cast("int").alias("bad"), grow.alias("grow")), "labelled")


def _thresholds(rows: DataFrame, s: RuleSettings) -> dict[str, list[float]]:
    """Candidate thresholds per statistic: quantiles, from the minimum, of all rows and of the bad rows."""
    at = [i / s.quantiles for i in range(s.quantiles)]
    found = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in RATIOS],
                     *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(c)), at, 10_000).alias(f"bad_{c}") for c in RATIOS]).first()
    return {c: sorted({*(found[c] or []), *(found[f"bad_{c}"] or [])}) for c in RATIOS}


def _best_condition(rows: DataFrame, conditions, thresholds: dict[str, list[float]]):
    """The condition of the greatest FOIL gain over the rows the conjunction covers, or None.

    Rows are counted per (statistic, threshold interval) in one aggregation; running sums over the few
    intervals give both sides of every threshold.
    """
    covered = rows.filter(_all(conditions))
    places = [F.struct(F.lit(c).alias("name"), reduce(
        operator.add, [(F.col(c) >= F.lit(t)).cast("int") for t in thresholds[c]]).alias("place"))
        for c in RATIOS if thresholds[c]]
    if not places:
        return None
    cells = (covered.select("bad", F.explode(F.array(*places)).alias("at"))
             .groupBy("at.name", "at.place").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
    best = None  # the cells are at most one for each statistic and interval
    for name in RATIOS:
        own = sorted((r["place"], r["p"], r["n"]) for r in cells if r["name"] == name)
        p_all, n_all = sum(r[1] for r in own), sum(r[2] for r in own)
        if not p_all or not n_all:
            continue
        for k, at in enumerate(thresholds[name], 1):
            above = (sum(r[1] for r in own if r[0] >= k), sum(r[2] for r in own if r[0] >= k))
            for side, (p, n) in ((">=", above), ("<", (p_all - above[0], n_all - above[1]))):
                gain = _foil_gain(p, n, p_all, n_all)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, (name, side, at))
    return best and best[1]


def _foil_gain(p: int, n: int, p_all: int, n_all: int) -> float:
    import math

    return p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all))) if p else 0.0


def _precision(p, n) -> float:
    return (p or 0) / max(1, (p or 0) + (n or 0))


def learn_rules(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings(), key: str = "doc_id",
                text: str = "text", label_id: str = "doc_id", bad: Column | None = None) -> list[Rule]:
    """Ordered rules that reject documents; ``bad`` tells a bad label row (default: quality 0)."""
    s = settings
    bad = F.col("quality") == 0 if bad is None else bad
    rows = _labelled(docs, labels, s, key, text, label_id, bad)
    rules: list[Rule] = []
    while len(rules) < s.max_rules:
        rest = rows.filter(~_any(rules))
        grow, prune = rest.filter("grow"), rest.filter("NOT grow")
        thresholds = _thresholds(rest, s)
        conditions: list[tuple[str, str, float]] = []
        while len(conditions) < s.max_conditions:
            found = _best_condition(grow, conditions, thresholds)
            if found is None:
                break
            conditions.append(found)
        if not conditions:
            break
        prefixes = [tuple(conditions[:k]) for k in range(1, len(conditions) + 1)]
        sums = [F.sum(F.when(_all(c), v)) for c in prefixes for v in (F.col("bad"), 1 - F.col("bad"))]
        held, grown = prune.agg(*sums).first(), grow.agg(*sums).first()
        scores = [(_precision(held[2 * k], held[2 * k + 1]), -k) for k in range(len(prefixes))]
        k = -max(scores)[1]
        p, n = held[2 * k] or 0, held[2 * k + 1] or 0
        if (p + 1) / (p + n + 2) < s.min_precision or _precision(grown[2 * k], grown[2 * k + 1]) < s.min_precision:
            break
        rules.append(Rule(prefixes[k]))
    return rules


def _any(rules: list[Rule]) -> Column:
    return reduce(operator.or_, [r.matches() for r in rules], F.lit(False))


def first_rule(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that matches, else null: the ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].matches(), k).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule], settings: RuleSettings = RuleSettings(), text: str = "text") -> DataFrame:
    """The documents with statistics, base_failed, ``rule`` (the learned rule that rejects it) and kept."""
    rows = text_statistics(docs, text).withColumn("base_failed", base_failed(settings))
    return rows.withColumn("rule", first_rule(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
