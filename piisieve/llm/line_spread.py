"""Cross-site boilerplate lines by distinct-site spread.

Every line with a word (outer blanks trimmed) is keyed by two independent 64-bit hashes. One aggregation
merges a HyperLogLog sketch of the sites per line (partial sketches before the shuffle), so a line
costs a small bounded state however many sites hold it. Lines whose estimate is near the limit (five
standard deviations and one site around it) get an exact distinct count; the others are far enough
from it to be decided by their sketch. A line on ``min_sites`` sites or more is boilerplate: it is
removed from every document but the one with the smallest doc_id that holds it.

Defined results: null or empty texts have no lines and stay; a null site counts as one site of its
own; lines without a word are never removed; rows with a null doc_id count towards the spread but
lose nothing, and hold no line for others; rows that share a doc_id count as one document; a removed
line takes its line feed with it; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

BLANKS = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class LineSpreadSettings:
    min_sites: int = 10
    lg_k: int = 12

    @property
    def margin(self) -> float:
        """Five standard errors of an estimate at the limit, and one site."""
        return 1 + 5 * 1.04 / 2 ** (self.lg_k / 2) * self.min_sites


def _lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(doc_id, t, pos, h1, h2, site) of every line with a word; t is a hash of the whole text."""
    trimmed = F.btrim("line", F.lit(BLANKS))
    return (docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("\x00none")).alias("site"),
                        F.xxhash64(text).alias("t"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
            .select("doc_id", "t", "pos", "site", trimmed.alias("line")).filter("line <> ''")
            .select("doc_id", "t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site"))


def boilerplate_lines(docs: DataFrame, settings: LineSpreadSettings = LineSpreadSettings(), key: str = "doc_id",
                      text: str = "text", site: str = "source") -> DataFrame:
    """(h1, h2, first_doc) of the lines that ``min_sites`` distinct sites hold."""
    s = settings
    lines = _lines(docs, key, text, site)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(s.lg_k))).alias("sites"),
                                           F.min("doc_id").alias("first_doc"))
    likely = stored(spread.filter(F.col("sites") >= s.min_sites - s.margin), "spread")
    near = likely.filter(F.col("sites") <= s.min_sites + s.margin)
    exact = (lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
             .groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= s.min_sites))
    return stored(likely.filter(F.col("sites") > s.min_sites + s.margin)
                  .unionByName(near.join(exact, ["h1", "h2"], "left_semi")).select("h1", "h2", "first_doc"), "boilerplate")


def remove_boilerplate(docs: DataFrame, settings: LineSpreadSettings = LineSpreadSettings(), key: str = "doc_id",
                       text: str = "text", site: str = "source", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``; the number of lines there were and of
    lines removed in ``n_lines`` and ``n_removed`` (columns of these names are replaced)."""
    boilerplate = boilerplate_lines(docs, settings, key, text, site)
    cuts = (_lines(docs, key, text, site).join(boilerplate, ["h1", "h2"]).filter("doc_id > first_doc")
            .groupBy("doc_id", "t").agg(F.collect_set("pos").alias("cuts")))
    others = [c for c in docs.columns if c not in (text, n_lines, n_removed)]
    # the text travels as its lines, split below the join so that it is split once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(key).alias("doc_id"),
                       F.xxhash64(text).alias("t"), F.split(F.col(text), "\n", -1).alias("lines"))
    kept_at: Column = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cuts")
    kept = F.when(F.col("cuts").isNull(), F.col("lines")).otherwise(
        F.transform(kept_at, lambda p: F.element_at("lines", p + 1)))
    removed = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long")
    before = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return (rows.join(cuts, ["doc_id", "t"], "left")
            .select("row", F.array_join(kept, "\n").alias("kept"), before.alias("before"), removed.alias("gone"))
            .select("row.*", F.col("kept").alias(text), F.col("before").alias(n_lines), F.col("gone").alias(n_removed))
            .select(*[f"`{c}`" for c in docs.columns if c not in (n_lines, n_removed)], n_lines, n_removed))
