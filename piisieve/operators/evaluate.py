"""Occurrences -> one prediction per word -> labels -> tp/fp/fn -> precision / recall / F-beta.

Plan shape: explode (narrow) -> confident-outside filter (narrow, before the mean: it changes
the mean) -> one hash aggregate on (document, token) with map-side partial sums of every class
-> narrow argmax / threshold -> cogroup with the gold words on (document, token), reusing the
aggregate's partitioning -> aggregates over at most a few dozen entity types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import argmax_entity, outside_prob, posexplode_rows, round_half_away
from ..functions.labels import entity_type, id_label, taxonomy
from ..functions.metrics import prf_columns
from ..settings import CUT_TOKEN_MODEL
from .indexing import require_unique, with_row_index

KEYS = ["document", "token"]


# ----------------------------------------------------------------------------- occurrences
def explode_occurrences(df: DataFrame, word_ids: str = "word_ids", probs: str = "probs") -> DataFrame:
    """A2: zip-explode (word id, probability vector) per window piece -> (document, token, probs)."""
    z = F.arrays_zip(F.col(word_ids).alias("token"), F.col(probs).alias("probs"))
    return df.select("document", F.inline(z))


def _word_sums(n: int, half_away):
    """Batches of (document, token, probs) in document order -> one row per word with its count and its sums."""
    def sums(parts):
        import numpy as np
        import pyarrow as pa

        document, token, probs = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((token, document))
        document, token = document[order], token[order]
        first = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (token[1:] != token[:-1])))
        total = half_away(np.add.reduceat(probs[order], first, axis=0)).T
        words = pa.RecordBatch.from_arrays([pa.array(x) for x in (document[first], token[first], np.diff(np.append(first, len(order))), *np.ascontiguousarray(total))],
                                           names=["document", "token", "n_occ", *(f"sum_p{k}" for k in range(n))])
        for at in range(0, words.num_rows, SUM_ROWS):
            yield words.slice(at, SUM_ROWS)

    def run(batches):
        import numpy as np

        held, last = [], None  # the rows of the document that the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            document, token = (b.column(c).to_numpy(zero_copy_only=False) for c in ("document", "token"))
            probs = b.column("probs").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            if (np.diff(document) < 0).any() or (held and document[0] < last):
                raise ValueError("occurrences must come in the order of their documents")
            if held and document[-1] != last or document[0] != document[-1]:
                cut = int(np.searchsorted(document, document[-1]))
                done = [*held, *([(document[:cut], token[:cut], probs[:cut])] if cut else [])]
                yield from sums(done)
                held, document, token, probs = [], document[cut:], token[cut:], probs[cut:]
            held, last = [*held, (document, token, probs)], document[-1]
        if held:
            yield from sums(held)

    return run


SUM_ROWS = 1 << 14


def sum_occurrences(occurrences: DataFrame, n_classes: int, digits: int) -> DataFrame:
    """(document, token, probs) -> (document, token, n_occ, sum_p0..): count and element-wise sum per word, rounded.

    The occurrences of a document must lie in one partition, and those of a partition in the order of their documents (the
    documents dealt out by id and sorted there, before anything is exploded from them). Vectors that come out of the
    model hook have lost what Spark knew of that, and a ``groupBy`` would shuffle every one of them; here numpy sums
    them where they are, holding the rows of one document and one batch.
    """
    from ..session import ship_package
    from .metrics_extra import _half_away
    ship_package(occurrences.sparkSession)
    sums = ", ".join(f"sum_p{k} double" for k in range(n_classes))
    return occurrences.select("document", "token", "probs").mapInArrow(
        _word_sums(n_classes, lambda x: _half_away(x, digits)), f"document long, token int, n_occ long, {sums}")


def drop_confident_outside(df: DataFrame, cut: float = CUT_TOKEN_MODEL, probs: str = "probs",
                           n_classes: int | None = None) -> DataFrame:
    """P5: drop occurrences whose outside probability is >= cut (strict <, applied before the mean)."""
    return df.filter(outside_prob(F.col(probs), n_classes) < F.lit(float(cut)))


def mean_probs(df: DataFrame, n_classes: int, probs: str = "probs", digits: int | None = None,
               as_columns: bool = False) -> DataFrame:
    """A3 (X2): element-wise mean vector per (document, token) as n scalar sums plus one shared
    count in one hash aggregate (partial aggregation map-side; avg is sum / count); rounded only if
    ``digits`` is given (rounding can change labels at a threshold). ``as_columns`` returns the means as scalar columns _m0.._m{n-1}."""
    aggs = [F.sum(F.col(probs).getItem(i)).alias(f"_p{i}") for i in range(n_classes)]
    agg = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    vals = [F.col(f"_p{i}") / F.col("_n").cast("double") for i in range(n_classes)]
    if digits is not None:
        vals = [round_half_away(v, digits) for v in vals]
    if as_columns:
        return agg.select(*KEYS, *[v.alias(f"_m{i}") for i, v in enumerate(vals)])
    return agg.select(*KEYS, F.array(*vals).alias("probs"))


def prediction_table(occurrences: DataFrame, labels="bio13", cut: float = CUT_TOKEN_MODEL,
                     digits: int | None = None) -> DataFrame:
    """D8 pred_df: (document, token, probs, outside_prob, most_probable_label).

    P4 (special pieces) and P5 (confident outside) run before the mean. The means stay scalar
    columns, each read by several outputs, so the optimizer keeps them computed once instead of
    inlining the rounded vector into every consumer (which also keeps the generated code small). The
    outputs come from one struct per word (``inline``): a later filter on the label is not moved below the means, which
    would be computed again inside it, in a method that HotSpot does not compile.
    """
    tax = taxonomy(labels)
    n = len(tax)
    occ = occurrences.filter(F.col("token") != F.lit(-1))
    if cut is not None:
        occ = drop_confident_outside(occ, cut, n_classes=n)
    m = mean_probs(occ, n, digits=digits, as_columns=True)
    cols = [F.col(f"_m{i}") for i in range(n)]
    ent = cols[:-1]
    best = F.array_position(F.array(*ent), F.greatest(*ent)) - F.lit(1)
    word = F.struct(F.array(*cols).alias("probs"), cols[-1].alias("outside_prob"),
                    id_label(best, tax).alias("most_probable_label"))
    return m.select(*KEYS, F.inline(F.array(word)))


def apply_threshold(pred: DataFrame, threshold: float, out: str = "label") -> DataFrame:
    """The best entity label when outside_prob <= threshold (inclusive), else 'O'."""
    return pred.withColumn(out, F.when(F.col("outside_prob") <= F.lit(float(threshold)),
                                       F.col("most_probable_label")).otherwise(F.lit("O")))


def keep_entities(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label is not 'O'."""
    return df.filter(F.col(label) != F.lit("O"))


# ----------------------------------------------------------------------------- gold
def gold_table(essays: DataFrame) -> DataFrame:
    """Gold words (document, token, label) without 'O'; an essay with no words yields nothing (T4)."""
    return (essays.select("document", posexplode_rows(F.col("labels"), "token", "label"))
                  .filter(F.col("token").isNotNull() & (F.col("label") != F.lit("O"))))


def reference_table(essays: DataFrame, order_col: str = "document", num_partitions: int | None = None) -> DataFrame:
    """Gold rows keyed by the global exploded row number (``row_id``, with gaps for 'O' words).

    row_id = (words of all essays before this one in ``order_col`` order) + position. The
    per-essay offsets are a weighted prefix sum over a narrow essay-level frame; only the sparse
    gold rows are joined to them. A repeated document id raises (T5): its words could not be told apart.
    """
    # words per essay: tokens and labels explode together, so count tokens when present (labels
    # may be a derived column that need not be computed just to be counted)
    n_words = F.size("tokens") if "tokens" in essays.columns else F.size("labels")
    sizes = require_unique(essays.select("document", F.col(order_col).alias("_ord"), n_words.alias("_n")), "document")
    offsets = with_row_index(sizes, ["_ord", "document"], "_off", weight_col="_n",
                             num_partitions=num_partitions).select("document", "_off")
    gold = gold_table(essays)
    return (gold.join(offsets, "document")
                .select((F.col("_off") + F.col("token")).alias("row_id"), "document", "token", "label"))


# ----------------------------------------------------------------------------- scoring
def compare(pred: DataFrame, gold: DataFrame, pred_label: str = "label", gold_label: str = "label",
            extra: tuple[str, ...] = ()) -> DataFrame:
    """M11 as one full outer join on (document, token): each side holds one row per word, so
    matching on (document, token, label) is matching the keys and then the labels."""
    p = pred.select(*KEYS, F.col(pred_label).alias("p_label"), *extra)
    # one gold row per word: repeated rows count once (sets), contradicting ones raise. The aggregate
    # needs the exchange that the join needs anyway, and the gold words are sparse.
    low, high = F.min(gold_label), F.max(gold_label)
    g = gold.groupBy(*KEYS).agg(low.alias("_low"), high.alias("_high")).select(*KEYS, F.when(
        F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(F.concat(
            F.lit("repeated document id: two gold labels for document "), F.col("document").cast("string")))).alias("g_label"))
    # hash join built on the (sparse) gold words: the large prediction side keeps the
    # aggregate's partitioning and is neither re-shuffled nor sorted
    return p.join(g.hint("shuffle_hash"), KEYS, "full_outer")


def score_sets(pred: DataFrame, gold: DataFrame, pred_label: str = "label") -> DataFrame:
    """Label every (document, token, label) triple as tp, fp (prediction only) or fn (gold only)."""
    c = compare(pred, gold, pred_label)
    rows = F.array(
        F.when(F.col("p_label").isNotNull(), F.struct(
            F.col("p_label").alias("label"),
            F.when(F.col("p_label") == F.col("g_label"), F.lit("tp")).otherwise(F.lit("fp")).alias("status"))),
        F.when(F.col("g_label").isNotNull() & (F.col("p_label").isNull() | (F.col("p_label") != F.col("g_label"))),
               F.struct(F.col("g_label").alias("label"), F.lit("fn").alias("status"))),
    )
    return c.select(*KEYS, F.inline(F.filter(rows, lambda x: x.isNotNull())))


def _type_events(c: DataFrame) -> DataFrame:
    p, g = F.col("p_label"), F.col("g_label")
    hit = p.isNotNull() & g.isNotNull() & (p == g)
    ev = F.array(
        F.when(p.isNotNull(), F.struct(entity_type(p).alias("type"),
                                       F.when(hit, 1).otherwise(0).alias("tp"),
                                       F.when(hit, 0).otherwise(1).alias("fp"),
                                       F.lit(0).alias("fn"))),
        F.when(g.isNotNull() & ~F.coalesce(hit, F.lit(False)),
               F.struct(entity_type(g).alias("type"), F.lit(0).alias("tp"), F.lit(0).alias("fp"),
                        F.lit(1).alias("fn"))),
    )
    return c.select(F.inline(F.filter(ev, lambda x: x.isNotNull())))


def type_counts(pred: DataFrame, gold: DataFrame, pred_label: str = "label") -> DataFrame:
    """A8 + A14: tp/fp/fn per entity type (prefix stripped after exact matching).

    With no prediction at all there are no type rows (the reference returns an empty dict).
    """
    ev = _type_events(compare(pred, gold, pred_label))
    counts = ev.groupBy("type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    n_pred = F.sum(F.col("tp") + F.col("fp")).over(Window.partitionBy())  # over <= #types rows
    return counts.withColumn("_np", n_pred).filter(F.col("_np") > 0).drop("_np")


def per_type_scores(counts: DataFrame, beta: float = 5.0, digits: int | None = None) -> DataFrame:
    """A9-A11 per type, excluding type 'O'."""
    return counts.filter(F.col("type") != F.lit("O")).select(
        "type", "tp", "fp", "fn", *prf_columns(beta=beta, digits=digits))


def overall_scores(counts: DataFrame, beta: float = 5.0) -> DataFrame:
    """A12 (+A13 merge): micro totals over all types, type 'O' included; zeros when empty."""
    tot = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    cols = prf_columns(beta=beta)
    fname = f"f{beta:g}"
    return tot.select("tp", "fp", "fn",
                      cols[0].alias("ents_p"), cols[1].alias("ents_r"), cols[3].alias(f"ents_{fname}"),
                      cols[3].alias("lb"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Score records add by summing their counters (a mergeable aggregate)."""
    u = counts[0]
    for c in counts[1:]:
        u = u.unionByName(c)
    return u.groupBy("type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def type_report(counts: DataFrame, beta: float = 5.0, digits: int = 3) -> DataFrame:
    """Per-type precision / recall / F-beta, sorted by type, rounded."""
    return per_type_scores(counts, beta, digits).orderBy("type")


def submission(pred: DataFrame, threshold: float, num_partitions: int | None = None, store: str | None = None) -> DataFrame:
    """Thresholded entity rows with a dense row_id in (document, token) order (``store``: see ``with_row_index``)."""
    rows = keep_entities(apply_threshold(pred, threshold)).select(*KEYS, "label")
    return with_row_index(rows, KEYS, "row_id", num_partitions=num_partitions, store=store).select(
        "row_id", "document", "token", "label")
