"""Pieces, windows, alignment, spans, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..operators import batches as B
from ..operators import windows as W
from ..functions.labels import TAXONOMIES
from ..operators.tokenise import leading_space_tokens
from ..operators.tokenizers import split_with_tokenizer, subwords
from ..session import scratch_path
from ..settings import BATCH_SIZE, RANDOM_SEED, STRIDE_SPAN_MODELS
from . import sql as S
from .catalog_core import essays
from .registry import register

MAX_LEN, STRIDE = 512, STRIDE_SPAN_MODELS          # span-model settings: 510 content pieces, step 382
CAP, STEP = MAX_LEN - 2, MAX_LEN - 2 - STRIDE
BATCH = BATCH_SIZE
SEED = RANDOM_SEED
MASK_P = 0.15

WIN_SQL = [S.WORDS, S.LWORDS, S.PIECES, S.windows(CAP, STEP)]


def pieces(spark, d, mode="leading", taxonomy=None):
    return W.split_pieces(leading_space_tokens(essays(spark, d), mode), taxonomy=taxonomy)


def windows(spark, d):
    p = pieces(spark, d, taxonomy="bio13")
    return W.window(p, MAX_LEN, STRIDE, 2, keep=("document",), sliced={"label_ids": -100})


def spans(spark, d, reference_rule=False):
    w = W.word_spans(windows(spark, d), reference_rule)
    return w.join(essays(spark, d).select("document", "labels"), "document")


@register("split_pieces", S.chain(S.WORDS, S.LWORDS, S.PIECES) + """
SELECT document, ppos AS piece_pos, token, piece FROM pieces""")
def q_split_pieces(spark, d):
    """W1 (+P2): pieces of every word with the index of the word they came from."""
    p = pieces(spark, d)
    return p.select("document", F.posexplode(F.arrays_zip("pieces", "word_ids")).alias("piece_pos", "z")).select(
        "document", "piece_pos", F.col("z.word_ids").alias("token"), F.col("z.pieces").alias("piece"))


PIECE_LETTERS = 4
CUT_SQL = [f"""cut AS (SELECT document, token, label, i, CASE WHEN i = 0 THEN '' ELSE '##' END || substr(w, i * {PIECE_LETTERS} + 1, {PIECE_LETTERS}) AS piece
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(w) / {PIECE_LETTERS}.0) AS BIGINT))) AS i
        FROM (SELECT document, token, label, word AS w FROM lwords)))""",
           """pieces AS (SELECT document, token, label, piece,
  CAST(row_number() OVER (PARTITION BY document ORDER BY token, i) - 1 AS BIGINT) AS ppos FROM cut)""",
           """npieces AS (SELECT d.doc_id AS document, count(p.ppos) AS n FROM documents d LEFT JOIN pieces p ON p.document = d.doc_id GROUP BY 1)"""]


@register("split_with_tokenizer", S.chain(S.WORDS, S.LWORDS, *CUT_SQL, S.windows(CAP, STEP)) + f"""
SELECT p.document, wp."window", wp.pos, p.token, p.piece, CAST({S.label_id_case('p.label', TAXONOMIES['bio13'])} AS BIGINT) AS label_id
FROM wp JOIN pieces p ON p.document = wp.document AND p.ppos = wp.ppos WHERE wp.ppos IS NOT NULL""")
def q_split_with_tokenizer(spark, d):
    """W1 by a user tokenizer (a fixed sub-word cutter loaded once per worker) into windows and labels."""
    p = split_with_tokenizer(essays(spark, d), subwords(PIECE_LETTERS), tokens="tokens", taxonomy="bio13")
    w = W.window(p, MAX_LEN, STRIDE, 2, keep=("document",), sliced={"label_ids": -100})
    z = w.select("document", "window", F.posexplode(F.arrays_zip("word_ids", "pieces", "label_ids")).alias("pos", "z"))
    return z.select("document", "window", "pos", F.col("z.word_ids").alias("token"), F.col("z.pieces").alias("piece"),
                    F.col("z.label_ids").alias("label_id")).filter("token <> -1")


@register("with_leading_space", S.chain(S.WORDS, S.LWORDS) + """
SELECT document, token, CASE WHEN token > 0 THEN ' ' || word ELSE word END AS input_token FROM lwords""")
def q_with_leading_space(spark, d):
    """P2: ' ' prefixed when the previous word had trailing whitespace."""
    e = leading_space_tokens(essays(spark, d), "leading")
    return e.select("document", F.posexplode("input_tokens").alias("token", "input_token"))


@register("no_leading_space", S.chain(S.WORDS, S.LWORDS) + """
SELECT document, token, CAST(len(regexp_extract_all(word, '""" + S.PIECE_RE + """', 0)) AS BIGINT) AS n_pieces FROM lwords""")
def q_no_leading_space(spark, d):
    """The variant that never prefixes (pieces per word without a leading space)."""
    e = leading_space_tokens(essays(spark, d), "none")
    n_pieces = F.transform("input_tokens", lambda w: F.size(F.regexp_extract_all(w, F.lit(W.PIECE_PATTERN), 0)))
    return e.select("document", F.posexplode(n_pieces).alias("token", "n_pieces"))


@register("window", S.chain(*WIN_SQL) + f"""
SELECT document, "window", "window" * {STEP} AS start, count(ppos) + 2 AS input_length,
       min(token) AS first_word, max(token) AS last_word
FROM wp GROUP BY document, "window"
""")
def q_window(spark, d):
    """Overlapping windows (512 pieces incl. 2 specials, stride 128) and their lengths."""
    w = windows(spark, d)
    n = F.col("input_length")
    return w.select("document", "window", "start", "input_length",
                    F.when(n > 2, F.element_at("word_ids", 2)).alias("first_word"),
                    F.when(n > 2, F.element_at("word_ids", n - 1)).alias("last_word"))


@register("word_ids", S.chain(*WIN_SQL) + """
SELECT document, "window", pos, token AS word_id FROM wp WHERE ppos IS NOT NULL
UNION ALL SELECT document, "window", 0, -1 FROM wins
UNION ALL SELECT w.document, w."window", count(wp.ppos) + 1, -1 FROM wins w LEFT JOIN wp USING (document, "window")
  GROUP BY w.document, w.window""")
def q_word_ids(spark, d):
    """Word id per window piece, -1 for the two specials."""
    w = windows(spark, d)
    return w.select("document", "window", F.posexplode("word_ids").alias("pos", "word_id"))


@register("align_labels", S.chain(*WIN_SQL) + f"""
SELECT document, "window", label_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT document, "window", {S.label_id_case('label')} AS label_id FROM wp WHERE ppos IS NOT NULL
  UNION ALL SELECT document, "window", -100 FROM wins
  UNION ALL SELECT document, "window", -100 FROM wins)
GROUP BY document, "window", label_id""")
def q_align_labels(spark, d):
    """Label id per piece (-100 for specials / unknown labels), counted per window."""
    w = windows(spark, d)
    return (w.select("document", "window", F.explode("label_ids").alias("label_id"))
             .groupBy("document", "window", "label_id").agg(F.count(F.lit(1)).alias("n")))


SPANS_SQL = WIN_SQL + ["""wspans AS (
  SELECT document, "window", token AS word, min(pos) AS head, max(pos) + 1 AS tail, any_value(label) AS label
  FROM wp WHERE ppos IS NOT NULL GROUP BY document, "window", token)"""]


@register("word_spans", S.chain(*SPANS_SQL) + """
SELECT w.document, w."window", CAST(count(s.word) AS BIGINT) AS n_spans, CAST(sum(s.tail - s.head) AS BIGINT) AS span_pieces,
       max(s.tail - s.head) AS longest, min(s.head) AS first_head, max(s.tail) AS last_tail
FROM wins w LEFT JOIN wspans s USING (document, "window") GROUP BY w.document, w.window""")
def q_word_spans(spark, d):
    """Runs of equal word id -> [head, tail) spans, summarised per window."""
    s = W.word_spans(windows(spark, d)).select("document", "window", F.explode_outer("spans").alias("s"))
    return s.groupBy("document", "window").agg(
        F.count("s.word").alias("n_spans"), F.sum(F.col("s.tail") - F.col("s.head")).alias("span_pieces"),
        F.max(F.col("s.tail") - F.col("s.head")).alias("longest"), F.min("s.head").alias("first_head"),
        F.max("s.tail").alias("last_tail"))


NOSPEC_SQL = [S.WORDS, S.LWORDS, S.PIECES, S.windows(MAX_LEN, MAX_LEN - STRIDE)]


@register("word_spans_reference_rule", S.chain(*NOSPEC_SQL) + """
SELECT w.document, w."window",
  CAST(greatest(count(DISTINCT CASE WHEN wp.pos - 1 >= 1 THEN wp.token END) - 1, 0) AS BIGINT) AS n_spans
FROM wins w LEFT JOIN wp USING (document, "window") GROUP BY w.document, w."window"
""")
def q_word_spans_reference_rule(spark, d):
    """The old rule (runs from position 1, last run never emitted) on windows without
    specials: the first piece and the last word of every window are lost."""
    p = pieces(spark, d)
    w = W.window(p, MAX_LEN, STRIDE, 0, keep=("document",))
    s = W.word_spans(w, reference_rule=True)
    return s.select("document", "window", F.size("spans").alias("n_spans"))


@register("span_labels", S.chain(*SPANS_SQL) + f"""
SELECT document, "window", {S.label_id_case('label')} AS label_id, CAST(count(*) AS BIGINT) AS n
FROM wspans GROUP BY document, "window", label_id""")
def q_span_labels(spark, d):
    """One label id per span, counted per window."""
    s = W.span_labels(spans(spark, d))
    return (s.select("document", "window", F.explode("span_label_ids").alias("label_id"))
             .groupBy("document", "window", "label_id").agg(F.count(F.lit(1)).alias("n")))


@register("filter_min_spans", S.chain(*SPANS_SQL) + """
SELECT document, "window", CAST(count(*) AS BIGINT) AS n_spans FROM wspans GROUP BY document, "window" HAVING count(*) > 4""")
def q_filter_min_spans(spark, d):
    """Windows with more than 4 spans (the training rule)."""
    s = W.filter_min_spans(W.word_spans(windows(spark, d)), 4)
    return s.select("document", "window", F.size("spans").alias("n_spans"))


MASK_SQL = "CASE WHEN label <> 'O' OR (('0x' || substr(md5(CAST(document AS VARCHAR) || '|' || CAST(word AS VARCHAR) || '|mask'), 1, 8))::BIGINT / 4294967296.0) < 0.8 THEN 1 ELSE 0 END"


@register("keep_masked_words", S.chain(*SPANS_SQL) + f"""
SELECT w.document, w."window", CAST(count(s.word) AS BIGINT) AS n_kept FROM wins w
LEFT JOIN (SELECT * FROM wspans WHERE {MASK_SQL} = 1) s USING (document, "window")
GROUP BY w.document, w.window""")
def q_keep_masked_words(spark, d):
    """Spans whose word is masked in; masks = entity words plus a keyed 80% of the rest."""
    e = essays(spark, d).select("document", "labels")
    m = e.withColumn("masks", F.transform("labels", lambda lab, i: F.when(
        (lab != F.lit("O")) | (unit_hash(F.col("document"), i, F.lit("mask")) < F.lit(0.8)), 1).otherwise(0)))
    s = W.keep_masked_words(W.word_spans(windows(spark, d)).join(m.select("document", "masks"), "document"))
    return s.select("document", "window", F.size("spans").alias("n_kept"))


@register("select_model_columns", S.chain(*WIN_SQL) + """
SELECT document, "window", count(ppos) + 2 AS input_length FROM wp GROUP BY document, "window"
""")
def q_select_model_columns(spark, d):
    """Only model columns survive; Catalyst prunes the rest (ReadSchema: doc_id, text)."""
    return W.select_model_columns(windows(spark, d)).select("document", "window", "input_length")


# Places of pieces in windows from the number of pieces of each word alone.
PLACES_SQL = f"""wk AS (SELECT document, token, len(regexp_extract_all(CASE WHEN token > 0 THEN ' ' || word ELSE word END, '{S.PIECE_RE}', 0)) AS k FROM words),
wc AS (SELECT document, token, k, CAST(sum(k) OVER (PARTITION BY document ORDER BY token) - k AS BIGINT) AS s, sum(k) OVER (PARTITION BY document) AS n FROM wk),
wpos AS (SELECT document, token, n, unnest(generate_series(s, s + k - 1)) AS ppos FROM wc),
places AS (SELECT document, "window", ppos - "window" * {STEP} + 1 AS pos, token FROM (SELECT *, unnest(generate_series(
  greatest(0, CAST(floor((ppos - {CAP}) / {float(STEP)}) AS BIGINT) + 1),
  least(CAST(greatest(0, ceil((n - {CAP}) / {float(STEP)})) AS BIGINT), CAST(floor(ppos / {float(STEP)}) AS BIGINT)))) AS "window" FROM wpos))"""


@register("drop_special", S.chain(S.WORDS, PLACES_SQL) + """
SELECT document, "window", pos, token AS word_id FROM places""")
def q_drop_special(spark, d):
    """Piece rows without the special / padding pieces (word id -1)."""
    w = windows(spark, d).select("document", "window", F.posexplode("word_ids").alias("pos", "token"))
    return W.drop_special(w).withColumnRenamed("token", "word_id")


ORDER_SQL = S.chain(*WIN_SQL, """wl AS (SELECT document, "window", count(ppos) + 2 AS input_length FROM wp GROUP BY document, "window"),
ordered AS (SELECT document, "window", input_length,
  CAST(row_number() OVER (ORDER BY input_length, document, "window") - 1 AS BIGINT) AS order_idx FROM wl)""")


@register("order_by_length", ORDER_SQL + 'SELECT document, "window", input_length, order_idx FROM ordered')
def q_order_by_length(spark, d):
    """Dense position in length order (range partitions + offsets, no single-partition window)."""
    return B.order_by_length(windows(spark, d).select("document", "window", "input_length"))


@register("length_buckets", ORDER_SQL + f"""
SELECT document, "window", CAST(floor(order_idx / {BATCH}) AS BIGINT) AS batch_id,
  CAST(ceil(max(input_length) OVER (PARTITION BY floor(order_idx / {BATCH})) / 16.0) * 16 AS BIGINT) AS padded_len
FROM ordered""")
def q_length_buckets(spark, d):
    """Batches of 4 in length order, padded to the batch maximum rounded up to 16."""
    o = B.order_by_length(windows(spark, d).select("document", "window", "input_length"))
    return B.length_buckets(o, BATCH, 16).select("document", "window", "batch_id", "padded_len")


@register("pad_arrays", ORDER_SQL + f"""
SELECT document, "window", padded_len, padded_len - input_length + 2 AS n_minus1,
       padded_len - input_length + 2 AS n_ignore, padded_len - input_length AS n_pad FROM (
  SELECT document, "window", input_length,
    CAST(ceil(max(input_length) OVER (PARTITION BY floor(order_idx / {BATCH})) / 16.0) * 16 AS BIGINT) AS padded_len
  FROM ordered)""")
def q_pad_arrays(spark, d):
    """Padded word ids (-1), labels (-100) and pieces ([PAD]) counted per window."""
    p = B.pad_arrays(_batched(spark, windows(spark, d)))
    return p.select("document", "window", "padded_len",
                    F.size(F.filter("word_ids", lambda x: x == -1)).alias("n_minus1"),
                    F.size(F.filter("label_ids", lambda x: x == -100)).alias("n_ignore"),
                    F.size(F.filter("pieces", lambda x: x == W.PAD)).alias("n_pad"))


def _batched(spark, w):
    """Windows with their batch's lengths: the windows are made once and written, their narrow keys ordered."""
    path = scratch_path(spark, "windows")
    w.write.parquet(path)
    w = spark.read.schema(w.schema).parquet(path)
    narrow = ["document", "window", "input_length"]
    keys = w.select(*narrow, F.size("spans").alias("n_spans")) if "spans" in w.columns else w.select(*narrow)
    b = B.length_buckets(B.order_by_length(keys), BATCH, 16).drop("input_length", "order_idx", "n_spans")
    return w.join(b, ["document", "window"])


@register("pad_spans", ORDER_SQL + f""",
sp AS (SELECT document, "window", token, any_value(label) AS label FROM wp WHERE ppos IS NOT NULL GROUP BY document, "window", token),
ns AS (SELECT document, "window", count(*) AS n, count(*) FILTER (WHERE label <> 'O') AS n_entity FROM sp GROUP BY document, "window"),
o AS (SELECT document, "window", input_length, order_idx, coalesce(n, 0) AS n, coalesce(n_entity, 0) AS n_entity
  FROM ordered LEFT JOIN ns USING (document, "window")),
p AS (SELECT *, CAST(ceil(max(input_length) OVER (PARTITION BY floor(order_idx / {BATCH})) / 16.0) * 16 AS BIGINT) AS padded_len,
        max(n) OVER (PARTITION BY floor(order_idx / {BATCH})) AS span_len FROM o)
SELECT document, "window", padded_len, span_len, span_len - n AS n_filler_spans, span_len - n AS n_filler_labels,
       n_entity AS n_entity_labels, (span_len - n) * (padded_len - 2) AS sum_filler_heads FROM p""")
def q_pad_spans(spark, d):
    """W11 on span level: spans, heads, tails and span labels padded to the batch's longest span list."""
    w = W.word_spans(windows(spark, d)).withColumn("first_piece", F.transform("spans", lambda s: s["head"]))
    # a span's label is the label of its first piece: looked up in the row, by zipping positions
    by_piece = F.filter(F.arrays_zip(F.col("label_ids").alias("l"), F.col("word_ids").alias("w"), F.concat(
        F.array(F.lit(-2)), F.slice("word_ids", F.lit(1), F.size("word_ids") - 1)).alias("before")),
        lambda z: (z["w"] != -1) & (z["w"] != z["before"]))
    w = w.withColumn("span_label_ids", F.transform(by_piece, lambda z: z["l"])).drop("first_piece")
    p = B.pad_arrays(_batched(spark, w))
    filler = F.filter("spans", lambda s: s["word"] == -1)
    return p.select("document", "window", "padded_len", F.size("spans").alias("span_len"),
                    F.size(filler).alias("n_filler_spans"),
                    F.size(F.filter("span_label_ids", lambda x: x == -100)).alias("n_filler_labels"),
                    F.size(F.filter("span_label_ids", lambda x: (x != -100) & (x != 12))).alias("n_entity_labels"),
                    F.aggregate(filler, F.lit(0).cast("long"), lambda a, s: a + s["head"]).alias("sum_filler_heads"))


@register("mask_augment", S.chain(S.WORDS, PLACES_SQL) + f"""
SELECT document, "window", pos FROM places WHERE
  (('0x' || substr(md5(CAST(document AS VARCHAR) || '|' || CAST("window" AS VARCHAR) || '|' || CAST(pos AS VARCHAR) || '|{SEED}'), 1, 8))::BIGINT / 4294967296.0) < {MASK_P}""")
def q_mask_augment(spark, d):
    """Keyed Bernoulli(0.15) masking of non-special pieces -> masked positions."""
    m = B.mask_augment(windows(spark, d), MASK_P, SEED)
    return (m.select("document", "window", F.posexplode("pieces").alias("pos", "piece"))
             .filter(F.col("piece") == W.MASK).select("document", "window", "pos"))
