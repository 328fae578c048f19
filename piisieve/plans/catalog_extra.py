"""Softmax, AUC, log-loss, span pooling (A1, A18-A20), run logs (L1-L4), detection and removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import round_half_away

from ..functions.labels import TAXONOMIES, convert_labels, id_label
from ..operators import metrics_extra as X
from ..operators import runlog as L
from ..operators import windows as W
from ..operators.detect import (PATTERN_RULES, all_match_offsets, detect_entries, detect_gazetteer, detect_patterns,
                                email_domain_in_pool, normalise)
from ..operators.profile import pii_profile, read_profile, standard_error, write_profile
from ..operators.redact import pseudonymise, pseudonymise_text, redact, redact_spans
from ..operators.spans import bio_spans_in_row, bio_to_spans, label_matches, spans_to_bio, spans_to_bio_sweep
from ..operators.tokenise import explode_words, rebuild_text, word_offsets
from ..sources.pools import pool_from_table
from ..settings import PATIENCE as PATIENCE_SETTING
from . import sql as S
from .catalog_core import OCC, essays
from .catalog_windows import WIN_SQL, windows
from .registry import read, register

PATIENCE = PATIENCE_SETTING
EVAL_EVERY = 10
SALT = "s1"


# ----------------------------------------------------------------------------- A1, A18-A20
@register("softmax", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS mx FROM x),
e AS (SELECT vec_id, k, exp(x - mx) AS ex FROM m)
SELECT vec_id, CAST(k - 1 AS BIGINT) AS k, round(ex / sum(ex) OVER (PARTITION BY vec_id), 9) AS p FROM e""")
def q_softmax(spark, d):
    """A1: softmax over the whole embedding vector of each row."""
    e = read(spark, d, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    p = X.softmax_probs(e)
    return p.select("vec_id", F.posexplode("probs").alias("k", "p")).withColumn("p", round_half_away("p", 9))


@register("roc_auc", """
WITH j AS (SELECT d.n_chars AS s, l.toxic AS y FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
r AS (SELECT s, y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM j),
t AS (SELECT sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs, sum(y) AS p, count(*) - sum(y) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 4) AS roc_auc, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM t""")
def q_roc_auc(spark, d):
    """Document ROC AUC of n_chars against the toxic flag (tie-averaged ranks)."""
    j = read(spark, d, "labels", "doc_id", "toxic").join(read(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    return X.roc_auc(j, "n_chars", "toxic")


@register("token_log_loss", S.chain(*OCC) + f"""
SELECT round(avg(-ln(CASE g {' '.join(f'WHEN {k} THEN p{k}' for k in range(12))} ELSE p12 END)), 6) AS log_loss,
       CAST(count(*) AS BIGINT) AS n_pieces
FROM (SELECT o.*, x.g FROM occ o JOIN (SELECT document, token, {S.label_id_case('label')} AS g FROM lwords) x
      USING (document, token))""")
def q_token_log_loss(spark, d):
    """Mean -log p(gold label) over scored window pieces (ignore id -100 skipped)."""
    from .synthetic import scored_windows
    out = X.token_log_loss(scored_windows(essays(spark, d), keep_labels=True))
    return out.select(round_half_away("log_loss", 6).alias("log_loss"), "n_pieces")


VECTOR_DIMS = 64


@register("span_mean", S.chain(*WIN_SQL) + f"""
SELECT wp.document, wp."window", wp.token AS word, CAST(count(*) AS BIGINT) AS n_pieces,
       {', '.join(f'round(sum(coalesce(e.embedding[{i + 1}]::DOUBLE, 0)) / count(*), 6) AS m{i}' for i in range(VECTOR_DIMS))}
FROM wp JOIN pieces p ON p.document = wp.document AND p.ppos = wp.ppos
LEFT JOIN embeddings e ON e.vec_id = length(p.piece)
WHERE wp.ppos IS NOT NULL GROUP BY wp.document, wp."window", wp.token""")
def q_span_mean(spark, d):
    """Mean-pool the whole piece vectors over each word span [head, tail) of every window."""
    w = windows(spark, d).select(
        "document", "window", "word_ids", F.transform("pieces", lambda p: F.length(p).cast("long")).alias("piece_keys"))
    w = W.word_spans(w, vectorised=True).select("document", "window", "spans", "piece_keys")
    vecs = read(spark, d, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("vec_key"), F.col("embedding").alias("vector"))
    means = [f"m{i}" for i in range(VECTOR_DIMS)]
    return X.span_mean(w, vecs, digits=6, columns=means).select("document", "window", "word", "n_pieces", *means)


# ----------------------------------------------------------------------------- L1-L4
def run_log(spark, d):
    ev = read(spark, d, "events", "event_id", "ts", "user_id", "value")
    return ev.select(F.col("user_id").alias("run_id"), F.to_date("ts").alias("epoch"), "ts", "event_id",
                     F.col("value").alias("loss"), F.col("value").alias("lb"))


def minute_block():
    return (F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long") * 1440
            + F.hour("ts") * 60 + F.minute("ts"))


ORDER = ("ts", "event_id")
LOG_SQL = "SELECT user_id AS run_id, CAST(ts AS DATE) AS epoch, ts, event_id, value AS loss, value AS lb FROM events"
BEST_SQL = f"""WITH log AS ({LOG_SQL}),
b AS (SELECT *, count(*) OVER w AS eval_no, greatest(max(lb) OVER w, -1.0) AS best_lb,
        lb >= coalesce(max(lb) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS is_best
      FROM log WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, eval_no - max(CASE WHEN is_best THEN eval_no ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS patience_counter FROM b)
"""


@register("running_loss", f"""WITH log AS ({LOG_SQL})
SELECT event_id, round(avg(loss) OVER (PARTITION BY run_id, epoch ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss FROM log""")
def q_running_loss(spark, d):
    """L1: running mean loss per run, reset each epoch (two-level, per-minute cells)."""
    r = L.running_loss(run_log(spark, d), "run_id", "epoch", ORDER, "loss", minute_block())
    return r.select("event_id", round_half_away("running_loss", 6).alias("running_loss"))


@register("running_best", BEST_SQL + "SELECT event_id, eval_no, best_lb, is_best FROM b")
def q_running_best(spark, d):
    """L2: running best score; ties count as a new best."""
    r = L.running_best(run_log(spark, d), "run_id", ORDER, "lb", minute_block())
    return r.select("event_id", "eval_no", "best_lb", "is_best")


@register("early_stop_counter", BEST_SQL + "SELECT event_id, CAST(patience_counter AS BIGINT) AS patience_counter FROM c")
def q_early_stop_counter(spark, d):
    """L3: evaluations since the last best, per row."""
    rows, _ = L.early_stop(run_log(spark, d), "run_id", ORDER, "lb", PATIENCE, minute_block(), step="event_id")
    return rows.select("event_id", "patience_counter")


@register("early_stop", BEST_SQL + f"""
SELECT run_id, arg_min(event_id, eval_no) AS stop_step, min(eval_no) AS stop_eval_no FROM c
WHERE patience_counter >= {PATIENCE} GROUP BY run_id""")
def q_early_stop(spark, d):
    """L3: first evaluation per run where the patience counter reaches 10."""
    _, stops = L.early_stop(run_log(spark, d), "run_id", ORDER, "lb", PATIENCE, minute_block(), step="event_id")
    return stops


@register("eval_points", BEST_SQL + f"SELECT event_id, eval_no FROM b WHERE eval_no % {EVAL_EVERY} = 0")
def q_eval_points(spark, d):
    """L4: every 10th evaluation of each run."""
    r = L.running_best(run_log(spark, d), "run_id", ORDER, "lb", minute_block())
    return L.eval_points(r, EVAL_EVERY).select("event_id", "eval_no")


@register("stream_run_log", BEST_SQL + """, m AS (SELECT event_id, round(avg(loss) OVER (PARTITION BY run_id, epoch ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss FROM log)
SELECT event_id, running_loss, eval_no, best_lb, is_best, CAST(patience_counter AS BIGINT) AS patience_counter FROM c JOIN m USING (event_id)""")
def q_stream_run_log(spark, d):
    """L1-L3 on an arriving log: three pieces in the order of time, the stream stopped and started again between them."""
    from ..session import scratch_path
    from ..streaming.run_log_stream import read_run_log, start_run_log
    src, out, ckpt = (scratch_path(spark, n) for n in ("run-log", "run-log-out", "run-log-ckpt"))
    log = run_log(spark, d)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = log.select(F.percentile_approx(at, [1 / 3, 2 / 3]).alias("c")).first()["c"] or [0, 0]
    for piece in (at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1]):
        log.filter(piece).write.mode("append").parquet(src)
        arriving = spark.readStream.schema(log.schema).parquet(src)
        start_run_log(arriving, out, ckpt, order=ORDER, block=minute_block()).awaitTermination()
    r = read_run_log(spark, out)
    return r.select("event_id", round_half_away("running_loss", 6).alias("running_loss"), "eval_no", "best_lb", "is_best", "patience_counter")


# ----------------------------------------------------------------------------- R1-R12
def _rule_union(body: str) -> str:
    return "\nUNION ALL ".join(body.format(t=t, p=p) for t, p in PATTERN_RULES.items())


MATCHES_SQL = "matches AS (" + _rule_union(
    "SELECT doc_id, '{t}' AS type, CAST(generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) - 1 AS BIGINT) AS occurrence, "
    "unnest(regexp_extract_all(text, '{p}', 0)) AS match FROM documents") + ")"

OFFSETS_SQL = MATCHES_SQL + """,
parts AS (SELECT doc_id, type, occurrence, match, regexp_split_to_array(d.text, r.p) AS sp, m.ms
  FROM (SELECT m.*, list(match) OVER (PARTITION BY m.doc_id, m.type ORDER BY m.occurrence
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ms FROM matches m) m
  JOIN documents d USING (doc_id)
  JOIN (VALUES """ + ", ".join(f"('{t}', '{p}')" for t, p in PATTERN_RULES.items()) + """) AS r(t, p) ON r.t = m.type),
offsets AS (SELECT doc_id, type, occurrence, match,
  CAST(list_sum(list_transform(sp[1:occurrence + 1], lambda x: length(x)))
     + coalesce(list_sum(list_transform(ms[1:occurrence], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM parts)"""


def docs_text(spark, d):
    return read(spark, d, "documents", "doc_id", "text")


@register("detect_patterns", S.chain(MATCHES_SQL) + "SELECT doc_id, type, occurrence, match FROM matches")
def q_detect_patterns(spark, d):
    """Rule detector (EMAIL, PHONE_NUM, ID_NUM, URL_PERSONAL) over whole texts."""
    return detect_patterns(docs_text(spark, d))


@register("match_offsets", S.chain(OFFSETS_SQL) + """
SELECT doc_id, type, occurrence, start, start + length(match) AS "end" FROM offsets""")
def q_match_offsets(spark, d):
    """R2: character offsets of every match without a UDF (split parts + match lengths)."""
    return all_match_offsets(docs_text(spark, d)).select("doc_id", "type", "occurrence", "start", "end")


PAGE_EMAILS = f"""pool AS (SELECT DISTINCT lower(unnest(regexp_extract_all(html, '{PATTERN_RULES["EMAIL"]}', 0))) AS v FROM pages)"""


@register("detect_gazetteer", S.chain(S.WORDS, PAGE_EMAILS) + """
SELECT document, token, 'EMAIL' AS entity_type FROM words
WHERE lower(regexp_replace(word, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) IN (SELECT v FROM pool)""")
def q_detect_gazetteer(spark, d):
    """Normalised words joined with a pool of known values (addresses seen in pages)."""
    pages = read(spark, d, "pages", "page_id", "html")
    pool = (detect_patterns(pages, {"EMAIL": PATTERN_RULES["EMAIL"]}, "html", ("page_id",))
            .select(F.lit("EMAIL").alias("entity_type"), F.lower("match").alias("value")).distinct())
    w = explode_words(essays(spark, d))
    return detect_gazetteer(w, pool).select("document", "token", "entity_type")


ENTRY_WORDS = 3
ENTRY_NORM = "lower(regexp_replace({0}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))"


@register("detect_entries", S.chain(S.WORDS) + f"""
, nw AS (SELECT document, token, w, row_number() OVER (PARTITION BY document ORDER BY token) AS p
  FROM (SELECT document, token, {ENTRY_NORM.format('word')} AS w FROM words) WHERE w <> ''),
tri AS (SELECT document, token, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM nw
  WINDOW o AS (PARTITION BY document ORDER BY p)),
own AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[ \n]+'), lambda x: {ENTRY_NORM.format('x')}), lambda x: x <> '') AS a FROM benchmark),
pool AS (SELECT DISTINCT 'PASSAGE' AS entity_type, n, array_to_string(a[1:n], ' ') AS k FROM own, (VALUES (1), (2), (3)) t(n) WHERE len(a) >= n)
SELECT document, token, n AS n_words, entity_type FROM tri JOIN pool ON k = CASE n WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 ELSE w1 || ' ' || w2 || ' ' || w3 END""")
def q_detect_entries(spark, d):
    """Dictionary entries of one to three words (the openings of the benchmark passages)."""
    words = F.filter(F.transform(F.split("text", "[ \n]+", -1), normalise), lambda w: w != "")
    own = read(spark, d, "benchmark", "text").select(words.alias("a"))
    pool = own.select(F.lit("PASSAGE").alias("entity_type"), F.explode(F.array(
        *[F.when(F.size("a") >= n, F.array_join(F.slice("a", 1, n), " ")) for n in range(1, ENTRY_WORDS + 1)])).alias("value")).filter("value IS NOT NULL")
    return detect_entries(essays(spark, d), pool, ENTRY_WORDS)


@register("detect_whole_entries", S.chain(S.WORDS) + f"""
, nw AS (SELECT document, token, w, row_number() OVER (PARTITION BY document ORDER BY token) AS p
  FROM (SELECT document, token, {ENTRY_NORM.format('word')} AS w FROM words) WHERE w <> ''),
own AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[ \n]+'), lambda x: {ENTRY_NORM.format('x')}), lambda x: x <> '') AS a FROM benchmark),
pool AS (SELECT row_number() OVER () AS id, a FROM (SELECT DISTINCT a FROM own WHERE len(a) >= 1)),
pairs AS (SELECT id, n, i, a[i] || ' ' || a[i + 1] AS k FROM (SELECT id, a, len(a) AS n, unnest(range(1, len(a))) AS i FROM pool)),
nk AS (SELECT document, token, p, w, w || ' ' || lead(w) OVER (PARTITION BY document ORDER BY p) AS k FROM nw),
starts AS (SELECT document, p - i AS at, id, n FROM nk JOIN pairs USING (k) GROUP BY ALL HAVING count(*) = n - 1
  UNION ALL SELECT document, p - 1, id, 1 FROM nk JOIN pool ON len(a) = 1 AND a[1] = w)
SELECT s.document, nw.token, CAST(s.n AS INTEGER) AS n_words, 'PASSAGE' AS entity_type FROM starts s
JOIN nw ON nw.document = s.document AND nw.p = s.at + 1""")
def q_detect_whole_entries(spark, d):
    """Dictionary entries of any length (the whole benchmark passages)."""
    pool = read(spark, d, "benchmark", "text").select(F.lit("PASSAGE").alias("entity_type"), F.col("text").alias("value"))
    return detect_entries(essays(spark, d), pool)


PAGE_DOMAINS = f"""doms AS (SELECT DISTINCT lower(regexp_extract(e, '@([A-Za-z0-9.-]+)', 1)) AS dom FROM
  (SELECT unnest(regexp_extract_all(html, '{PATTERN_RULES["EMAIL"]}', 0)) AS e FROM pages))"""


def _domains(spark, d):
    pages = read(spark, d, "pages", "page_id", "html")
    m = detect_patterns(pages, {"EMAIL": PATTERN_RULES["EMAIL"]}, "html", ("page_id",))
    return m.select(F.lower(F.regexp_extract("match", "@([A-Za-z0-9.-]+)", 1)).alias("value")).distinct()


@register("email_domain_in_pool", S.chain(MATCHES_SQL, PAGE_DOMAINS) + """
SELECT doc_id, occurrence, match FROM matches WHERE type = 'EMAIL'
  AND lower(regexp_extract(match, '@([A-Za-z0-9.-]+)', 1)) IN (SELECT dom FROM doms)""")
def q_email_domain_in_pool(spark, d):
    """Left semi join of e-mail matches with a domain pool."""
    m = detect_patterns(docs_text(spark, d), {"EMAIL": PATTERN_RULES["EMAIL"]})
    return email_domain_in_pool(m, _domains(spark, d)).select("doc_id", "occurrence", "match")


@register("email_domain_not_in_pool", S.chain(MATCHES_SQL, PAGE_DOMAINS) + """
SELECT doc_id, occurrence, match FROM matches WHERE type = 'EMAIL'
  AND lower(regexp_extract(match, '@([A-Za-z0-9.-]+)', 1)) NOT IN (SELECT dom FROM doms)""")
def q_email_domain_not_in_pool(spark, d):
    """Left anti join of e-mail matches with a domain pool."""
    m = detect_patterns(docs_text(spark, d), {"EMAIL": PATTERN_RULES["EMAIL"]})
    return email_domain_in_pool(m, _domains(spark, d), anti=True).select("doc_id", "occurrence", "match")


WOFF_SQL = """seps AS (
  SELECT document, CAST(generate_subscripts(sl, 1) - 1 AS BIGINT) AS token, unnest(sl) AS sep
  FROM (SELECT doc_id AS document, regexp_extract_all(text, '([ \\n]+)', 1) AS sl FROM documents)),
woff AS (SELECT w.document, w.token, w.word,
  coalesce(sum(length(w.word) + coalesce(length(s.sep), 0)) OVER (PARTITION BY w.document ORDER BY w.token
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM words w LEFT JOIN seps s USING (document, token))"""


@register("word_offsets", S.chain(S.WORDS, WOFF_SQL) + """
SELECT document, token, CAST(start AS BIGINT) AS start, CAST(start + length(word) AS BIGINT) AS "end" FROM woff""")
def q_word_offsets(spark, d):
    """Character start / end of every word (prefix sums inside the document row)."""
    w = explode_words(word_offsets(essays(spark, d)), with_offsets=True)
    return w.select("document", "token", "start", "end")


@register("rebuild_text", """
SELECT doc_id AS document, true AS same, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def q_rebuild_text(spark, d):
    """Tokens + separators rebuild the original text exactly."""
    r = rebuild_text(essays(spark, d))
    return r.select("document", (F.col("rebuilt_text") == F.col("full_text")).alias("same"),
                    F.length("full_text").alias("n_chars"))


@register("spans_to_bio", S.chain(S.WORDS, WOFF_SQL, OFFSETS_SQL) + """
, ov AS (SELECT w.document, w.token, o.type, o.occurrence FROM woff w JOIN offsets o
  ON o.doc_id = w.document AND w.start < o.start + length(o.match) AND o.start < w.start + length(w.word))
SELECT document, token, type, occurrence,
  CASE WHEN token = min(token) OVER (PARTITION BY document, type, occurrence) THEN 'B-' ELSE 'I-' END || type AS label
FROM ov""")
def q_spans_to_bio(spark, d):
    """The spans of all rules -> B-/I- word labels, inside the document row."""
    return label_matches(essays(spark, d)).select("document", "token", "type", "occurrence", "label")


SPANS_TO_BIO_SQL = S.chain(S.WORDS, WOFF_SQL, OFFSETS_SQL) + """
, ov AS (SELECT w.document, w.token, o.type, o.occurrence FROM woff w JOIN offsets o
  ON o.doc_id = w.document AND w.start < o.start + length(o.match) AND o.start < w.start + length(w.word))
SELECT document, token, type, occurrence,
  CASE WHEN token = min(token) OVER (PARTITION BY document, type, occurrence) THEN 'B-' ELSE 'I-' END || type AS label
FROM ov"""


def _spans_table(spark, d):
    return all_match_offsets(docs_text(spark, d)).select(
        F.col("doc_id").alias("document"), "type", "occurrence", "start", "end",
        F.concat_ws("|", "type", "occurrence").alias("span_id"))


def _labelled_by(spark, d, label):
    m = _spans_table(spark, d)
    with_any = essays(spark, d).join(m.select("document").distinct(), "document", "left_semi")
    b = label(explode_words(word_offsets(with_any), with_offsets=True), m)
    occurrence = F.split("span_id", "[|]").getItem(1).cast("long")
    return b.select("document", "token", "type", occurrence.alias("occurrence"), "label")


@register("spans_to_bio_join", SPANS_TO_BIO_SQL)
def q_spans_to_bio_join(spark, d):
    """R4 for spans that come as a table: only documents with spans are cut into words."""
    return _labelled_by(spark, d, spans_to_bio)


@register("spans_to_bio_sweep", SPANS_TO_BIO_SQL)
def q_spans_to_bio_sweep(spark, d):
    """R4 for a table of spans of any length: a sweep over the sorted borders of words and spans."""
    return _labelled_by(spark, d, spans_to_bio_sweep)


BIO_SPANS_SQL = S.chain(S.WORDS, S.LWORDS) + """
, e AS (SELECT *, CASE WHEN label = 'O' THEN 'O' ELSE substr(label, 3) END AS type FROM lwords WHERE label <> 'O'),
f AS (SELECT *, CASE WHEN label LIKE 'B-%' OR lag(token) OVER w IS NULL OR lag(token) OVER w <> token - 1
        OR lag(type) OVER w <> type THEN 1 ELSE 0 END AS st FROM e WINDOW w AS (PARTITION BY document ORDER BY token)),
g AS (SELECT *, sum(st) OVER (PARTITION BY document ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sp FROM f)
SELECT document, any_value(type) AS type, min(token) AS start_token, max(token) + 1 AS end_token FROM g GROUP BY document, sp"""


@register("bio_to_spans", BIO_SPANS_SQL)
def q_bio_to_spans(spark, d):
    """B-/I- labels -> entity spans, inside the document row."""
    return bio_spans_in_row(essays(spark, d))


@register("bio_to_spans_words", BIO_SPANS_SQL)
def q_bio_to_spans_words(spark, d):
    """R5 for a table of labelled words (gaps-and-islands over the sparse entity words)."""
    w = explode_words(essays(spark, d), with_labels=True)
    return bio_to_spans(w).select("document", "type", "start_token", "end_token")


RULE_ORDER = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(PATTERN_RULES)) + " END"


def _redacted_sql() -> str:
    """Offsets of all rules -> islands of overlapping spans -> text rebuilt around them."""
    return S.chain(OFFSETS_SQL) + f""",
o AS (SELECT doc_id, start, start + length(match) AS e, type, {RULE_ORDER} AS r FROM offsets),
i AS (SELECT *, CASE WHEN start < max(e) OVER (PARTITION BY doc_id ORDER BY start, e DESC, r
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM o),
g AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY start, e DESC, r ROWS UNBOUNDED PRECEDING) AS island FROM i),
m AS (SELECT doc_id, island, min(start) AS s, max(e) AS e, arg_min(type, struct_pack(a := start, b := -e, c := r)) AS type
      FROM g GROUP BY doc_id, island),
n AS (SELECT m.*, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM m),
x AS (SELECT n.doc_id, string_agg(substr(d.text, (before + 1)::INT, (s - before)::INT) || '[' || type || ']', '' ORDER BY s)
        || any_value(substr(d.text, (last + 1)::INT)) AS t
      FROM n JOIN documents d USING (doc_id) JOIN (SELECT doc_id, max(e) AS last FROM m GROUP BY doc_id) USING (doc_id)
      GROUP BY n.doc_id),
red AS (SELECT d.doc_id, coalesce(x.t, d.text) AS t FROM documents d LEFT JOIN x USING (doc_id))
SELECT doc_id, md5(t) AS redacted_md5, CAST(length(t) AS BIGINT) AS n_chars FROM red"""


@register("redact", _redacted_sql())
def q_redact(spark, d):
    """Redaction of the merged matches of all rules, in the row."""
    r = redact(docs_text(spark, d))
    return r.select("doc_id", F.md5("redacted").alias("redacted_md5"), F.length("redacted").alias("n_chars"))


@register("redact_spans", _redacted_sql())
def q_redact_spans(spark, d):
    """Redaction by a table of character spans (all rules), overlapping spans merged."""
    t = docs_text(spark, d)
    r = redact_spans(t, all_match_offsets(t).select("doc_id", "type", "start", "end"))
    return r.select("doc_id", F.md5("redacted").alias("redacted_md5"), F.length("redacted").alias("n_chars"))


SURR_SQL = """entries AS (
  SELECT DISTINCT 'EMAIL' AS entity_type, lower(replace(c_name, '#', '.')) || '@example.org' AS v FROM customer UNION
  SELECT 'PHONE_NUM', '+1 (555) ' || substr(lpad(s_suppkey::VARCHAR, 7, '0'), 1, 3) || '-' || substr(lpad(s_suppkey::VARCHAR, 7, '0'), 4) FROM supplier UNION
  SELECT 'ID_NUM', lpad(p_partkey::VARCHAR, 16, '0') FROM part UNION
  SELECT 'URL_PERSONAL', 'https://example.org/' || lower(replace(s_name, '#', '.')) FROM supplier),
spool AS (SELECT entity_type, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY v) - 1 AS BIGINT) AS idx, v FROM entries)"""


def _walk_sql(matches: str) -> str:
    """Twin of surrogates.assign_surrogates: the Feistel network walked until it lands inside the pool."""
    def f(n, half):
        return f"('0x' || substr(md5('{SALT}|' || type || '|' || cycle || '|{n}|' || {half}), 1, 8))::BIGINT"

    step = (f"(x // b + {f(1, 'x % b')}) % a AS l1, (x % b + {f(2, 'l1')}) % b AS r1, (l1 + {f(3, 'r1')}) % a AS l2, "
            f"(r1 + {f(4, 'l2')}) % b AS r2, l2 * b + r2 AS y")
    return f"""ranked AS (SELECT type, match, row_number() OVER (PARTITION BY type ORDER BY match) - 1 AS i FROM (SELECT DISTINCT type, match FROM {matches})),
sized AS (SELECT entity_type AS type, count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM spool GROUP BY 1),
walk AS (WITH RECURSIVE w(type, match, n, a, b, cycle, x) AS (
    SELECT type, match, n, a, b, cycle, y FROM (SELECT *, i // n AS cycle, i % n AS x, {step} FROM ranked JOIN sized USING (type))
    UNION ALL SELECT type, match, n, a, b, cycle, y FROM (SELECT *, {step} FROM w WHERE x >= n)) SELECT * FROM w WHERE x < n),
named AS (SELECT w.type, w.match, s.v FROM walk w JOIN spool s ON s.entity_type = w.type AND s.idx = w.x)"""


def _surrogates(spark, d):
    """A pool for each pattern type, made of names and keys of the tables."""
    def dotted(c):
        return F.lower(F.regexp_replace(c, "#", "."))

    phone = F.lpad(F.col("s_suppkey").cast("string"), 7, "0")
    pools = [("EMAIL", read(spark, d, "customer", "c_name").select(F.concat(dotted("c_name"), F.lit("@example.org")).alias("v"))),
             ("PHONE_NUM", read(spark, d, "supplier", "s_suppkey").select(
                 F.concat(F.lit("+1 (555) "), F.substring(phone, 1, 3), F.lit("-"), F.substring(phone, 4, 4)).alias("v"))),
             ("ID_NUM", read(spark, d, "part", "p_partkey").select(F.lpad(F.col("p_partkey").cast("string"), 16, "0").alias("v"))),
             ("URL_PERSONAL", read(spark, d, "supplier", "s_name").select(F.concat(F.lit("https://example.org/"), dotted("s_name")).alias("v")))]
    frames = [pool_from_table(df, kind, "v") for kind, df in pools]
    pool = frames[0]
    for f in frames[1:]:
        pool = pool.unionByName(f)
    return pool


@register("pseudonymise", S.chain(MATCHES_SQL, SURR_SQL, _walk_sql("matches")) + """
SELECT m.doc_id, m.type, m.occurrence, m.match, n.v AS surrogate FROM matches m JOIN named n USING (type, match)""")
def q_pseudonymise(spark, d):
    """Every match of every type gets a surrogate of its type: the same for the same value, others for others."""
    return pseudonymise(detect_patterns(docs_text(spark, d)), _surrogates(spark, d), SALT).select(
        "doc_id", "type", "occurrence", "match", "surrogate")


@register("pseudonymise_text", S.chain(OFFSETS_SQL, SURR_SQL, _walk_sql("matches")) + """
, spans AS (SELECT o.doc_id, o.start AS s, o.start + length(o.match) AS e, o.type, p.v FROM offsets o JOIN named p USING (type, match)),
marked AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM spans),
islands AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s, e DESC, type) AS island FROM marked),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e, CASE WHEN count(*) = 1 THEN min(v)
        ELSE coalesce(max(v) FILTER (WHERE e - s = whole AND first), '[' || min(type) FILTER (WHERE first) || ']') END AS v
      FROM (SELECT *, max(e) OVER w - min(s) OVER w AS whole, row_number() OVER (PARTITION BY doc_id, island ORDER BY s, e DESC, type) = 1 AS first
            FROM islands WINDOW w AS (PARTITION BY doc_id, island)) GROUP BY doc_id, island),
n AS (SELECT m.*, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM m),
x AS (SELECT n.doc_id, string_agg(substr(d.text, (before + 1)::INT, (s - before)::INT) || v, '' ORDER BY s)
        || any_value(substr(d.text, (last + 1)::INT)) AS t
      FROM n JOIN documents d USING (doc_id) JOIN (SELECT doc_id, max(e) AS last FROM m GROUP BY doc_id) USING (doc_id)
      GROUP BY n.doc_id)
SELECT d.doc_id, md5(coalesce(x.t, d.text)) AS text_md5, CAST(length(coalesce(x.t, d.text)) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN x USING (doc_id)""")
def q_pseudonymise_text(spark, d):
    """Every match of every type in the text replaced by its surrogate."""
    r = pseudonymise_text(docs_text(spark, d), _surrogates(spark, d), SALT, PATTERN_RULES)
    return r.select("doc_id", F.md5("pseudonymised").alias("text_md5"), F.length("pseudonymised").alias("n_chars"))


@register("pii_profile", S.chain(MATCHES_SQL) + """
SELECT m.type, d.source, CAST(count(*) AS BIGINT) AS n_entities, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS n_documents
FROM matches m JOIN documents d USING (doc_id) GROUP BY ROLLUP (m.type, d.source)""")
def q_pii_profile(spark, d):
    """Entities and affected documents by type and source, with rollup totals."""
    m = detect_patterns(read(spark, d, "documents", "doc_id", "text", "source"), keys=("doc_id", "source"))
    return pii_profile(m)


@register("pii_profile_merged", S.chain(MATCHES_SQL) + """
SELECT m.type, d.source, CAST(count(*) AS BIGINT) AS n_entities, true AS documents_within_error
FROM matches m JOIN documents d USING (doc_id) GROUP BY ROLLUP (m.type, d.source)""")
def q_pii_profile_merged(spark, d):
    """R10 from stored sketches: the documents come in three parts, each stored as a day, and the merged profile's distinct
    documents are held against the exact profile (four standard errors, and rounding)."""
    from ..session import scratch_path

    docs = read(spark, d, "documents", "doc_id", "text", "source")
    path = scratch_path(spark, "profile")
    for part in range(3):
        arrived = docs.filter(F.pmod("doc_id", F.lit(3)) == part)
        write_profile(detect_patterns(arrived, keys=("doc_id", "source")), path, f"2024-01-0{part + 1}")
    exact = detect_patterns(docs, keys=("doc_id", "source")).rollup("type", "source").agg(
        F.grouping_id().cast("int").alias("_level"), F.countDistinct("doc_id").alias("_exact")).withColumnsRenamed({"type": "_type", "source": "_source"})
    same = F.col("type").eqNullSafe(F.col("_type")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("level") == F.col("_level"))
    close = F.abs(F.col("n_documents") - F.col("_exact")) <= 4 * standard_error() * F.col("_exact") + 0.5
    return read_profile(spark, path).join(exact, same, "left").select(
        "type", "source", "n_entities", F.coalesce(close, F.lit(False)).alias("documents_within_error"))


@register("convert_labels", S.chain(S.WORDS, S.LWORDS) + f"""
SELECT document, token, label, {S.label_id_case('label', TAXONOMIES['full15'])} AS id_full15,
  {S.label_id_case("CASE WHEN label = 'O' THEN 'O' ELSE substr(label, 3) END", TAXONOMIES['reduced'])} AS id_reduced
FROM lwords""")
def q_convert_labels(spark, d):
    """13-label words into the 15-label taxonomy and the reduced (prefix-free) one."""
    w = explode_words(essays(spark, d), with_labels=True)
    w = convert_labels(convert_labels(w, "label", "full15", "id_full15"), "label", "reduced", "id_reduced", reduce_bio=True)
    return w.select("document", "token", "label", "id_full15", "id_reduced")


@register("id_to_label", S.chain(*WIN_SQL) + """
SELECT label, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT label FROM wp WHERE ppos IS NOT NULL
  UNION ALL SELECT 'O' FROM wins UNION ALL SELECT 'O' FROM wins) GROUP BY label""")
def q_id_to_label(spark, d):
    """Window label ids mapped back to labels; ids outside the taxonomy (-100) read as 'O'."""
    w = windows(spark, d).select(F.explode("label_ids").alias("id"))
    return w.select(id_label(F.col("id"), "bio13", default="O").alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


@register("score_windows", S.chain(*OCC) + """
SELECT document, win AS "window", CAST(count(*) AS BIGINT) AS n_pieces, round(sum(p12), 6) AS sum_outside FROM occ
GROUP BY document, win""")
def q_score_windows(spark, d):
    """Partition-wise model hook (mapInPandas) producing per-window probability arrays."""
    from .synthetic import scored_windows
    s = scored_windows(essays(spark, d))
    return s.select("document", "window", F.size("word_ids").alias("n_pieces"),
                    round_half_away(F.aggregate(F.transform("probs", lambda p: p[12]), F.lit(0.0), lambda a, x: a + x), 6)
                    .alias("sum_outside"))


@register("stream_redact", _redacted_sql())
def q_stream_redact(spark, d):
    """Structured Streaming: documents arriving as files -> redaction -> Parquet sink with a
    checkpoint (availableNow trigger); the sink equals the batch redaction."""
    from ..session import scratch_path
    from ..streaming.redact_stream import start_redaction
    src, out, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-out", "stream-ckpt"))
    read(spark, d, "documents").write.mode("overwrite").parquet(src)
    q = start_redaction(spark, src, out, ckpt, available_now=True)
    q.awaitTermination()
    r = spark.read.parquet(out)
    return r.select("doc_id", F.md5("redacted").alias("redacted_md5"), F.length("redacted").alias("n_chars"))
