"""Queries of the training-data operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the package is shipped to the workers before it runs."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# In RE2 the mark classes have to be spelled out; the twin escapes exactly what ChatTemplate escapes.
_ESC = r"""regexp_replace({0}, '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|unk>))|(\[)(\\*(?:INST\]|/INST\]))', '\1\3\\\2\4', 'g')"""
_CONTROL = r"""regexp_matches({0}, '<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|unk>)|\[\\*(?:INST\]|/INST\])')"""


@query("op1_chat_formatting", sql=f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, {_CONTROL.format("text")} OR {_CONTROL.format("role")} OR contains(role, chr(10)) OR contains(role, '%0A')
            OR contains(role, '%25') AS conflict FROM src),
formed AS (
  SELECT conv_id, turn, role, text, length('<|im_start|>') + 1 + length('<|im_end|>') + 1
         + length(CASE WHEN conflict THEN {_ESC.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} ELSE role END)
         + length(CASE WHEN conflict THEN {_ESC.format("text")} ELSE text END) AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM formed GROUP BY conv_id""")
def op1_chat_formatting(spark, sf_dir):
    """All conversations plus one whose texts are control strings, rendered, parsed back and digested."""
    from .chat_format import format_conversations, read_back

    conversations = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conversations.unionByName(planted)))


@query("op2_sentencepiece_codec")
def op2_sentencepiece_codec(spark, sf_dir):
    """Encode and decode every whole text; digests of ids and decoded text."""
    from .sentencepiece_codec import PieceModel, codec_digests

    return codec_digests(table(spark, sf_dir, "documents"), PieceModel.load(piece_model_path()))


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    """Learn on documents whose crc32(doc_id) mod 4 is not 2, predict every whole text."""
    from .language_id import detect_language, fit_language_model
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.filter(~F.coalesce(held_out, F.lit(False)) & F.col("doc_id").isNotNull()))
    return detect_language(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")),
                           model).drop("text")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op3_minhash_near_dup", sql=f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), {_LOWER})")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN
        list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))
        WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""")
def op3_minhash_near_dup(spark, sf_dir):
    """Near-duplicate classes of all documents."""
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _doublings(levels: int) -> str:
    """CTEs l0, l1, ...: windows of 13, 26, 52, ... words found in two documents (documents with one word sequence are
    one), and longest: the greatest length by document."""
    parts = ["""sequences AS (SELECT doc_id, w, sha256(list_aggregate(w, 'string_agg', ' ')) AS t FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
reps AS (SELECT t, min(doc_id) AS rep FROM sequences GROUP BY t),
l0 AS (SELECT k, doc_id, t, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) <> max(doc_id) OVER (PARTITION BY k) AS twice
  FROM (SELECT rep AS doc_id, t, p, md5(list_aggregate(w[p:p + 12], 'string_agg', ' ')) AS k
        FROM (SELECT rep, t, w, unnest(range(1, len(w) - 11)) AS p FROM (SELECT DISTINCT rep, t, w FROM reps JOIN sequences USING (t) WHERE rep = doc_id)))) WHERE twice)"""]
    for i in range(1, levels):
        parts.append(f"""l{i} AS (SELECT k, doc_id, t, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) <> max(doc_id) OVER (PARTITION BY k) AS twice
  FROM (SELECT a.doc_id, a.t, a.p, md5(a.k || b.k) AS k FROM l{i - 1} a JOIN l{i - 1} b ON a.doc_id = b.doc_id AND a.t = b.t AND b.p = a.p + {13 * 2 ** (i - 1)})) WHERE twice)""")
    every = " UNION ALL ".join(f"SELECT doc_id, t, {13 * 2 ** i} AS size FROM l{i}" for i in range(levels))
    parts.append(f"longest AS (SELECT t, max(size) AS size FROM ({every}) GROUP BY t)")
    return ",\n".join(parts)


# eleven levels: up to 13,312 words, the longest window of 13 doubled that a text of the tables (20,000 words) can hold
@query("op8_substring_dedup", sql=f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN firsts USING (k) WHERE doc_id > first_doc),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
{_doublings(11)}
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256,
       coalesce(size, 0)::BIGINT AS longest_repeat
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN sequences s ON s.doc_id = d.doc_id LEFT JOIN longest ON longest.t = s.t""")
def op8_substring_dedup(spark, sf_dir):
    """Words of 13-word windows that start in an earlier document are removed; the levels go on by doubling to the
    greatest length at which a window of the document repeats in another."""
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), longest=True)


_BLANK = r"chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"


@query("op5_line_spread", sql=f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, coalesce(source, chr(1)) AS source, line, pos, trim(line, {_BLANK}) AS k FROM l),
b AS (SELECT k, min(doc_id) AS first_doc FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
j AS (SELECT k.*, coalesce(doc_id > first_doc, false) AS gone FROM k LEFT JOIN b USING (k))
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM j GROUP BY doc_id) USING (doc_id)""")
def op5_line_spread(spark, sf_dir):
    """Lines on ten sources or more are removed from all documents but the first that holds them."""
    from .line_spread import remove_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_HOST = r"""translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _level_strength(children: str, parent: str) -> str:
    """Twin of url_reputation._strength."""
    return f"""(SELECT CASE WHEN coalesce(sum(total), 0) = 0 OR coalesce(sum(total - nn / total), 0) = 0
              OR sum(kk - total * mean * mean - (parts - 1) * mean * (1 - mean)) <= 0 THEN 10000.0
         ELSE least(10000.0, greatest(1.0, sum(total * mean * (1 - mean)) / sum(total)
              / (sum(kk - total * mean * mean - (parts - 1) * mean * (1 - mean)) / sum(total - nn / total)) - 1)) END AS s
       FROM (SELECT sum(n) AS total, sum(k) / sum(n) AS mean, count(*) AS parts, sum(k * k / n) AS kk, sum(n * n) AS nn
             FROM {children} WHERE n > 0 GROUP BY {parent}))"""


def _suffix_rules() -> str:
    """Twin of url_reputation.suffix_labels: labels of the public suffix, rule by rule."""
    from .url_reputation import PUBLIC_SUFFIXES

    out = []
    for rule in sorted(PUBLIC_SUFFIXES, key=lambda r: (not r.startswith("!"), -r.count("."))):
        n = rule.count(".") + 1
        if rule.startswith("!"):
            out.append(f"WHEN name = '{rule[1:]}' OR name LIKE '%.{rule[1:]}' THEN {n - 1}")
        elif rule.startswith("*."):
            out.append(f"WHEN name LIKE '%.{rule[2:]}' THEN {n}")
        else:
            out.append(f"WHEN name = '{rule}' OR name LIKE '%.{rule}' THEN {n}")
    return f"CASE {' '.join(out)} ELSE 1 END"


_SUFFIX_LABELS = _suffix_rules()


@query("op4_url_reputation", sql=f"""
WITH r AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
o AS (SELECT doc_id AS page_id, max(CASE (quality = 0 OR toxic = 1) WHEN true THEN 1.0::DOUBLE WHEN false THEN 0.0::DOUBLE END) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM h),
cut AS (SELECT host, n, k, name, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') AS address, {_SUFFIX_LABELS} AS s FROM named),
hosts AS (SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(l[-(s + 1):], '.') END AS domain,
                 CASE WHEN address THEN 'address' ELSE array_to_string(l[-s:], '.') END AS suffix FROM cut),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS al, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
overall AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m FROM suffixes),
a AS {_level_strength("suffixes", "al")}, b AS {_level_strength("domains", "suffix")}, c AS {_level_strength("hosts", "domain")},
sr AS (SELECT suffix, (k + a.s * m) / (n + a.s) AS suffix_rate FROM suffixes, a, overall),
dr AS (SELECT domain, (k + b.s * suffix_rate) / (n + b.s) AS domain_rate FROM domains JOIN sr USING (suffix), b),
xy AS (SELECT host, k + c.s * domain_rate AS x, n - k + c.s * (1 - domain_rate) AS y FROM hosts JOIN dr USING (domain), c),
bound AS (SELECT host, x / (x + y) - 1.645::DOUBLE * sqrt(x / (x + y) * (1 - x / (x + y)) / (x + y + 1)) AS bound FROM xy),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
       WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled JOIN bound USING (host)""")
def op4_url_reputation(spark, sf_dir):
    """Every page's url judged by the four rules, else by its host's reputation (labels of its id)."""
    from .url_reputation import UrlRule, judge_urls

    rules = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
             UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    """Statistics, base rule and learned decision list for every document."""
    from .decision_list import COUNTS, apply_rules, learn_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


_SIZED = r"""SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM documents GROUP BY source"""


@query("mixing_targets", sql=f"""
WITH RECURSIVE sized AS ({_SIZED}),
w AS (SELECT source, n, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM sized),
fill(step, source, n, weight, is_full) AS (  -- whoever would get more than three times its size is full; again until none is
  SELECT 0, source, n, weight, false FROM w UNION ALL
  SELECT step + 1, source, n, weight, is_full OR share * weight > 3 * n FROM (
    SELECT *, (sum(n) OVER () - sum(3 * n) FILTER (WHERE is_full) OVER ()) / sum(weight) FILTER (WHERE NOT is_full) OVER () AS share0,
           coalesce(share0, sum(n) OVER () / sum(weight) OVER ()) AS share FROM fill) WHERE step < (SELECT count(*) FROM w)),
done AS (SELECT * FROM fill WHERE step = (SELECT count(*) FROM w))
SELECT source, n AS source_size, CASE WHEN is_full THEN 3.0 * n ELSE
         weight * ((SELECT sum(n) FROM w) - (SELECT coalesce(sum(3 * n), 0) FROM done WHERE is_full)) / (SELECT sum(weight) FROM done WHERE NOT is_full) END AS target
FROM done""")
def mixing_targets(spark, sf_dir):
    """Size and target of every source of all documents."""
    from .mixing import source_targets, word_count

    docs = table(spark, sf_dir, "documents").select(F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    return source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    """All documents mixed to the sources' target weights; the words the mix takes of each."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_cross_polytope")
def op10_cross_polytope(spark, sf_dir):
    """Ten nearest of every vector whose id is divisible by 100, among all others."""
    from .cross_polytope import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's rewriting of every tenth document (by crc32 of its id): from word a on the words repeat
    with period p. Other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))

    def repeated(w):  # w is bound once: the words are extracted once
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(period, times))),
                                    F.lit(1), n.cast("int")), " ")

    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(chosen, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Runs of every whole text after the contract's rewriting, the highest power and the collapsed text."""
    from .periodic_runs import collapse_runs

    return collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")))


@query("op12_prefix_trie", sql="""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
                  length(coalesce(text, ''))::BIGINT AS chars, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, g, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS i FROM t),
z AS (SELECT conv_id, count(*) AS own FROM o GROUP BY 1),
crc AS (  -- crc32 by its table, a byte at a time
  WITH RECURSIVE tab(n, c, k) AS (SELECT n, n::BIGINT, 0 FROM range(256) r(n) UNION ALL
         SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM tab WHERE k < 8),
  byte AS (SELECT n, c FROM tab WHERE k = 8),
  step(conv_id, s, c) AS (SELECT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM z UNION ALL
         SELECT conv_id, s[2:], xor(step.c // 256, byte.c) FROM step JOIN byte ON byte.n = xor(step.c % 256, ascii(s[1])::BIGINT) WHERE s <> '')
  SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM step WHERE s = ''),
v AS (SELECT z.conv_id, h, z.conv_id - z.conv_id % 100 AS base, least(h, coalesce(b.own, 0)) AS got
      FROM z JOIN crc USING (conv_id) LEFT JOIN z b ON b.conv_id = z.conv_id - z.conv_id % 100),
r AS (SELECT v.conv_id, i + 1 AS pos, g, chars FROM v JOIN o ON o.conv_id = base WHERE i < h
      UNION ALL SELECT conv_id, i - h + got + 1, g, chars FROM v JOIN o USING (conv_id) WHERE i >= h),
p AS (SELECT conv_id, pos AS depth, string_agg(g, '') OVER w AS k, chars FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY pos) UNION ALL SELECT conv_id, 0, '', 0 FROM z),
n AS (SELECT k, depth, min(conv_id) AS owner, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY k, depth),
m AS (SELECT p.conv_id, p.k, p.depth, n.owner, n.n_convs, n.chars FROM p JOIN n USING (k, depth)),
kids AS (SELECT left(k, 32 * (depth - 1)) AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
below AS (SELECT DISTINCT x.k, x.depth, y.k AS yk, y.depth AS yd, y.n_convs AS yn, y.chars AS yc
          FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
sums AS (SELECT b.k, b.depth, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((yn - 1) * yc)::BIGINT AS saved_tokens
         FROM below b LEFT JOIN kids ON kids.k = yk AND kids.depth = yd GROUP BY ALL),
last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
ends AS (SELECT m.k, m.depth, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids
         FROM m JOIN last USING (conv_id, depth) GROUP BY ALL)
SELECT n.owner AS conv_id, n.depth, q.owner AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.k = left(n.k, 32 * (n.depth - 1)) LEFT JOIN kids ON kids.k = n.k AND kids.depth = n.depth
JOIN sums ON sums.k = n.k AND sums.depth = n.depth LEFT JOIN ends ON ends.k = n.k AND ends.depth = n.depth""")
def op12_prefix_trie(spark, sf_dir):
    """Trie of all conversations after the contract's rebuilding from shared first turns."""
    from .prefix_trie import ordered_turns, prefix_trie, with_shared_heads

    return prefix_trie(with_shared_heads(ordered_turns(table(spark, sf_dir, "conversations"))))


@query("op11_secret_scan")
def op11_secret_scan(spark, sf_dir):
    """Secrets of every whole text: fixed patterns, and literals assigned to sensitive names."""
    from .secret_scan import scan_secrets, secret_digests

    return secret_digests(scan_secrets(table(spark, sf_dir, "documents")))
