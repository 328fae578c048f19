"""DuckDB building blocks for the oracle queries (independent formulations of the same rules)."""

from __future__ import annotations

from ..functions.labels import TAXONOMIES
from ..operators.curve import THRESHOLD_GRID

SPLIT = "regexp_split_to_array(text, '[ \\n]+')"
BIO13 = TAXONOMIES["bio13"]
BIO13_LIST = "[" + ", ".join(f"'{x}'" for x in BIO13) + "]"


def label_case(word: str = "word") -> str:
    return (f"CASE WHEN regexp_matches({word}, '@[A-Za-z0-9.-]+[.]') THEN 'B-EMAIL' "
            f"WHEN regexp_matches({word}, '^[0-9]{{16}}') THEN 'B-ID_NUM' "
            f"WHEN regexp_matches({word}, '^[+]1$') THEN 'B-PHONE_NUM' "
            f"WHEN regexp_matches({word}, '^[(][0-9]{{3}}[)]$') OR regexp_matches({word}, '^[0-9]{{3}}-[0-9]{{4}}') "
            f"THEN 'I-PHONE_NUM' ELSE 'O' END")


def label_id_case(label: str = "label", taxonomy=BIO13) -> str:
    whens = " ".join(f"WHEN '{lab}' THEN {i}" for i, lab in enumerate(taxonomy))
    return f"CAST(CASE {label} {whens} ELSE -100 END AS BIGINT)"


WORDS = f"""words AS (
  SELECT document, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS token,
         unnest(arr) AS word, CAST(len(arr) AS BIGINT) AS n_words
  FROM (SELECT doc_id AS document, {SPLIT} AS arr FROM documents))"""

LWORDS = f"""lwords AS (
  SELECT document, token, word, n_words, {label_case('word')} AS label FROM words)"""

GOLD = """gold AS (SELECT document, token, label FROM lwords WHERE label <> 'O')"""


def occurrences(cap: int = 1024, step: int = 768) -> str:
    ws = "\n".join(f"    1 + (({k} + h) % 5) + CASE WHEN fav = {k} THEN 40 ELSE 0 END AS w{k}," for k in range(12))
    ps = ",\n".join(f"    CAST(w{k} AS DOUBLE) / CAST(wsum * (m + 1) AS DOUBLE) AS p{k}" for k in range(12))
    wsum = " + ".join(f"w{k}" for k in range(12))
    return f"""occ0 AS (
  SELECT document, token, {label_id_case('label')} AS g,
    unnest(generate_series(
      greatest(0, CAST(floor((token - {cap}) / {float(step)}) AS BIGINT) + 1),
      least(CAST(greatest(0, ceil((n_words - {cap}) / {float(step)})) AS BIGINT),
            CAST(floor(token / {float(step)}) AS BIGINT)))) AS win
  FROM lwords),
occ1 AS (
  SELECT document, token, win, g, 13 * document + 29 * token + 5 * win AS h FROM occ0),
occ2 AS (
  SELECT document, token, win, h,
    CASE WHEN g >= 0 AND g < 12 THEN 1 + h % 14 ELSE 60 + h % 190 END AS m,
    CASE WHEN g >= 0 AND g < 12 THEN (CASE WHEN h % 4 = 0 THEN (g + 1) % 12 ELSE g END) ELSE h % 12 END AS fav
  FROM occ1),
occ3 AS (
  SELECT document, token, win, m,
{ws}
    0 AS _z FROM occ2),
occ4 AS (SELECT *, {wsum} AS wsum FROM occ3),
occ AS (
  SELECT document, token, win,
{ps},
    CAST(m AS DOUBLE) / CAST(m + 1 AS DOUBLE) AS p12
  FROM occ4)"""


def pred(cut: float = 0.995) -> str:
    avgs = ",\n".join(f"    round(avg(p{k}), 9) AS p{k}" for k in range(13))
    plist = ", ".join(f"p{k}" for k in range(12))
    return f"""mean AS (
  SELECT document, token,
{avgs}
  FROM occ WHERE p12 < {cut} GROUP BY document, token),
pred AS (
  SELECT *, p12 AS outside_prob,
    {BIO13_LIST}[list_position([{plist}], greatest({plist}))] AS most_probable_label
  FROM mean)"""


def labelled(th: float, name: str = "labelled") -> str:
    return f"""{name} AS (
  SELECT document, token, CASE WHEN outside_prob <= {th} THEN most_probable_label ELSE 'O' END AS label
  FROM pred)"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def etype(label: str) -> str:
    return f"CASE WHEN {label} = 'O' THEN 'O' ELSE substr({label}, 3) END"


def type_counts(predicted: str = "predicted", gold: str = "gold") -> str:
    """tp/fp/fn per type with set algebra (INTERSECT / EXCEPT), an independent formulation."""
    return f"""tp_rows AS (SELECT document, token, label FROM {predicted} INTERSECT SELECT document, token, label FROM {gold}),
fp_rows AS (SELECT document, token, label FROM {predicted} EXCEPT SELECT document, token, label FROM {gold}),
fn_rows AS (SELECT document, token, label FROM {gold} EXCEPT SELECT document, token, label FROM {predicted}),
events AS (
  SELECT {etype('label')} AS type, 1 AS tp, 0 AS fp, 0 AS fn FROM tp_rows
  UNION ALL SELECT {etype('label')}, 0, 1, 0 FROM fp_rows
  UNION ALL SELECT {etype('label')}, 0, 0, 1 FROM fn_rows),
counts0 AS (
  SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM events GROUP BY type),
counts AS (SELECT * FROM counts0 WHERE (SELECT count(*) FROM {predicted}) > 0)"""


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn", beta: float = 5.0) -> str:
    b2 = beta * beta
    p = f"(CAST({tp} AS DOUBLE) / (CAST({tp} AS DOUBLE) + CAST({fp} AS DOUBLE) + 1e-100))"
    r = f"(CAST({tp} AS DOUBLE) / (CAST({tp} AS DOUBLE) + CAST({fn} AS DOUBLE) + 1e-100))"
    return (f"{p} AS p, {r} AS r, 2.0 * (({p} * {r}) / ({p} + {r} + 1e-100)) AS f1, "
            f"({1.0 + b2} * {p} * {r}) / ({b2} * {p} + {r} + 1e-100) AS f{beta:g}")


GRID_VALUES = ", ".join(f"(CAST({i} AS BIGINT), CAST({t!r} AS DOUBLE))" for i, t in enumerate(THRESHOLD_GRID))
GRID = f"grid(grid_idx, threshold) AS (VALUES {GRID_VALUES})"


PIECE_RE = " ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 ]"

PIECES = f"""ptok AS (
  SELECT document, token, CASE WHEN token > 0 THEN ' ' || word ELSE word END AS itok, label FROM lwords),
pieces0 AS (
  SELECT document, token, label, unnest(regexp_extract_all(itok, '{PIECE_RE}', 0)) AS piece,
         generate_subscripts(regexp_extract_all(itok, '{PIECE_RE}', 0), 1) AS k
  FROM ptok),
pieces AS (
  SELECT document, token, label, piece,
         CAST(row_number() OVER (PARTITION BY document ORDER BY token, k) - 1 AS BIGINT) AS ppos
  FROM pieces0),
npieces AS (
  SELECT d.doc_id AS document, count(p.ppos) AS n
  FROM documents d LEFT JOIN pieces p ON p.document = d.doc_id GROUP BY d.doc_id)"""


def windows(cap: int, step: int) -> str:
    """Window rows and their content pieces: each piece is exploded into the windows holding it."""
    nw = f"CAST(greatest(0, ceil((n - {cap}) / {float(step)})) AS BIGINT)"
    return f"""wins AS (
  SELECT document, n, unnest(generate_series(0, {nw})) AS "window" FROM npieces),
pw AS (
  SELECT p.*, np.n FROM pieces p JOIN npieces np USING (document)),
wp AS (
  SELECT document, "window", ppos - "window" * {step} + 1 AS pos, ppos, token, label FROM (
    SELECT document, ppos, token, label, unnest(generate_series(
      greatest(0, CAST(floor((ppos - {cap}) / {float(step)}) AS BIGINT) + 1),
      least({nw}, CAST(floor(ppos / {float(step)}) AS BIGINT)))) AS "window"
    FROM pw)
  UNION ALL SELECT document, 0, NULL, NULL, NULL, NULL FROM npieces WHERE n = 0)"""
