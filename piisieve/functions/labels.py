"""Label taxonomies and dictionary lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_ID = -100     # label id ignored by the loss, also any label missing from a taxonomy
SPECIAL_WORD = -1    # word id of special / padding pieces

# ---- fixed values: label -> id taxonomies; they must equal the reference's ids ----
# The last id of every taxonomy is the outside class "O".
TAXONOMIES: dict[str, list[str]] = {
    "reduced": ["EMAIL", "ID_NUM", "NAME_STUDENT", "PHONE_NUM", "STREET_ADDRESS",
                "URL_PERSONAL", "USERNAME", "O"],
    "bio13": ["B-EMAIL", "B-ID_NUM", "B-NAME_STUDENT", "B-PHONE_NUM", "B-STREET_ADDRESS",
              "B-URL_PERSONAL", "B-USERNAME", "I-ID_NUM", "I-NAME_STUDENT", "I-PHONE_NUM",
              "I-STREET_ADDRESS", "I-URL_PERSONAL", "O"],
    "full15": ["B-EMAIL", "B-ID_NUM", "B-NAME_STUDENT", "B-PHONE_NUM", "B-STREET_ADDRESS",
               "B-URL_PERSONAL", "B-USERNAME", "I-EMAIL", "I-ID_NUM", "I-NAME_STUDENT",
               "I-PHONE_NUM", "I-STREET_ADDRESS", "I-URL_PERSONAL", "I-USERNAME", "O"],
    "aux": ["B-NAME_STUDENT", "B-NAME_OTHER", "I-NAME_STUDENT", "I-NAME_OTHER", "O"],
    "conll": ["B-LOC", "B-MISC", "B-ORG", "B-PER", "I-LOC", "I-MISC", "I-ORG", "I-PER", "O"],
}
# ---- end of fixed values ----


def taxonomy(name_or_labels) -> list[str]:
    labels = TAXONOMIES[name_or_labels] if isinstance(name_or_labels, str) else list(name_or_labels)
    if not labels or labels[-1] != "O":
        raise ValueError("a taxonomy must end with the outside label 'O'")
    if len(set(labels)) != len(labels):
        raise ValueError("taxonomy labels must be distinct")
    return labels


def label2id(name_or_labels) -> dict[str, int]:
    return {lab: i for i, lab in enumerate(taxonomy(name_or_labels))}


def label_to_id_map(name_or_labels) -> Column:
    """Literal map label -> id; size bounded by the taxonomy (at most a few dozen)."""
    d = label2id(name_or_labels)
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def id_to_label_map(name_or_labels) -> Column:
    d = label2id(name_or_labels)
    return F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in d.items()))


def label_id(label: Column, name_or_labels) -> Column:
    """Label string -> id; unknown or null labels give -100."""
    return F.coalesce(label_to_id_map(name_or_labels)[label], F.lit(IGNORE_ID))


def id_label(idx: Column, name_or_labels, default: str | None = None) -> Column:
    """Id -> label string (R12); ``default`` for ids outside the taxonomy (e.g. 'O' in previews)."""
    out = id_to_label_map(name_or_labels)[idx]
    return F.coalesce(out, F.lit(default)) if default is not None else out


def entity_type(label: Column) -> Column:
    """'B-EMAIL' -> 'EMAIL'; 'O' stays 'O' (prefix stripped only for B-/I- labels)."""
    return F.when(label == F.lit("O"), F.lit("O")).otherwise(F.substring(label, F.lit(3), F.length(label)))


def taxonomy_table(spark: SparkSession, names=None) -> DataFrame:
    """D13 as a table (taxonomy, label, id)."""
    names = names or list(TAXONOMIES)
    rows = [(n, lab, i) for n in names for i, lab in enumerate(taxonomy(n))]
    return spark.createDataFrame(rows, "taxonomy string, label string, id int")


def convert_labels(df: DataFrame, label_col: str, to: str, out_col: str = "label_id",
                   reduce_bio: bool = False) -> DataFrame:
    """Map labels into taxonomy ``to``; with ``reduce_bio`` strip B-/I- first (BIO -> reduced)."""
    lab = entity_type(F.col(label_col)) if reduce_bio else F.col(label_col)
    return df.withColumn(out_col, label_id(lab, to))
