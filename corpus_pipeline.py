"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.llm.decision_list import apply_rules, learn_rules
from piisieve.llm.line_spread import remove_boilerplate
from piisieve.llm.minhash_dedup import near_duplicates
from piisieve.llm.mixing import document_hash, mix
from piisieve.llm.queries import piece_model_path, table
from piisieve.llm.sentencepiece_codec import PieceModel, codec_digests
from piisieve.llm.tables import stored
from piisieve.operators.indexing import with_row_index
from piisieve.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECE_WORDS = 5_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share stay in the first document alone; a document that loses all its words goes."""
    cut = remove_boilerplate(docs.select(*COLUMNS))
    has_words = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return (cut.filter((F.col("n_removed") == 0) | has_words)
            .withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long"))
            .select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id.

    Rows without an id and rows that share one are told apart by a digest of their text: rows that agree in both
    are one document, and each document gets a number above all ids for the search. So of such a class a
    document whose id is its own stays, if there is one.
    """
    ship_package(spark)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = stored(ids.filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared_id")), "shared-ids")
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    apart = docs.join(shared, same, "left_semi").withColumn("text_hash", document_hash("doc_id", "text")).dropDuplicates(["doc_id", "text_hash"])
    highest = docs.agg(F.max("doc_id").alias("id")).first()["id"] or 0  # one number
    numbers = with_row_index(apart.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "place").select(
        F.col("doc_id").alias("shared_id"), F.col("text_hash").alias("shared_hash"), (F.col("place") + highest + 1).alias("node"))
    numbered = apart.join(numbers, same & (F.col("text_hash") == F.col("shared_hash")))
    every = docs.join(shared, same, "left_anti").select(*COLUMNS, F.col("doc_id").alias("node")).unionByName(
        numbered.select(*COLUMNS, "node"))
    gone = near_duplicates(every, key="node").filter("NOT kept").select(F.col("doc_id").alias("node"))
    return every.join(gone, "node", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, one row for each copy it takes, in shards and in shuffled order inside them."""
    # null-free keys: repeated rows are found and joined to their draws in one shuffle of the texts
    keys = {"k1": F.coalesce("doc_id", F.lit(-1 << 63)), "k2": F.coalesce("source", F.lit("\x00none"))}
    mixed = mix(docs.select("doc_id", "text", "source"))
    words = mixed.agg(F.sum("taken").alias("words")).first()["words"] or 0  # one number
    pieces = max(64, -(-words // (16 * PIECE_WORDS)))  # parts of a shard, so that tasks stay of one size
    drawn = (mixed.filter("size(draws) > 0").withColumns(keys)
             .groupBy("k1", "k2", "h").agg(F.flatten(F.collect_list("draws")).alias("draws")))
    # rows that agree in id, source and text are repeated rows: their draws are one list
    rows = docs.withColumns(keys).withColumn("h", document_hash("doc_id", "text")).dropDuplicates(["k1", "k2", "h"])
    return (rows.join(drawn, ["k1", "k2", "h"]).select(*COLUMNS, F.explode("draws").alias("draw"))
            .repartition("draw.shard", F.pmod("draw.position", F.lit(pieces))).sortWithinPartitions("draw.shard", "draw.position")
            .select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document of the mix."""
    ship_package(spark)
    return codec_digests(docs, PieceModel.load(piece_model_path()))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup),
          ("mixing", mix_sources), ("token ids", token_ids)]

#: Learned rules, hashed draws and token ids are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
