"""Streaming detection and redaction of arriving documents.

``readStream`` over a folder of document files -> rule detection / redaction (stateless,
per-row) -> ``writeStream`` to Parquet with a checkpoint in the shared folder, so a restarted
or retried query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import PATTERN_RULES, detect_patterns
from ..operators.redact import redact

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, source_dir: str, schema: str = DOC_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def redacted_stream(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """Redacted text plus per-type match counts, one output row per input document."""
    rules = rules or PATTERN_RULES
    counts = [F.size(F.regexp_extract_all(F.col("text"), F.lit(p), 0)).alias(f"n_{t.lower()}") for t, p in rules.items()]
    return redact(docs, rules).select("doc_id", "redacted", *counts)


def match_stream(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row per detected match (the R1 detector on a stream)."""
    return detect_patterns(docs, rules)


def start_redaction(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                    available_now: bool = True, rules: dict | None = None):
    """Start the redaction query; ``available_now`` processes what is there and stops."""
    out = redacted_stream(document_stream(spark, source_dir), rules)
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)
