"""Essay sources (S1, S2, S6) and the D1 schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESSAY_SCHEMA = T.StructType([
    T.StructField("document", T.LongType(), False),
    T.StructField("full_text", T.StringType(), True),
    T.StructField("tokens", T.ArrayType(T.StringType()), True),
    T.StructField("trailing_whitespace", T.ArrayType(T.BooleanType()), True),
    T.StructField("labels", T.ArrayType(T.StringType()), True),
])

FOLD_SCHEMA = "document long, kfold int"


def read_essays(spark: SparkSession, path: str, multi_line: bool = True, schema=ESSAY_SCHEMA, split: bool = False) -> DataFrame:
    """Essays from JSON with a declared schema (labels optional, decided by schema: T13).

    ``multi_line=True`` reads files of one array each, a file a task; ``split=True`` reads such files in byte
    ranges, three times, and raises where one is malformed (``json_array``). JSON lines (``multi_line=False``) are
    split by Spark.
    """
    if split:
        from .json_array import read_json_array
        return read_json_array(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_essays_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def read_mixture(spark: SparkSession, path: str, sets=None, set_col: str = "set_name",
                 json_object: bool = False) -> DataFrame:
    """Named mixture as one table with a ``set_name`` column.

    Parquet layout: partitioned by ``set_name``, so a set filter prunes directories. The JSON object
    form (top-level set name -> [essay]) has its set names as fields: requested names are declared
    as the schema, so nothing else is parsed; without a request the names are read from the file's
    own schema. A requested set that is not there raises. One such file cannot be split: convert it
    once with ``write_mixture``.
    """
    if not json_object:
        df = spark.read.parquet(path)
        if sets is not None:
            found = {r[0] for r in df.filter(F.col(set_col).isin(list(sets))).select(set_col).distinct().collect()}
            _require_sets(sets, found)
            df = df.filter(F.col(set_col).isin(list(sets)))
        return df
    names = list(sets) if sets is not None else spark.read.option("multiLine", True).json(path).columns
    schema = T.StructType([T.StructField(n, T.ArrayType(ESSAY_SCHEMA)) for n in names])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    # an absent set reads as null in every file; an empty one is an empty array
    present = raw.select(*[F.max(F.col(f"`{n}`").isNotNull()).alias(str(i)) for i, n in enumerate(names)]).first()
    _require_sets(names, {n for i, n in enumerate(names) if present[i]})
    both = F.array(*[F.struct(F.lit(n).alias(set_col), F.col(f"`{n}`").alias("essays")) for n in names])
    return (raw.select(F.inline(both)).select(set_col, F.posexplode("essays").alias("position", "e"))
               .select(set_col, "position", "e.*"))


def _require_sets(wanted, found) -> None:
    missing = [s for s in wanted if s not in found]
    if missing:
        raise KeyError(f"unknown set(s) {missing}")


def write_mixture(df: DataFrame, path: str, set_col: str = "set_name") -> None:
    """The Parquet layout of a mixture: one directory per set."""
    df.write.mode("overwrite").partitionBy(set_col).parquet(path)


def write_mixture_json(df: DataFrame, path: str, sets, set_col: str = "set_name", block_essays: int = 200) -> None:
    """The JSON object form with the named sets as fields, in many files of one object each: an object holds
    at most ``block_essays`` essays, ordered by document, so no set is gathered in one row. Blocks follow the
    order of set and document, and positions count inside an object. ``read_mixture`` reads the folder as one
    mixture; a set without essays is an empty array."""
    from ..operators.indexing import with_row_index
    names = list(sets)
    fields = [f.name for f in ESSAY_SCHEMA.fields]
    essay = F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast(ESSAY_SCHEMA[c].dataType).alias(c) for c in fields])
    rows = df.filter(F.col(set_col).isin(names)).select(F.col(set_col).alias("_set"), essay.alias("_essay"), F.col("document").alias("_document"))
    block = F.floor(F.col("_index") / block_essays)
    blocks = (with_row_index(rows, ["_set", "_document"], "_index").groupBy(block.alias("_block"))
              .agg(*[F.array_sort(F.collect_list(F.when(F.col("_set") == n, F.col("_essay")))).alias(n) for n in names]).select(*[F.col(f"`{n}`") for n in names]))
    # one object without essays: every requested set is there, also in an empty mixture
    empty = df.sparkSession.createDataFrame([tuple([] for _ in names)], blocks.schema)
    blocks.unionByName(empty).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Fold table (document, kfold); kfold 99 marks external documents."""
    return spark.read.schema(FOLD_SCHEMA).parquet(path)
