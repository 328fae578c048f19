"""Imports every catalog module so that their queries register."""

from __future__ import annotations

from . import catalog_core, catalog_extra, catalog_splits, catalog_windows  # noqa: F401
from .registry import ORACLE, QUERIES


def _widen(df):
    """Integral outputs as 64-bit and floats as doubles, the types the SQL twins produce."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _wrap(fn):
    def run(spark, sf_dir):
        from ..session import ship_package
        ship_package(spark)
        return _widen(fn(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict:
    return {k: _wrap(v) for k, v in QUERIES.items()}


def all_sql() -> dict:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
