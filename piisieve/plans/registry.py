"""Query registry: name -> Spark callable (spark, sf_dir) and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def read(spark, sf_dir: str, table: str, *cols):
    """Pruned scan of one driver table; text tables are dealt out only if the session asks for it."""
    from ..sources.tables import MIN_TASKS, read_table
    tasks = spark.conf.get(MIN_TASKS, None) if table in TEXT_TABLES else None
    return read_table(spark, f"{sf_dir.rstrip('/')}/{table}.parquet", *cols, min_tasks=int(tasks) if tasks else None)
