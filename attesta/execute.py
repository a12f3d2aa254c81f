"""run_sql: every run becomes an artifact with its whole result on disk and a bounded preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import storage
from .functions.textsafe import cell_text, cut_bytes, md_cell, sanitize
from .session import Artifact, Session, new_id
from .sources.names import unique_output
from .sqlgate import UnsafeSql, check_analyzed, check_sql

PREVIEW_ROWS = 50
PREVIEW_BYTES = 4096


def first_rows(spark: SparkSession, path: str, schema: StructType, n: int = PREVIEW_ROWS) -> list:
    """The first rows of a stored result in the order in which they were written: by file, then by place in it.

    Files are opened one after another until there are n rows, and of each no more is read than these take.
    """
    files = sorted(storage.listed(spark, path, ".parquet"), key=lambda f: (len(f), f))
    out: list = []
    for f in files:
        if len(out) >= n:
            break
        out += spark.read.schema(schema).parquet(f).limit(n - len(out)).collect()
    return out


def preview(spark: SparkSession, path: str, schema: StructType, rows: int) -> str:
    """Markdown of the first rows of a stored result."""
    if not rows:
        return "_0 rows_"
    shown = first_rows(spark, path, schema)
    cells = lambda xs: "| " + " | ".join(md_cell(sanitize(x)) for x in xs) + " |"
    lines = [cells(schema.names), "|" + "---|" * len(schema), *(cells(map(cell_text, r)) for r in shown)]
    if rows > len(shown):
        lines.append(f"_showing {len(shown)} of {rows} rows_")
    return cut_bytes("\n".join(lines), PREVIEW_BYTES)


def store(session: Session, df: DataFrame, kind: str, source: str, **more) -> Artifact:
    """Writes a result in one pass that also counts it, and registers its artifact; the preview is read from what is stored."""
    rid = new_id("art")
    path = session.path("artifacts", f"{rid}.parquet")
    df = df.toDF(*unique_output(df.columns))
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        rows = seen.get["rows"]
        text = preview(session.spark, path, df.schema, rows)
    except Exception:
        storage.delete(session.spark, path)
        raise
    kinds = [f.dataType.simpleString() for f in df.schema]
    record = Artifact(rid, kind, source, "ok", rows, df.columns, kinds, f"artifacts/{rid}.parquet", preview=text, **more)
    session.register(record)
    return record


def failed(session: Session, kind: str, source: str, error: str, **more) -> Artifact:
    record = Artifact(new_id("art"), kind, source, "error", error=cut_bytes(sanitize(error, PREVIEW_BYTES), PREVIEW_BYTES), **more)
    session.register(record)
    return record


def run_sql(session: Session, sql: str) -> Artifact:
    """Runs one read-only query. Refused statements raise and leave nothing; failures are artifacts too."""
    sql = check_sql(session.spark, sql)
    try:
        return store(session, check_analyzed(session.spark.sql(sql)), "sql", sql)
    except UnsafeSql:
        raise
    except Exception as e:
        return failed(session, "sql", sql, str(e).partition("JVM stacktrace")[0])
