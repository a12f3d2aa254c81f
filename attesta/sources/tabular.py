"""CSV, Parquet and Excel files as DataFrames with inferred, fixed types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted


class IngestError(ValueError):
    """A file that can't become a dataset."""


DELIMITERS = ",;\t|"
_INTEGER = r"^\s*[+-]?\d{1,19}\s*$"
_DOUBLE = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\s*$"
_DATE = r"^\s*\d{1,4}-\d{1,2}-\d{1,2}\s*$"
_TIME = r"^\s*\d{1,4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"
_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?)\s*$"


def as_utc(c: Column) -> Column:
    """Text of an instant as a zone-free timestamp in UTC; zone offsets of two digits are allowed."""
    full = F.regexp_replace(c, r"([+-]\d{2})\s*$", "$1:00")
    return F.to_utc_timestamp(full.try_cast("timestamp_ltz"), F.current_timezone()).cast("timestamp_ntz")


def ladder(c: Column) -> list[tuple[T.DataType, Column]]:
    """Candidate types from narrow to wide with the value in that type, null where the text isn't of it."""
    plain = F.trim(c)
    return [
        (T.BooleanType(), F.when(F.lower(plain).isin("true", "false"), F.lower(plain) == "true")),
        (T.LongType(), F.when(c.rlike(_INTEGER), plain.try_cast("bigint"))),
        (T.DoubleType(), F.when(c.rlike(_DOUBLE), plain.try_cast("double"))),
        (T.DateType(), F.when(c.rlike(_DATE), plain.try_cast("date"))),
        (T.TimestampNTZType(), F.when(c.rlike(_TIME), F.when(c.rlike(_TIME + ".*" + _ZONE), as_utc(plain)).otherwise(plain.try_cast("timestamp_ntz")))),
    ]


def with_inferred_types(df: DataFrame) -> DataFrame:
    """A DataFrame of texts with each column in the first type that takes all its values, by one pass over all rows."""
    names = df.columns
    counts = []
    for i, name in enumerate(names):
        c = F.col(name)
        counts.append(F.count(c).alias(f"n_{i}"))
        counts += [F.count(v).alias(f"t_{i}_{k}") for k, (_, v) in enumerate(ladder(c))]
    found = df.agg(*counts).first()
    out = []
    for i, name in enumerate(names):
        n = found[f"n_{i}"]
        c = F.col(name)
        fits = next((v for k, (_, v) in enumerate(ladder(c)) if n and found[f"t_{i}_{k}"] == n), c)
        out.append(fits.alias(name))
    return df.select(*out)


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as long, instants as zone-free UTC timestamps."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    out = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.to_utc_timestamp(c, zone).cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, as where a quoted cell goes on in the next one.

    Only then must a file be read in one piece; else Spark may split it.
    """
    return not spark.read.text(path).where(F.length("value") % 2 != F.length(F.replace("value", F.lit('"'))) % 2).isEmpty()


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(typed rows with columns c0, c1, ..., header) of a CSV file with a header row."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        raise IngestError(f"{path}: a header row is required")
    sep = max(DELIMITERS, key=lambda d: (first[0][0].count(d), -DELIMITERS.index(d)))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": str(has_open_quotes(spark, path)).lower()}
    head = spark.read.csv(path, header=False, inferSchema=False, **options).limit(1).collect()[0]
    header = ["" if x is None else x for x in head]
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(header))]
    # one more column than the header has shows a row that is too long, which Spark would cut
    schema = T.StructType([*fields, T.StructField("_more", T.StringType())])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE", **options)
    if not rows.where("_more is not null").isEmpty():
        raise IngestError(f"{path}: rows are longer than the header; a reader that trusts them skips the first row(s)")
    return with_inferred_types(rows.drop("_more")), header


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    df = spark.read.parquet(path)
    return plain_types(df), df.columns


def read_excel(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(typed rows, header) of the first sheet; types are inferred as for CSV."""
    from .xlsx import read_sheet

    rows, header = read_sheet(spark, path)
    if rows is None:
        raise IngestError(f"{path}: no header row")
    df = with_inferred_types(rows)
    dated = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    if dated:
        whole = df.agg(*(F.count_if(F.date_trunc("day", F.col(c)) != F.col(c)).alias(c) for c in dated)).first()
        df = df.withColumns({c: F.col(c).cast("date") for c in dated if whole[c] == 0})
    return df, header
