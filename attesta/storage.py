"""Small files of a session on whatever store Spark reads: a local disk, HDFS or an object store."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one machine may have one of its
    own; on a cluster that is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def scratch(spark: SparkSession) -> str:
    """Where this library keeps intermediate tables and sessions of its own."""
    return f"{shared_folder(spark)}/attesta"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attesta_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() which nothing will read again."""
    for df in tables:
        path = getattr(df, "_attesta_path", None)
        if path:
            delete(df.sparkSession, path.rpartition("/")[0])


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of the files in a folder that end so, in order; none if there is no folder."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(x for x in (str(s.getPath().toString()) for s in fs.listStatus(p)) if x.endswith(suffix))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file anew; folders are made on the way."""
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(data)
    finally:
        stream.close()
