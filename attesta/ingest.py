"""Files to datasets."""

from __future__ import annotations

from pathlib import PurePosixPath as Path

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .session import ColumnInfo, Dataset, Session, new_id
from .sources.names import normalize
from .sources.tabular import IngestError, read_csv, read_excel, read_parquet

READERS = {".csv": ("csv", read_csv), ".parquet": ("parquet", read_parquet), ".xlsx": ("xlsx", read_excel)}


def ingest(session: Session, path: str, name: str | None = None) -> Dataset:
    """Reads a file once with safe names and fixed types into Parquet and registers it; rows are counted as they are written."""
    suffix = Path(path).suffix.lower()
    if not storage.exists(session.spark, str(path)):
        raise IngestError(f"file not found: {path}")
    if suffix not in READERS:
        raise IngestError(f"unsupported file type {suffix!r} (supported: {', '.join(READERS)})")
    kind, reader = READERS[suffix]
    rid = new_id("ds")
    try:
        df, header = reader(session.spark, str(path))
        names = normalize(header)
        df = df.toDF(*names)
        fields = [F.col(f"`{n}`").alias(n, metadata={"original_name": h}) for n, h in zip(names, header, strict=True)]
        seen = Observation()
        df.select(*fields).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(session.path("datasets", rid))
    except IngestError:
        raise
    except Exception as e:
        what = "could not read Excel" if kind == "xlsx" else "could not ingest"
        raise IngestError(f"{what} {path}: {str(e).splitlines()[0][:300]}") from e
    kinds = [f.dataType.simpleString() if not isinstance(f.dataType, T.NullType) else "void" for f in df.schema]
    columns = [ColumnInfo(i, h, n, t) for i, (h, n, t) in enumerate(zip(header, names, kinds, strict=True))]
    record = Dataset(rid, name or Path(path).stem, str(path), kind, seen.get["rows"], columns)
    session.register(record)
    session.table(rid).createOrReplaceTempView(rid)
    return record
