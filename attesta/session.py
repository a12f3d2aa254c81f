"""An investigation: a folder with datasets, artifacts and findings, and their registries.

Tables are Parquet under the folder and temporary views named by id; metadata is one small JSON file a record.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from . import storage

#: Settings that queries of analysts rely on.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
}


class UnknownDataset(KeyError):
    pass


class UnknownArtifact(KeyError):
    pass


class UnknownFinding(KeyError):
    pass


def now() -> str:
    return datetime.now(UTC).isoformat()


def new_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@dataclass
class ColumnInfo:
    position: int
    original_name: str
    name: str
    type: str


@dataclass
class Dataset:
    dataset_id: str
    name: str
    source_path: str
    source_format: str
    row_count: int
    columns: list[ColumnInfo]
    created_at: str = field(default_factory=now)

    def __post_init__(self):
        self.columns = [c if isinstance(c, ColumnInfo) else ColumnInfo(**c) for c in self.columns]
        names = [c.name for c in self.columns]
        if len(names) != len(set(names)):
            raise ValueError(f"column names repeat: {names}")

    def names_for(self, original: str) -> list[str]:
        return [c.name for c in self.columns if c.original_name == original]

    def original_for(self, name: str) -> str:
        for c in self.columns:
            if c.name == name:
                return c.original_name
        raise KeyError(name)


@dataclass
class Artifact:
    artifact_id: str
    kind: str
    source: str
    status: str
    row_count: int | None = None
    columns: list[str] = field(default_factory=list)
    column_types: list[str] = field(default_factory=list)
    data_path: str | None = None
    figure_paths: list[str] = field(default_factory=list)
    stdout: str | None = None
    error: str | None = None
    preview: str = ""
    created_at: str = field(default_factory=now)


@dataclass
class Claim:
    """A number pinned to the one cell of an artifact that a column and text filters choose."""

    description: str
    artifact_id: str
    column: str
    value: float
    where: dict[str, str] = field(default_factory=dict)
    rel_tol: float = 1e-9
    abs_tol: float = 1e-12


@dataclass
class Finding:
    finding_id: str
    headline: str
    detail: str = ""
    claims: list[Claim] = field(default_factory=list)
    status: str = "unverified"
    created_at: str = field(default_factory=now)

    def __post_init__(self):
        self.claims = [c if isinstance(c, Claim) else Claim(**c) for c in self.claims]


_KINDS = {"datasets": (Dataset, "dataset_id", UnknownDataset), "artifacts": (Artifact, "artifact_id", UnknownArtifact), "findings": (Finding, "finding_id", UnknownFinding)}


class Session:
    """One investigation in a folder of any store that Spark reads. Reopening it gives the same registries and views."""

    def __init__(self, spark: SparkSession, base, session_id: str | None = None):
        self.spark = spark
        for k, v in CONF.items():
            spark.conf.set(k, v)
        self.session_id = session_id or new_id("sess")
        self.base = str(base).rstrip("/")
        self.folder = f"{self.base}/{self.session_id}"
        self.records: dict[str, dict] = {}
        for kind, (make, key, _) in _KINDS.items():
            found = (make(**json.loads(storage.read_text(spark, p))) for p in storage.listed(spark, f"{self.folder}/{kind}", ".json"))
            self.records[kind] = {getattr(r, key): r for r in found}
        for d in self.datasets():
            self.table(d.dataset_id).createOrReplaceTempView(d.dataset_id)

    def register(self, record: Dataset | Artifact | Finding) -> None:
        """Adds or replaces a record."""
        kind, key = next((k, i) for k, (make, i, _) in _KINDS.items() if isinstance(record, make))
        rid = getattr(record, key)
        self.records[kind][rid] = record
        storage.write_text(self.spark, f"{self.folder}/{kind}/{rid}.json", json.dumps(asdict(record), indent=1))

    def _get(self, kind: str, rid: str):
        try:
            return self.records[kind][rid]
        except KeyError:
            known = ", ".join(sorted(self.records[kind])) or "none"
            raise _KINDS[kind][2](f"unknown {_KINDS[kind][1]} {rid!r} (known: {known})") from None

    def _list(self, kind: str) -> list:
        key = _KINDS[kind][1]
        return sorted(self.records[kind].values(), key=lambda r: (r.created_at, getattr(r, key)))

    def dataset(self, rid: str) -> Dataset:
        return self._get("datasets", rid)

    def artifact(self, rid: str) -> Artifact:
        return self._get("artifacts", rid)

    def finding(self, rid: str) -> Finding:
        return self._get("findings", rid)

    def datasets(self) -> list[Dataset]:
        return self._list("datasets")

    def artifacts(self) -> list[Artifact]:
        return self._list("artifacts")

    def findings(self) -> list[Finding]:
        return self._list("findings")

    def path(self, kind: str, rid: str) -> str:
        return f"{self.folder}/{kind}/{rid}"

    def table(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(self.path("datasets", dataset_id))

    def data(self, artifact: Artifact) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{artifact.data_path}")
