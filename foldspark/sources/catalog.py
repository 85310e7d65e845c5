"""A local data catalog: raw and processed zones, versions, CSV export."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from foldspark.sources import files


@dataclass(frozen=True)
class Entry:
    """One version of a dataset."""

    name: str
    zone: str
    version: int
    path: str
    schema_hash: str
    rows: int
    source: str


class DataCatalog:
    """Parquet datasets below ``root/raw`` and ``root/processed``, and a JSON file for each version.

    Versions are never overwritten.  A version counts once its file is there; of two that
    are saved at once with one number the second fails, and no entry is lost.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root)

    def entries(self) -> list[Entry]:
        folder = files.join(self.root, "entries")
        return [Entry(**json.loads(files.read_text(self.spark, files.join(folder, n)))) for n in files.names(self.spark, folder) if n.endswith(".json")]

    def save(self, df: DataFrame, name: str, zone: str = "processed", source: str = "") -> Entry:
        if zone not in ("raw", "processed"):
            raise ValueError(f"no zone {zone}")
        version = 1 + max((e.version for e in self.entries() if (e.name, e.zone) == (name, zone)), default=0)
        path = files.join(self.root, zone, name, f"v{version:04d}")
        df.write.mode("errorifexists").parquet(path)
        rows = self.spark.read.parquet(path).count()
        entry = Entry(name, zone, version, path, hashlib.sha256(df.schema.json().encode()).hexdigest()[:16], rows, source)
        files.write_text(self.spark, files.join(self.root, "entries", f"{zone}-{name}-{version:04d}.json"), json.dumps(asdict(entry), indent=1), overwrite=False)
        return entry

    def find(self, name: str, zone: str = "processed", version: int | None = None) -> Entry:
        found = [e for e in self.entries() if (e.name, e.zone) == (name, zone) and version in (None, e.version)]
        if not found:
            raise KeyError(f"{zone}/{name} version {version or 'any'}")
        return max(found, key=lambda e: e.version)

    def load(self, name: str, zone: str = "processed", version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.find(name, zone, version).path)

    def export_csv(self, name: str, folder: str, zone: str = "processed", version: int | None = None) -> None:
        """CSV part files with a header, for use elsewhere; nothing reads them back."""
        self.load(name, zone, version).write.mode("errorifexists").option("header", True).csv(folder)
