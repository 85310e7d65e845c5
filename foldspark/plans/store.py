"""Writing a run: config, graph, artifacts, index, manifest.

One write for each node and kind, whatever the number of folds: a fold-scoped
artifact is partitioned by fold and role, and the index has a row for each part.
"""

from __future__ import annotations

import hashlib
import json
import platform
from datetime import datetime, timezone
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession

from foldspark.operators.leakage import LeakageError
from foldspark.plans.artifacts import INDEX_SCHEMA, ArtifactRef, ArtifactScope, ArtifactType, ScopedFrame, artifact_id
from foldspark.plans.graph import WorkflowGraph
from foldspark.sources import files

PACKAGE = Path(__file__).resolve().parents[1]


def code_hash(package: Path = PACKAGE) -> str:
    """Of the engine's source files, so that a run tells whether the code is still the same."""
    told = hashlib.sha256()
    for p in sorted(package.rglob("*.py")):
        if "llm" not in p.relative_to(package).parts:
            told.update(f"{p.relative_to(package)}\0".encode() + p.read_bytes())
    return told.hexdigest()[:16]


class RunWriter:
    def __init__(self, spark: SparkSession, root: str, graph: WorkflowGraph, config: dict, run_id: str | None = None):
        self.spark, self.graph, self.hash = spark, graph, graph.hash()
        self.run_id = run_id or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{self.hash[:8]}"
        self.path = files.join(root, self.run_id)
        if files.exists(spark, self.path):
            raise FileExistsError(self.path)
        self._text("config/run_config.json", json.dumps(config, indent=1, sort_keys=True, default=str))
        self._text("config/workflow_graph.json", graph.to_json())
        self.refs: list[ArtifactRef] = []
        self._manifest("running")

    def _text(self, name: str, text: str) -> None:
        files.write_text(self.spark, files.join(self.path, name), text)

    def _manifest(self, status: str, **more: object) -> None:
        told = {
            "run_id": self.run_id,
            "status": status,
            "graph_hash": self.hash,
            "code_hash": code_hash(),
            "pyspark": pyspark.__version__,
            "python": platform.python_version(),
            "nodes": [n.name for n in self.graph.nodes],
            "written": f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        } | more
        self._text("manifest.json", json.dumps(told, indent=1))

    def put(self, df: DataFrame, node: str, kind: ArtifactType, upstream: list[str], metadata: dict[str, str] | None = None) -> DataFrame:
        """Writes an artifact and gives it as read back, so that what follows starts from files.

        Tables of inner folds are partitioned by outer fold; the index has a row for each inner one.
        """
        frame = ScopedFrame(df, kind).check()
        scoped = [c for c in ("outer_fold_id", "split_role") if c in df.columns] if kind is not ArtifactType.FOLDS else []
        if "outer_fold_id" not in scoped:
            scoped = []
        inner = [c for c in ("inner_fold_id",) if kind in (ArtifactType.INNER_PREDICTIONS, ArtifactType.INNER_STATE)]
        path = files.join(self.path, "nodes" if scoped else "global", f"node_{node}", kind.value)
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*scoped) if scoped else writer).parquet(path)
        # Partition columns come back as they were, not as Spark would guess them.
        back = self.spark.read.schema(df.schema).parquet(path)
        if kind in (ArtifactType.PREDICTIONS, ArtifactType.INNER_PREDICTIONS):
            twice = back.groupBy(*frame.keys, *(["split_role"] if "split_role" in back.columns else [])).count().filter("count > 1")
            if not twice.isEmpty():
                raise LeakageError(f"{node} predicts a row more than once: {twice.first()}")
        scopes = [(ArtifactScope(), path)]
        if scoped:
            parts = sorted(tuple(r) for r in back.select(*scoped, *inner).distinct().collect())
            where = lambda p: "/".join([path, *(f"{c}={v}" for c, v in zip(scoped, p))])
            if inner:
                scopes = [(ArtifactScope("inner_fold", "validation", p[0], p[-1]), where(p)) for p in parts]
            else:
                scopes = [(ArtifactScope("outer_fold", p[1] if len(p) > 1 else "full", p[0]), where(p)) for p in parts]
        for scope, at in scopes:
            self.refs.append(ArtifactRef(artifact_id(self.hash, node, kind.value, scope), kind.value, node, at, scope, df.schema.json(), metadata or {}, tuple(upstream)))
        return back

    def finish(self, metrics: dict | None = None) -> None:
        rows = [(r.artifact_id, r.artifact_type, r.node_name, r.path, tuple(r.scope.__dict__.values()), r.schema, r.metadata, list(r.upstream_ids)) for r in self.refs]
        self.spark.createDataFrame(rows, INDEX_SCHEMA).coalesce(1).write.parquet(files.join(self.path, "artifact_index.parquet"))
        self._manifest("finished", artifacts=len(rows), metrics=metrics or {})

    def fail(self, node: str, error: Exception) -> None:
        self._manifest("failed", failed_node=node, error=str(error)[:2000])
