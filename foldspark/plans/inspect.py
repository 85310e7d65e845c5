"""Looking at a run: nodes, artifacts, lineage, predictions, inner validation, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.operators.lineage import cut
from foldspark.plans.artifacts import ArtifactType
from foldspark.plans.graph import WorkflowGraph
from foldspark.plans.store import code_hash
from foldspark.sources import files


def ancestors(edges: DataFrame) -> DataFrame:
    """(artifact_id, ancestor_id, depth) for every ancestor of every artifact in ``edges`` (artifact_id, upstream_id),
    by the shortest way up. Each round goes one step up from the pairs that the last one found for the first
    time, so work follows the number of pairs and not that of paths, and cycles end."""
    up = cut(edges.select("artifact_id", F.col("upstream_id").alias("_up")).filter("_up is not null").distinct())
    found = fresh = cut(up.select("artifact_id", F.col("_up").alias("ancestor_id"), F.lit(1).alias("depth")))
    while not fresh.isEmpty():
        step = fresh.join(up.withColumnRenamed("artifact_id", "_at"), F.col("ancestor_id") == F.col("_at"))
        step = step.select("artifact_id", F.col("_up").alias("ancestor_id"), (F.col("depth") + 1).alias("depth")).distinct()
        fresh = cut(step.join(found, ["artifact_id", "ancestor_id"], "left_anti"))
        found = found.unionByName(fresh)
    return found


class Run:
    """A finished run, read from its files alone."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.path = spark, files.join(root, run_id)
        text = lambda name: files.read_text(spark, files.join(self.path, name))
        self.manifest, self.config = json.loads(text("manifest.json")), json.loads(text("config/run_config.json"))
        self.graph = WorkflowGraph.from_json(text("config/workflow_graph.json"))
        self.index = spark.read.parquet(files.join(self.path, "artifact_index.parquet"))

    def list_nodes(self) -> list[tuple[str, str]]:
        return [(n.name, type(n).__name__) for n in self.graph.order()]

    def list_artifacts(self) -> DataFrame:
        return self.index.select("artifact_id", "artifact_type", "node_name", "scope.*", "path", F.size("upstream_ids").alias("n_upstream"))

    def _found(self, node_name: str, artifact_type: str | None = None, outer_fold_id: int | None = None, split_role: str | None = None) -> list:
        rows = self.index.filter(F.col("node_name") == node_name)
        if artifact_type:
            rows = rows.filter(F.col("artifact_type") == ArtifactType(artifact_type).value)
        if outer_fold_id is not None:
            rows = rows.filter((F.col("scope.outer_fold_id") == outer_fold_id) | F.col("scope.outer_fold_id").isNull())
        if split_role:
            rows = rows.filter((F.col("scope.split_role") == split_role) | (F.col("scope.split_role") == "full"))
        return rows.orderBy("artifact_type", "path").collect()

    def load_artifact(self, node_name: str, outer_fold_id: int | None = None, artifact_type: str | None = None, split_role: str | None = None) -> DataFrame:
        """One kind of artifact of a node, only the parts asked for."""
        found = self._found(node_name, artifact_type, outer_fold_id, split_role)
        kinds = {r["artifact_type"] for r in found}
        if len(kinds) != 1:
            raise LookupError(f"{node_name}: {'nothing found' if not kinds else f'say which of {sorted(kinds)}'}")
        base = found[0]["path"].split("/outer_fold_id=")[0]
        schema = T.StructType.fromJson(json.loads(found[0]["schema"]))
        return self.spark.read.schema(schema).option("basePath", base).parquet(*sorted({r["path"] for r in found}))

    def show_lineage(self, node_name: str, outer_fold_id: int | None = None) -> list[tuple[int, str, str, int | None]]:
        """(depth, node, artifact type, fold) of a node's artifacts and all they were made from."""
        rows = {r["artifact_id"]: r for r in self.index.select("artifact_id", "artifact_type", "node_name", "scope", "upstream_ids").collect()}
        depth = {r["artifact_id"]: 0 for r in self._found(node_name, outer_fold_id=outer_fold_id)}
        todo = list(depth)
        while todo:
            for up in rows[here := todo.pop(0)]["upstream_ids"]:
                if up not in depth:
                    depth[up] = depth[here] + 1
                    todo.append(up)
        return sorted((d, rows[a]["node_name"], rows[a]["artifact_type"], rows[a]["scope"]["outer_fold_id"]) for a, d in depth.items())

    def load_predictions(self, node_name: str, outer_fold_id: int | None = None, split_role: str | None = None) -> DataFrame:
        return self.load_artifact(node_name, outer_fold_id, ArtifactType.PREDICTIONS, split_role)

    def load_inner_validation(self, node_name: str, outer_fold_id: int | None = None) -> DataFrame:
        return self.load_artifact(node_name, outer_fold_id, ArtifactType.DIAGNOSTICS)

    def load_inner_predictions(self, node_name: str, outer_fold_id: int | None = None) -> DataFrame:
        return self.load_artifact(node_name, outer_fold_id, ArtifactType.INNER_PREDICTIONS)

    def load_training_snapshot(self, node_name: str, outer_fold_id: int | None = None) -> DataFrame:
        return self.load_artifact(node_name, outer_fold_id, ArtifactType.SNAPSHOT)

    def reconstructible(self) -> dict[str, bool]:
        """Whether graph, code and artifacts are what the manifest says."""
        paths = [r["path"] for r in self.index.select("path").collect()]
        return {
            "graph": self.graph.hash() == self.manifest["graph_hash"],
            "code": self.manifest["code_hash"] == code_hash(),
            "artifacts": len(paths) == self.manifest.get("artifacts") and all(files.exists(self.spark, p) for p in set(paths)),
        }

    def rebuild(self, runner) -> "Run":
        """Runs the graph in this run's folder again; ``runner`` has its vendors and registries."""
        return Run(self.spark, runner.root, runner.run(self.graph, self.config))


def load_run(spark: SparkSession, root: str, run_id: str) -> Run:
    return Run(spark, root, run_id)
