"""Code hashes, small files, candidates and blends: what runs are audited by."""

import shutil

import pytest

from foldspark.operators import models, selection
from foldspark.plans.store import PACKAGE, code_hash
from foldspark.sources import files


def test_changed_code_is_told(tmp_path):
    copy = tmp_path / "foldspark"
    shutil.copytree(PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__"))
    assert code_hash(copy) == code_hash()
    (copy / "queries.py").write_text((copy / "queries.py").read_text() + "\n")
    assert code_hash(copy) != code_hash()


def test_text_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    files.write_text(spark, path, "fünf")
    assert files.read_text(spark, path) == "fünf" and files.names(spark, f"{tmp_path}/a") == ["b.json"] and files.names(spark, f"{tmp_path}/none") == []


def test_candidates_count_once_and_are_known():
    spec = models.HyperoptSpec(space={"alpha": [1.0, 1.0], "fit_intercept": [True, False]})
    assert spec.candidates() == [{"alpha": 1.0, "fit_intercept": True}, {"alpha": 1.0, "fit_intercept": False}]
    models.check_params(models.REGISTRY["ridge"], ["alpha"])
    with pytest.raises(ValueError, match="maxDepth"):
        models.check_params(models.REGISTRY["ridge"], ["maxDepth"])


def test_a_perfect_candidate_gets_all_weight(spark):
    rows = [(c, f, s, 100 * f + 50, 100 * f) for f in (0, 1) for c, s in (("a", 0.0), ("b", 1.0))]
    scores = spark.createDataFrame(rows, "candidate string, outer_fold_id int, score double, known_at int, test_start int")
    got = {r["candidate"]: r["weight"] for r in selection.blend_weights(scores).filter("outer_fold_id = 1").collect()}
    assert got == {"a": 1.0, "b": 0.0}
