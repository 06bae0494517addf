"""Evaluation straight from representation files of seed folders to written results."""

import numpy as np
import pytest

from strandlab.operators import margin
from strandlab.plans import evaluate


def write_file(folder, x, y):
    folder.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join([*map(str, range(x.shape[1])), "label"])]
    folder.write_text("\n".join([*lines, *(",".join([*map(repr, map(float, r)), str(int(l))]) for r, l in zip(x, y))]) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("representations")
    rng = np.random.default_rng(0)
    for seed in (1, 2, 7):
        for name, model in (("near", "ae"), ("far", "ae"), ("far", "ts")):
            centre = {"near": 0.5, "far": 9.0}[name] * rng.normal(size=(3, 4))
            for part, n in (("train", 30), ("valid", 18), ("test", 24)):
                y = np.arange(n) % 3
                write_file(root / f"run_{seed}" / "best" / part / f"{name}_{model}_mcl.csv", rng.normal(size=(n, 4)) + centre[y], y)
    holes = rng.normal(size=(6, 4))
    holes[2, 1] = np.nan
    write_file(root / "run_1" / "best" / "test" / "holes_ae_mcl.csv", holes, np.arange(6) % 2)
    write_file(root / "run_1" / "best" / "test" / "same_ae_mcl.csv", rng.normal(size=(6, 4)), np.zeros(6))
    write_file(root / "loose" / "test" / "far_ae_mcl.csv", rng.normal(size=(6, 4)), np.arange(6) % 2)
    return root


def test_clustering_of_files(spark, folder, tmp_path):
    scores, report = evaluate.cluster_files(spark, str(folder), str(tmp_path / "out"), [1, 2, 3], restarts=5, prefix="first")
    rows = {(r["dataset_name"], r["model_name"], r["encoder_name"], r["seed"]): r for r in scores.collect()}
    assert set(rows) == {(n, m, "mcl", s) for n, m in (("near", "ae"), ("far", "ae"), ("far", "ts")) for s in (1, 2)} | {("same", "ae", "mcl", 1)}
    assert all(r["ari"] > 0.95 and r["n_classes"] == 3 and r["n_features"] == 4 for k, r in rows.items() if k[0] == "far")
    assert {r["prefix"] for r in rows.values()} == {"first"}
    assert {(r["dataset_name"], r["seed"], r["reason"]) for r in report.collect()} == {("holes", 1, "missing values"), ("same", 1, "one cluster")}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["seed=1", "seed=2"]


def test_classification_of_files(spark, folder, tmp_path):
    rows = evaluate.representation_files(spark, str(folder), [2])
    assert {(r["part"], r["seed"]) for r in rows.select("part", "seed").distinct().collect()} == {(p, 2) for p in ("train", "valid", "test")}
    scores = evaluate.classify_files(spark, str(folder), str(tmp_path / "out"), [2, 7], features=margin.Linear()).collect()
    assert {(r["dataset_name"], r["model_name"], r["seed"]) for r in scores} == {(n, m, s) for n, m in (("near", "ae"), ("far", "ae"), ("far", "ts")) for s in (2, 7)}
    assert all(r["accuracy"] > 0.95 for r in scores if r["dataset_name"] == "far") and all(r["data_part"] == "test" for r in scores)


def test_no_wanted_seed(spark, folder, tmp_path):
    with pytest.raises(Exception):
        evaluate.cluster_files(spark, str(folder), str(tmp_path / "out"), [99], restarts=2)
