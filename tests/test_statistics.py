"""Nearest references, moments of vectors and exact quantiles against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import moments, spatial


@pytest.mark.parametrize(("n", "axes", "grid"), [(1, 3, 5), (40, 2, 3), (3000, 3, 9), (5000, 1, 400), (2000, 4, 2)])
def test_cells_find_what_all_pairs_give(n, axes, grid):
    random = np.random.default_rng(n)
    points, rows = random.integers(0, grid, (n, axes)) / 2, random.integers(-3, grid + 3, (700, axes)) / 4
    at, squares = spatial.Cells(points).nearest(rows)
    every = np.zeros((len(rows), n))
    for k in range(axes):
        every += (rows[:, k, None] - points[:, k]) ** 2
    assert (at == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()


def test_a_million_references():
    random = np.random.default_rng(1)
    points, rows = random.random((1_000_000, 3)), random.random((60, 3))
    at, _ = spatial.Cells(points).nearest(rows)
    assert at.tolist() == [int(((points - r) ** 2).sum(axis=1).argmin()) for r in rows]


@pytest.mark.parametrize("a_pass", [1 << 20, 7])
def test_nearest_references_of_rows(spark, monkeypatch, a_pass):
    monkeypatch.setattr(spatial, "REFERENCES_A_PASS", a_pass)
    pick = random.Random(2)
    refs = [(k, f"r{k}", float(pick.randrange(6)), float(pick.randrange(6))) for k in range(50)] + [(99, "no", None, 1.0), (98, "nan", float("nan"), 1.0)]
    rows = [(k, pick.randrange(9) / 2, pick.randrange(9) / 2) for k in range(60)] + [(100, None, 1.0), (101, float("inf"), 1.0)]
    made = spatial.nearest_reference(spark.createDataFrame(rows, "id long, x double, y double"), spark.createDataFrame(refs, "id int, name string, x double, y double"), ["x", "y"], "id", "name")
    assert made.columns == ["id", "x", "y", "nearest", "distance"]
    for r in made.collect():
        want = min((((r["x"] - x) ** 2 + (r["y"] - y) ** 2) ** 0.5, k) for k, _, x, y in refs[:50]) if r["id"] < 100 else None
        assert (r["distance"], r["nearest"]) == ((want[0], f"r{want[1]}") if want else (None, None))


def test_no_references_and_arrays(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [2.0, None])], "id int, v array<double>")
    none = spatial.nearest_reference(rows, rows.where("false").withColumn("name", F.lit("x")), "v", "id", "name")
    assert [(r["nearest"], r["distance"]) for r in none.collect()] == [(None, None)] * 4
    own = spatial.nearest_reference(rows, spark.createDataFrame([(7, "seven", [0.0, 0.0])], "id int, name string, v array<double>"), "v", "id", "name")
    assert {r["id"]: r["nearest"] for r in own.collect()} == {1: "seven", 2: None, 3: None, 4: None}


def test_moments_of_vectors(spark):
    rows = [[1e9 + k, None, float(k % 3)] for k in range(50)] + [None, [], [1e9], [1e9, 4.0]]
    made = {r["dim"]: r for r in moments.array_moments(spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(5), "v").collect()}
    for dim in range(3):
        own = [v[dim] for v in rows if v is not None and len(v) > dim and v[dim] is not None]
        assert made[dim]["n"] == len(own) and np.isclose(made[dim]["mean"], np.mean(own), rtol=1e-15) and np.isclose(made[dim]["std"], np.std(own), rtol=1e-9)
    assert moments.array_moments(spark.createDataFrame([], "v array<double>"), "v").count() == 0


SHARES = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p93": 0.93, "p100": 1.0}


@pytest.mark.parametrize("bins", [64, 4096])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(moments, "BINS", bins)
    pick = random.Random(3)
    kinds = {"a": lambda: pick.random(), "b": lambda: float(pick.randrange(4)), "c": lambda: 10 ** pick.uniform(-30, 30), "one": lambda: 5.0, None: lambda: -(10 ** pick.uniform(-9, 9))}
    rows = [(g, make()) for g, make in kinds.items() for _ in range(200 if g != "one" else 1)] + [("a", None), ("b", float("nan")), ("gone", None)]
    made = moments.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), SHARES).collect()
    assert {r["g"] for r in made} == set(kinds)
    for r in made:
        own = [v for g, v in rows if g == r["g"] and v is not None and v == v]
        assert np.allclose([r[name] for name in SHARES], np.quantile(own, list(SHARES.values())), rtol=1e-12, atol=0)


def test_quantiles_of_everything_and_of_nothing(spark):
    rows = spark.range(1001).select(F.col("id").alias("v"))
    assert moments.exact_quantiles(rows, [], F.col("v"), {"median": 0.5, "p1": 0.01}).collect()[0].asDict() == {"median": 500.0, "p1": 10.0}
    assert moments.exact_quantiles(rows.where("false"), [], F.col("v"), {"median": 0.5}).count() == 0
