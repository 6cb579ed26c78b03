"""Ordinals, running values and groups of onsets over many parts, against plain loops."""

from __future__ import annotations

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import anchors, ranges


@pytest.mark.parametrize("n", [0, 1, 2, 777])
def test_ordinals_are_places_in_the_whole_order(spark, n):
    pick = random.Random(n)
    values = [(pick.randrange(50), k) for k in range(n)]
    df = spark.createDataFrame(values, "a int, b long") if n else spark.createDataFrame([], "a int, b long")
    made, total = ranges.numbered(df, [F.col("a").desc(), "b"], "place", parts=7)
    assert total == n and made.columns == ["a", "b", "place"]
    want = sorted(values, key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"]) for r in sorted(made.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in made.collect()) == list(range(n))


def test_no_task_gets_all_rows_to_number_them(spark):
    made, _ = ranges.numbered(spark.range(1000), ["id"], "place")
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()


def plain_running(rows):
    out = {}
    for key, own in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        total = count = most = least = last = None
        for k, (_, at, v) in enumerate(own, 1):
            if v is not None:
                total, most, least, last = (total or 0) + v, v if most is None else max(most, v), v if least is None else min(least, v), v
                count = (count or 0) + 1
            out[key, at] = (total, count or 0, most, least, last, k)
    return out


@pytest.mark.parametrize(("parts", "seed"), [(1, 1), (3, 2), (40, 3), (200, 4)])
def test_values_run_on_over_parts(spark, parts, seed):
    pick = random.Random(seed)
    keys = ["hot"] * 6 + ["b", "c", None] + [f"k{i}" for i in range(8)]
    rows = [(pick.choice(keys), k, pick.choice([None, *range(-9, 9)])) for k in range(400)]
    values = {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "latest": ("last", F.col("v")), "row": ("count", F.lit(1))}
    made = ranges.running(spark.createDataFrame(rows, "key string, at int, v long"), ["key"], ["at"], values, parts)
    assert made.columns == ["key", "at", "v", *values]
    assert {(r["key"], r["at"]): tuple(r)[3:] for r in made.collect()} == plain_running(rows)


def test_values_run_without_a_key_and_over_no_rows(spark):
    rows = [(k, k % 5) for k in range(100)]
    made = ranges.running(spark.createDataFrame(rows, "at int, v int"), [], ["at"], {"total": ("sum", F.col("v"))}, 9)
    assert [r["total"] for r in sorted(made.collect())] == np.cumsum([v for _, v in rows]).tolist()
    assert ranges.running(spark.createDataFrame([], "k int, at int"), ["k"], ["at"], {"n": ("count", F.lit(1))}).count() == 0


def test_a_hot_sequence_is_split(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    laid = ranges.laid_out(rows, ["key", "id"], 16).where("key = 'hot'").groupBy("_part").count().collect()
    assert len(laid) >= 10 and max(r["count"] for r in laid) < 600


def plain_groups(onsets, tolerance):
    out, anchor = [], None
    for t in sorted(onsets):
        if anchor is None or t - anchor > tolerance:
            anchor = t
        out.append((t, anchor))
    return out


@pytest.mark.parametrize(("parts", "seed", "tolerance"), [(1, 1, 5), (4, 2, 5), (30, 3, 40), (60, 4, 400), (25, 5, 0), (20, 6, 10_000)])
def test_groups_of_onsets_go_on_over_parts(spark, parts, seed, tolerance):
    pick = random.Random(seed)
    rows = [(pick.choice(["hot", "hot", "hot", "b", None]), pick.randrange(900), k) for k in range(500)] + [("alone", 3, 999), ("b", None, 1000)]
    df = spark.createDataFrame(rows, "song string, t int, note int")
    made = anchors.anchor_groups(df, ["song"], "t", F.lit(tolerance), ["note"], parts)
    assert made.columns == ["song", "anchor", "onset", "note"]
    want = [(song, t, a) for song in {r[0] for r in rows} for t, a in plain_groups([r[1] for r in rows if r[0] == song and r[1] is not None], tolerance)] + [("b", None, None)]
    assert sorted(((r["song"], r["onset"], r["anchor"]) for r in made.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(r["note"] for r in made.collect()) == sorted(r[2] for r in rows)


def test_a_long_run_without_a_gap(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("x").alias("song"), (F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("t"))
    made = anchors.anchor_groups(df, ["song"], "t", F.lit(25), [], 12).groupBy("anchor").agg(F.count("*").alias("n"), F.max("onset").alias("last")).toPandas().sort_values("anchor")
    assert made["n"].sum() == n and (made["last"] - made["anchor"]).max() <= 25
    begins = df.select("t").toPandas()["t"].sort_values().to_numpy()
    at, want = 0, []
    while at < n:
        want.append(begins[at])
        at = int(np.searchsorted(begins, begins[at] + 25, side="right"))
    assert made["anchor"].tolist() == want


def test_rounding_does_not_move_a_group(spark):
    rows = [("a", 0.1 * k) for k in range(300)]
    made = anchors.anchor_groups(spark.createDataFrame(rows, "song string, t double"), ["song"], "t", F.lit(0.3), [], 6)
    assert sorted((r["onset"], r["anchor"]) for r in made.collect()) == plain_groups([t for _, t in rows], 0.3)


def test_no_onsets(spark):
    assert anchors.anchor_groups(spark.createDataFrame([], "song string, t int"), ["song"], "t", F.lit(3)).count() == 0
