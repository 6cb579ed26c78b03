"""Mixing: targets against water filling by hand, copies against their bounds, odd rows and tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ostinato.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def filled(sizes: dict, cap: float = 3.0) -> dict:
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def taken(spark, docs):
    sized = mixing.with_sizes(docs).cache()
    return mixing.copies(sized).select("doc_id", "source", "size", "source_size", "target", "copies").collect()


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 300, None: 40}, {"a": 5, "b": 5, "c": 5}, {"x": 1, "y": 100000}])
def test_targets_reshare_what_capped_sources_leave(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.weighted_targets(rows, 3.0).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_words_come_near_targets_and_no_document_exceeds_its_cap(spark):
    rows = [(i, "w " * (1 + i * 7919 % 90), ["a", "b", "c", None][i * i % 4]) for i in range(1200)]
    made = taken(spark, table(spark, rows))
    assert len(made) == len(rows)
    got, target, largest = Counter(), {}, defaultdict(int)
    for r in made:
        assert 0 <= r["copies"] <= 3
        assert r["size"] == words(rows[r["doc_id"]][1])
        got[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert target == pytest.approx(filled({s: sum(words(t) for _, t, x in rows if x == s) for s in target}))
    for s, t in target.items():
        assert abs(got[s] - t) <= 3 * largest[s]


def test_reruns_and_other_partitions_agree(spark):
    rows = [(i, "one two " * (i % 7), f"s{i % 3}") for i in range(200)]
    docs = table(spark, rows)
    a = sorted(map(tuple, taken(spark, docs)))
    b = sorted(map(tuple, taken(spark, docs.repartition(7).orderBy(F.rand(3)))))
    assert a == b


def test_nulls_empty_texts_repeats_and_an_empty_table(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (None, "x y", None), (4, "x y z", "b"), (4, "x y z", "b"), (5, "é b c", "b")]
    made = taken(spark, table(spark, rows))
    assert len(made) == len(rows)
    assert {r["doc_id"]: r["size"] for r in made} == {1: 0, 2: 0, 3: 0, None: 2, 4: 3, 5: 2}
    assert all(r["copies"] == 0 for r in made if r["source"] == "a")
    assert taken(spark, table(spark, [])) == []


def test_the_mixed_corpus_repeats_whole_documents(spark):
    rows = [(i, f"text {i} " * (i % 5 + 1), f"s{i % 4}") for i in range(120)] + [(7, "text 7 " * 3, "s3")]
    docs = table(spark, rows).withColumn("size", F.lit("clashes")).withColumn("copies", F.lit(9)).withColumn("k", F.lit(0))
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    have = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    plan = Counter()
    for r in taken(spark, docs):
        plan[(r["doc_id"], next(t for i, t, _ in rows if i == r["doc_id"]))] += r["copies"]
    assert have == +plan


def test_the_query_is_native(spark, data):
    """No Python in the plans of the main path."""
    sized = mixing.with_sizes(spark.read.parquet(f"{data}/documents.parquet"))
    plan = mixing.copies(sized)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
