"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables; plans and the entry points."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__
from ostinato.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        import os

        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_a_query_is_its_sql(spark, con, data, name):
    df = catalogue.QUERIES[name](spark, data)
    got = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=repr)
    made = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert made == want


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["q_onset_running_sum", "q_delta_time", "q_note_pairing", "q_bar_emission", "q_rolling_mean5", "q_voice_leading", "q_clean_chords"])
def test_a_chain_of_windows_over_one_key_shuffles_once(spark, data, name):
    assert exchanges(catalogue.QUERIES[name](spark, data)) == 1


def test_scans_read_only_what_they_need(spark, data):
    plan = catalogue.QUERIES["q_delta_time"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "event_type" not in plan


def test_entry_points(spark):
    assert catalogue.QUERIES.items() <= __spark_entry__.queries().items()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).columns == ["kind", "n", "span_sum", "last_span"]
    assert __spark_entry__.entry(spark).count() > 0


def test_runs_that_a_benchmark_lacks_are_not_shuffled(spark, data):
    from ostinato.operators import joins

    small = catalogue.QUERIES["q_ngram_overlap"](spark, data)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan[plan.index("BroadcastHashJoin") :]
    most, joins.MOST_BROADCAST_BYTES = joins.MOST_BROADCAST_BYTES, 16
    try:
        large = catalogue.QUERIES["q_ngram_overlap"](spark, data)
        assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    finally:
        joins.MOST_BROADCAST_BYTES = most


@pytest.mark.parametrize(("name", "windows"), [("q_readable_chords", 0), ("q_decode_stream", 1), ("q_element_counter", 0), ("q_token_vectors", 0)])
def test_tokens_of_a_song_are_one_array_and_no_sorted_rows(spark, data, name, windows):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == windows


def test_recurrences_get_arrays_without_windows_that_they_do_not_need(spark, data):
    plan = lambda name: catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan("q_voice_leading"))) == 0
    assert len(re.findall(r"\bWindow \[", plan("q_clean_chords"))) == 1
    assert "Generate" not in plan("q_encoded_songs")
