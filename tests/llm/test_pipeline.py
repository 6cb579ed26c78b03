"""The corpus pipeline: each stage on what its predecessor kept, held against plain versions of the stages."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ostinato.llm import langid, mixing, ngram_join, secrets
from ostinato.llm.registry import ORACLE_SQL, QUERIES
from ostinato.llm.storage import DOCUMENT_COLUMNS


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """The documents, then what each stage returned."""
    folder = tmp_path_factory.mktemp("stages")
    made = [spark.read.parquet(f"{data}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], data).write.parquet(f"{folder}/{k}")
        made.append(spark.read.parquet(f"{folder}/{k}"))
    return made


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "secret_scan", "source_mix", "piece_encoding"]
    assert all(df.columns == DOCUMENT_COLUMNS for df in stages[1:-1])
    assert all(f.dataType == g.dataType for df in stages[1:-1] for f, g in zip(df.schema, stages[0].schema, strict=True))


def test_language_id_drops_only_what_it_cannot_tell(stages):
    docs, kept = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[:2])
    classify = langid.classifier(langid.learn(stages[0].where(~langid.held_out(F.col("doc_id")))))
    assert kept.items() <= docs.items()
    for i, text in docs.items():
        lang, score = classify(text)
        assert (i in kept) == (lang != langid.UNDETERMINED and score >= 0.05)
    assert len(kept) > 0.9 * len(docs)


def test_one_of_each_group_of_near_duplicates_stays(stages):
    verdict = {r["doc_id"]: r["kept"] for r in ngram_join.near_duplicates(stages[1]).collect()}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(i for i, k in verdict.items() if k)
    assert ngram_join.near_duplicates(stages[2]).where("n_links > 0").count() == 0


def test_secrets_go_and_documents_stay(stages):
    before, after = ({r["doc_id"]: (r["text"], r["n_chars"]) for r in df.collect()} for df in stages[2:4])
    assert before.keys() == after.keys()
    scan = secrets.Novelty()
    for i, (text, n) in before.items():
        spans = scan.all_spans(text or "")[1]
        assert (after[i] == (text, n)) if not spans else ("[SECRET]" in after[i][0] and len(after[i][0]) == after[i][1])
    assert not any(secrets.base_spans(t or "") for t, _ in after.values())


def test_the_mix_is_that_of_its_plan(stages):
    sized = mixing.with_sizes(stages[3]).cache()
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(sized).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want


def test_every_document_is_encoded(spark, data, stages):
    assert Counter(r["doc_id"] for r in stages[5].collect()) == Counter(r["doc_id"] for r in stages[4].collect())
    assert stages[5].where("not round_trip").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, data).select("doc_id", "ids").collect())) == sorted(map(str, stages[5].select("doc_id", "ids").collect()))


def test_odd_documents_pass_through_all_stages(spark, data):
    rows = [(1, None, None, None, None), (None, "the text of no one in particular", "en", "a", 32), (3, "", "en", "a", 0), (4, "x" * 30_000, "fr", None, 30_000), (4, "the same and the other", "en", "b", 22), (4, "the same and the other", "en", "b", 22)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        df = docs.withColumn("copies", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("tie", F.lit(0))
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, data).cache()
        assert (df.count() > 0) == (docs.count() > 0)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert ORACLE_SQL.keys() <= QUERIES.keys()
