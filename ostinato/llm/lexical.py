"""Ranked lexical search of many items in all documents: a join seeded with thresholds.

Documents become a forward index of the terms that items ask for. For each term are stored its document frequency, the
largest impact that it has in any document, and the k-th largest. What k documents reach with one term alone, the k-th
best score of an item can't be below: so each item starts with the greatest of these as its threshold. Its terms stand
from the rarest to the most frequent, and the sum of the bounds of all terms from a place on is the most that these can
add: terms whose sum stays below the threshold need not be looked up to find candidates. Documents with any other term
are candidates; they are scored exactly, term by term, and leave as soon as the rest can't lift them to the threshold,
which rises with the best k that a task has seen. Only the best k of each task and item are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.llm.rows import arrow_schema, bounded_batches, map_rows
from ostinato.llm.storage import new_folder, read_table

#: Runs of bytes of digits, a to z and all characters beyond ASCII, of a text whose A to Z are lower case.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Results of an item.
RESULTS = 20
#: Terms of items that a pass over the documents holds in each task; further items are sought in passes of their own.
TERMS_A_PASS = 1_000_000
NO_ID = np.iinfo(np.int64).max


@dataclass
class Item:
    """An item's terms from the rarest on, with weights; ``rest[i]`` is the most that the terms from i on can add."""

    item_id: object
    terms: np.ndarray
    weights: np.ndarray
    rest: np.ndarray
    threshold: int


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of each item with repeats. Rows of one item_id are one item; null texts have none."""

    def step():
        def split(batch: dict[str, list]) -> dict[str, list]:
            found = [(i, t, n) for i, text in zip(batch["item_id"], batch["text"], strict=True) for t, n in Counter(TERM.findall((text or b"").lower())).items()]
            return dict(zip(["item_id", "term", "n"], zip(*found, strict=True), strict=True)) if found else {"item_id": [], "term": [], "n": []}

        return split

    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    return map_rows(rows, step, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document: all its terms with repeats, and the numbers of those that items have."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def step():
        known = shared.value

        def index(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n": [], "terms": [], "counts": []}
            for text in batch["text"]:
                terms = TERM.findall((text or b"").lower())
                found = Counter(terms)
                held = found.keys() & known.keys() if len(found) > len(known) else [t for t in found if t in known]
                out["n"].append(len(terms))
                out["terms"].append([known[t] for t in held])
                out["counts"].append([found[t] for t in held])
            return out

        return index

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), step, "doc_id long, n long, terms array<int>, counts array<long>")


def term_bounds(index: DataFrame, documents: int, total: int, results: int = RESULTS) -> DataFrame:
    """(term, df, kth, most): each term's documents, its ``results``-th largest impact (0 if it has fewer) and its largest.

    Impacts are counted before they are ranked, so a term that every document has is a short list of values.
    """
    length = F.expr(f"75 + (25 * n * {documents}L) div {max(total, 1)}L")
    postings = index.select(length.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("m", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    counted = postings.withColumn("impact", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")).groupBy("term", "impact").agg(F.count("*").alias("docs"))
    from_top = Window.partitionBy("term").orderBy(F.col("impact").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counted.withColumn("reached", F.sum("docs").over(from_top))
    kth = F.max(F.when(F.col("reached") >= results, F.col("impact")))
    return reached.groupBy("term").agg(F.sum("docs").alias("df"), F.coalesce(kth, F.lit(0)).alias("kth"), F.max("impact").alias("most"))


def planned(item_id: object, terms: list[tuple[int, int]], bounds: dict[int, tuple[int, int, int]], documents: int) -> Item | None:
    """How an item is sought; nothing, if no document can score above 0."""
    found = []
    for term, n in terms:
        if term in bounds:
            df, kth, most = bounds[term]
            weight = n * math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
            if weight > 0:
                found.append((df, term, weight, weight * kth, weight * most))
    if not found:
        return None
    _, ids, weights, kths, mosts = zip(*sorted(found), strict=True)
    rest = np.concatenate((np.cumsum(np.asarray(mosts, np.int64)[::-1])[::-1], [0]))
    return Item(item_id, np.asarray(ids, np.int64), np.asarray(weights, np.int64), rest, max(1, max(kths)))


class Postings:
    """The postings of a batch of documents by term, with impacts."""

    def __init__(self, batch: pa.RecordBatch, documents: int, total: int):
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        n = at["n"].to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(at["terms"].offsets.to_numpy())
        terms, tf = at["terms"].flatten().to_numpy().astype(np.int64), at["counts"].flatten().to_numpy().astype(np.int64)
        docs = np.repeat(np.arange(len(n)), lengths)
        m = 75 + (25 * n * documents) // max(total, 1)
        order = np.argsort(terms, kind="stable")
        terms, tf, self.docs = terms[order], tf[order], docs[order]
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs])
        self.known, starts = np.unique(terms, return_index=True)
        self.starts = np.append(starts, len(terms))
        self.ids = at["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)

    def spans(self, terms: np.ndarray) -> list[tuple[int, int]]:
        """Where each term's postings begin and end; those of a term that no document has are empty."""
        at = np.searchsorted(self.known, terms)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == terms[there]
        at = np.where(there, at, 0)
        return [(int(self.starts[k]), int(self.starts[k + 1])) if t else (0, 0) for k, t in zip(at, there, strict=True)]


def candidates(item: Item, postings: Postings, threshold: int, scores: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a batch that score ``threshold`` or more, and their exact scores. Leaves both scratch arrays zero."""
    needed = int(np.searchsorted(-item.rest, -threshold, side="right"))  # the terms from here on can't reach the threshold
    spans = postings.spans(item.terms)
    for (a, b), weight in zip(spans[:needed], item.weights[:needed], strict=True):
        docs = postings.docs[a:b]
        scores[docs] += weight * postings.impacts[a:b]
        seen[docs] = True
    found = np.flatnonzero(seen)
    made = scores[found]
    scores[found], seen[found] = 0, False
    for k in range(needed, len(spans)):
        keep = made + item.rest[k] >= threshold
        found, made = found[keep], made[keep]
        a, b = spans[k]
        if a == b or not len(found):
            continue
        docs = postings.docs[a:b]
        at = np.searchsorted(docs, found)
        hit = at < len(docs)
        hit[hit] = docs[at[hit]] == found[hit]
        made[hit] += item.weights[k] * postings.impacts[a + at[hit]]
    keep = made >= threshold
    return found[keep], made[keep]


def best_of_tasks(index: DataFrame, items: list[Item], id_type: str, documents: int, total: int, results: int = RESULTS) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of each item, with exact scores."""
    shared = index.sparkSession.sparkContext.broadcast(items)
    schema = f"item_id {id_type}, doc_id long, score long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in sought]
        for batch in batches:
            postings = Postings(batch, documents, total)
            scores, seen = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for k, item in enumerate(sought):
                ids, had = best[k]
                threshold = max(item.threshold, int(had[-1])) if len(had) == results else item.threshold
                found, made = candidates(item, postings, threshold, scores, seen)
                if len(found):
                    ids, had = np.concatenate((ids, postings.ids[found])), np.concatenate((had, made))
                    order = np.lexsort((ids, -had))[:results]
                    best[k] = ids[order], had[order]
        for item, (ids, had) in zip(sought, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item.item_id] * len(ids), to.field(0).type), pa.array(ids), pa.array(had)], schema=to)

    return bounded_batches(index).mapInArrow(run, schema)


def search(items: DataFrame, docs: DataFrame, *, results: int = RESULTS, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """(item_id, rank, doc_id, score): the highest-scoring documents of each item, equal scores by doc_id, null ids last.

    Reads item_id and text of ``items``, doc_id and text of ``docs``. Rows of one item_id are one item with all their
    terms; null and empty texts have no terms, and an item without terms, or without a document that scores above 0,
    has no rows. Each row of ``docs`` is a document, so repeated rows rank one after the other. Empty tables give no
    rows. Whole texts count, of any length.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    wanted = item_terms(items)
    passes = max(1, math.ceil(wanted.count() / terms_a_pass))
    out = None
    for k in range(passes):
        asked: dict[object, list[tuple[bytes, int]]] = {}
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        for row in part.collect():  # bounded by terms_a_pass
            asked.setdefault(row["item_id"], []).append((bytes(row["term"]), row["n"]))
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in asked.values() for t, _ in terms}))}
        folder = new_folder(spark, "forward-index")
        forward_index(docs, vocabulary).write.parquet(folder)
        index = spark.read.schema("doc_id long, n long, terms array<int>, counts array<long>").parquet(folder)
        size = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        held = index.where(F.size("terms") > 0)
        bounds = {r["term"]: (r["df"], r["kth"], r["most"]) for r in term_bounds(held, size["documents"], size["total"], results).collect()}
        plans = [p for i in asked if (p := planned(i, [(vocabulary[t], n) for t, n in asked[i]], bounds, size["documents"]))]
        found = best_of_tasks(held, plans, id_type, size["documents"], size["total"], results)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id")))).where(F.col("rank") <= results)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sizes AS (
    SELECT d, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0
), corpus AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), postings AS (
    SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM words) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), asked AS (
    SELECT item_id, term, count(*) AS n FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scored AS (
    SELECT a.item_id, p.d, s.doc_id, sum(a.n * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * s.n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) JOIN sizes s USING (d), corpus GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
