"""Language identification by rank-order profiles.

A profile is the list of a language's (or a document's) most frequent n-grams of one to three letters, most frequent
first. A document goes to the language whose profile has the least out-of-place distance: for each of the document's
n-grams, how far its rank is from its rank in the language's profile, and the profile's length where it isn't there.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.llm.rows import map_rows
from ostinato.llm.storage import DOCUMENT_COLUMNS, read_table

UNDETERMINED = "und"
PROFILE_SIZE = 300
SPACE = 32


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one to three letters as integers of 21 bits a letter, ascending, and their counts.

    Letters are lower-cased; a run of anything else is one boundary, also at both ends. N-grams have a boundary at
    their ends only.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[~letters()[points]] = SPACE
    points = np.concatenate(([SPACE], points, [SPACE]))
    blank = points == SPACE
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = points[:-1] << 21 | points[1:]
    triples = (pairs[:-1] << 21 | points[2:])[points[1:-1] != SPACE]
    return np.unique(np.concatenate((points[points != SPACE], pairs, triples)), return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The n-grams by falling count, equal counts by code; ``grams`` ascend."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """A profile of each value of ``lang``, from all rows with a text and a lang; counts are over whole texts.

    Each task sums its batches, Spark sums over tasks. To rank the n-grams of one language without a task that has all
    of them, parts are ranked first, as many as the session has shuffle partitions. What reaches the driver is ``size``
    integers for each language.
    """

    def step():
        def count(batch: dict[str, list]) -> dict[str, list]:
            found: dict[str, list] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found.setdefault(lang, []).append(ngram_counts(text))
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            for lang, several in found.items():
                grams, where = np.unique(np.concatenate([g for g, _ in several]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([n for _, n in several]), len(grams)).astype(np.int64)
                out["lang"] += [lang] * len(grams)
                out["gram"] += grams.tolist()
                out["n"] += sums.tolist()
            return out

        return count

    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    counts = map_rows(rows, step, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order, parts = [F.col("n").desc(), F.col("gram")], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(parts))).orderBy(*order)
    best = counts.withColumn("place", F.row_number().over(part)).where(F.col("place") <= size).drop("place")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for row in sorted(ranked.select("lang", "gram", "place").collect(), key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def classifier(profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
    """A function from a text to its language and a score from 0 to 1; languages at equal distance go by code point."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.asarray(profiles[x], np.int64) for x in langs])) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def classify(text: str | None) -> tuple[str, float]:
        if not text or not langs:
            return UNDETERMINED, 0.0
        own = most_frequent(*ngram_counts(text), size)
        if not len(own):
            return UNDETERMINED, 0.0
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        theirs = ranks[:, at]
        distance = np.where(theirs < 0, size, np.minimum(np.abs(theirs - np.arange(len(own))), size)).sum(axis=1)
        best = int(np.argmin(distance))
        return langs[best], float(1 - distance[best] / (size * len(own)))

    return classify


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text), and any other columns of ``docs`` that are named so.

    Null texts, and those without a letter, are ``und`` with score 0. Repeated rows give repeated rows, an empty table
    an empty one; columns other than doc_id and text aren't read.
    """

    def step():
        classify = classifier(profiles, size)

        def call(batch: dict[str, list]) -> dict[str, list]:
            made = [classify(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

        return call

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learnt from the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame, least_score: float = 0.05) -> DataFrame:
    """The documents in a language that can be told: those that are ``und`` or far from every profile go."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))

    def step():
        classify = classifier(profiles)

        def call(batch: dict[str, list]) -> dict[str, list]:
            keep = [i for i, t in enumerate(batch["text"]) if (c := classify(t))[0] != UNDETERMINED and c[1] >= least_score]
            return {k: [v[i] for i in keep] for k, v in batch.items()}

        return call

    rows = docs.select(*DOCUMENT_COLUMNS)
    return map_rows(rows, step, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


