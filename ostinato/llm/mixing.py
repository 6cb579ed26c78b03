"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. The prefix sum of
these expectations runs over the source's documents in a fixed total order (size class, then a keyed hash); one
random offset is added for each source, and a document is emitted once for every integer boundary that its
stretch of the prefix sum crosses. As the order goes by size, the words taken stray from a source's target by
less than about one of its large documents.

A source's prefix sum isn't one sorted task. The order is cut into (source, size class, hash range) cells, of
which there are about the square root of the number of rows in each class. Cells are counted with partial
aggregation, their starts are summed over cells, and only the rank within a cell needs its rows together. So a
source, or a size, that holds a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.llm.storage import DOCUMENT_COLUMNS, cut, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: A hash of 15 hexadecimal digits is below this.
HASH_RANGE = 1 << 60


def keyed_hash(seed: int, *columns: Column) -> Column:
    """A long below HASH_RANGE that SQL engines with md5 agree on; null columns count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Sizes of the same class share their length in bits and the first four of these, and so differ by less than an eighth."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.expr("shiftright(size * 8, length(bin(size)) - 1)")


def weighted_targets(sources: DataFrame, cap: float, weight: Column | None = None) -> DataFrame:
    """Adds rank, weight and target to (source, source_size).

    Targets are in proportion to the weights, stop at cap * source_size and sum to all sizes: what a capped source
    leaves is shared by weight among the others until none is above. In order of cap / weight, the capped sources
    come first, so the common level is that of the first source that stays below its cap. There is one row for
    each source here, the documents are already summed.
    """
    everything = Window.partitionBy()
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_code_point))
    ranked = ranked.withColumn("weight", (weight if weight is not None else (F.col("rank") - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    ascending = Window.orderBy(F.col("limit") / F.col("weight"), F.col("rank"))
    before, after = ascending.rowsBetween(Window.unboundedPreceding, -1), ascending.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    common = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everything)
    return leveled.withColumn("common", common["level"]).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("common") * F.col("weight"))).alias("target"),
    )


def copies(sized: DataFrame, *, cap: float = 3.0, seed: int = 17, weight: Column | None = None) -> DataFrame:
    """Adds source_size, target and copies to a table with ``doc_id``, ``source``, ``size`` and ``tie``.

    Nulls: a null source is a source of its own, after all others; a null doc_id orders as the empty string.
    Repeated rows are documents of their own. Documents of size 0 are drawn like others and take no words; if a
    source has no words at all, none of its documents is taken. An empty table gives an empty one. Results depend
    on ``seed`` and the rows only, not on their order or partitions.

    ``sized`` is read three times and should be materialised; it holds a few numbers for each document.
    """
    rows = sized.count()
    cells = max(1, math.isqrt(rows) // 16)
    placed = sized.withColumn("class", size_class(F.col("size")).cast("long")).withColumn("hash", keyed_hash(seed, F.col("doc_id"), F.col("tie")))
    placed = placed.withColumn("cell", F.floor(F.col("hash") / F.lit(HASH_RANGE / cells)).cast("long"))
    counted = placed.groupBy("source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words"))

    classes = counted.groupBy("source", "class").agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"))
    sources = classes.groupBy("source").agg(F.sum("class_words").cast("long").alias("source_size"))
    targets = weighted_targets(sources, cap, weight).withColumn("offset", F.pmod(keyed_hash(seed + 1, F.coalesce("source", F.lit("\0"))), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    earlier_classes = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    class_start = classes.select("source", "class", F.coalesce(F.sum("class_n").over(earlier_classes), F.lit(0)).alias("class_start"))
    earlier_cells = Window.partitionBy("source", "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = counted.select("source", "class", "cell", F.coalesce(F.sum("n").over(earlier_cells), F.lit(0)).alias("cell_start"))

    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    starts = cell_start.join(class_start, same(cell_start, class_start, ["source", "class"])).select(cell_start["source"], cell_start["class"], "cell", (F.col("cell_start") + F.col("class_start")).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("s"), starts["class"].alias("c"), starts["cell"].alias("k"), "start", "source_size", "target", "offset")

    within = Window.partitionBy("source", "class", "cell").orderBy("hash", "doc_id", "tie", "size", *[c for c in sized.columns if c == "row"])
    ranked = placed.withColumn("place", F.row_number().over(within) - 1)
    joined = ranked.join(starts, ranked["source"].eqNullSafe(starts["s"]) & (ranked["class"] == starts["c"]) & (ranked["cell"] == starts["k"]))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    position = F.col("start") + F.col("place")
    crossed = F.floor((position + 1) * F.col("expected") + F.col("offset")) - F.floor(position * F.col("expected") + F.col("offset"))
    # A stretch no longer than the cap crosses no more boundaries than that; the bound is for rounding of the sums.
    crossed = F.least(crossed, F.ceil(F.col("expected"))).cast("int")
    return joined.withColumn("expected", expected).withColumn("copies", crossed).drop("s", "c", "k", "class", "cell", "hash", "place", "start", "offset", "expected")


def with_sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and tie (a fingerprint of the text) of each document; null texts have size 0."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.md5("text"), F.lit("")).alias("tie"), *more)


def mix(docs: DataFrame, *, cap: float = 3.0, seed: int = 17, weight: Column | None = None) -> DataFrame:
    """The mixed corpus: every document of ``docs`` as often as it is taken, with the columns of documents."""
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("row", F.xxhash64(*DOCUMENT_COLUMNS))
    plan = copies(cut(with_sizes(rows, "row")), cap=cap, seed=seed, weight=weight)
    # Rows that are equal in all columns are interchangeable: their copies are summed, and they are joined once.
    wanted = plan.groupBy("doc_id", "row").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    wanted = cut(wanted.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "copies", "n"))
    kept = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["d"]) & (rows["row"] == wanted["r"]))
    kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["doc_id", "row"]))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*DOCUMENT_COLUMNS)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    taken = copies(cut(with_sizes(read_table(spark, sf_dir, "documents"))))
    return taken.select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP1_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(text), '') AS tie FROM documents
), placed AS (
    SELECT *, length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)::INTEGER) AS class, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || tie), 1, 15))::BIGINT AS hash FROM sized
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM placed GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sources
), weighted AS (
    SELECT *, ((rnk - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM ranked
), leveled AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), common AS (
    SELECT arg_min(level, (cap / weight, rnk)) AS common FROM leveled WHERE level * weight <= cap
), targets AS (
    SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target,
        (('0x' || substr(md5('18|' || coalesce(source, chr(0))), 1, 15))::BIGINT % 1048576) / 1048576.0::DOUBLE AS u
    FROM weighted, common
), positions AS (
    SELECT p.doc_id, p.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
        row_number() OVER (PARTITION BY p.source ORDER BY class, hash, doc_id, tie) - 1 AS k
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (least(floor((k + 1) * e + u) - floor(k * e + u), ceil(e)) * size)::BIGINT AS taken FROM positions
"""
