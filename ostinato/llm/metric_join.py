"""Exact metric range join of vectors by pivots.

Unit vectors within an angle are within a chord r of each other. Every vector belongs to the cell of its nearest pivot of
its label. A vector x within r of some vector of another cell is within r of the plane halfway between the two pivots,
(d(x,c)^2 - d(x,own)^2) / 2 d(c,own) away, and by the triangle inequality within r of the ball that the cell's vectors
fill around their pivot. So x visits only cells for which both hold. Of the two cells of a pair the one with the smaller
number compares it, so vectors visit cells of smaller numbers only. Cells join on their own, in pairs of bounded blocks.

Where dimensions are many and vectors spread evenly, most of them are near the planes and visit most cells; then the work
is that of comparing all pairs of a label in blocks, which it can't be less than for an exact result by this rule.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from ostinato.llm.components import connected_components
from ostinato.llm.ngram_join import forest
from ostinato.llm.rows import arrow_schema
from ostinato.llm.storage import cut, read_table

COSINE = 0.93
#: A label has about a pivot for so many vectors, a block has about so many of them; and so many pivots at most.
BLOCK, MOST_PIVOTS = 1024, 1024
#: So many vectors at a time are held against their label's pivots.
CHUNK = 8192
#: For rounding: distances are right to more places, but for pivots closer than CLOSE, between which no plane is drawn.
SLACK, CLOSE = 1e-8, 1e-3


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    lists = column.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


CELLS_SCHEMA = "label int, dim int, class long, cells array<int>, away array<double>"


def assign_cells(cosine: float):
    """The function for a chunk of vectors and its label's pivots: the cells of each vector, its own first, and the
    distances to their pivots."""
    to, reach = arrow_schema(CELLS_SCHEMA), math.sqrt(2 - 2 * cosine) + SLACK

    def assign(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(vectors):
            return to.empty_table()
        centres = matrix(pivots.sort_by("cell").column("pivot"))
        away, between = distances(matrix(vectors.column("embedding")), centres), distances(centres, centres)
        home = away.argmin(axis=1)
        own = away[np.arange(len(away)), home]
        apart = between[home]
        planes = (away**2 - own[:, None] ** 2) / (2 * np.maximum(apart, CLOSE))
        visits = (planes <= reach) | (apart < CLOSE)
        visits &= np.arange(len(centres))[None, :] < home[:, None]
        cells = [[int(h), *np.flatnonzero(v).tolist()] for h, v in zip(home, visits, strict=True)]
        columns = {n: vectors.column(n) for n in ("label", "dim", "class")}
        return pa.Table.from_pydict(columns | {"cells": cells, "away": [away[i, c].tolist() for i, c in enumerate(cells)]}, schema=to)

    return assign


PAIRS_SCHEMA = "class long, links long, root long"


def compare_cell(cosine: float):
    """The function for one pair of blocks: links of each vector, weighted by copies, and a spanning forest."""
    to = arrow_schema(PAIRS_SCHEMA)

    def compare(table: pa.Table) -> pa.Table:
        own, number, copies, kind = (table.column(c).to_numpy() for c in ("own", "class", "copies", "kind"))
        left, right = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(left) or not len(right):
            return to.empty_table()
        x = matrix(table.column("embedding"))
        near = x[left] @ x[right].T >= cosine
        # Two of the cell's own meet twice, once in each place; a visitor is always on the right.
        near &= ~own[right][None, :] | (number[left][:, None] < number[right][None, :])
        a, b = np.nonzero(near)
        ids, place = np.unique(np.concatenate((number[left[a]], number[right[b]])), return_inverse=True)
        u, v = place[: len(a)], place[len(a) :]
        counts = np.bincount(u, copies[right[b]], len(ids)) + np.bincount(v, copies[left[a]], len(ids))
        linked = np.zeros((len(ids), len(ids)), bool)
        linked[u, v] = linked[v, u] = True
        return pa.Table.from_pydict({"class": ids, "links": counts.astype(np.int64), "root": ids[forest(linked)] if len(ids) else ids}, schema=to)

    return compare


def choose_pivots(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(label, dim, cell, embedding): about a vector in BLOCK of each label, by their hashes, and at least one."""
    share = (F.xxhash64("a", "b", F.lit(3)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("share")
    drawn = classes.select("label", "dim", share, "class", "embedding")
    least = drawn.groupBy("label", "dim").agg(F.min(F.struct("share", "class")).alias("least"))
    drawn = drawn.join(least.join(sizes, ["label", "dim"]), ["label", "dim"])
    wanted = F.least(F.col("n") / BLOCK, F.lit(float(MOST_PIVOTS))) / F.col("n")
    drawn = drawn.where((F.col("share") < wanted) | (F.struct("share", "class") == F.col("least")))
    return drawn.select("label", "dim", (F.row_number().over(Window.partitionBy("label", "dim").orderBy("share", "class")) - 1).alias("cell"), "embedding")


def range_join(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): vec_id, n_links, component_id and kept.

    Vectors are linked if their labels are equal and not null and their cosine, in double precision, reaches ``cosine``.
    n_links counts the other vectors that are linked with one, component_id is the smallest vec_id that links lead to.
    Vectors that are null, empty, zero or have null or non-finite components link with nothing, nor do those of different
    lengths with each other, nor rows with a null vec_id (whose component_id is null, and which are kept). Repeated rows
    count as vectors of their own. An empty table gives an empty one. Other columns aren't read.

    Equal vectors of a label are one class and compared once. Pivots are vectors of the table, chosen by their hashes;
    any pivots give the same result. They stay in tables: a chunk of a label's vectors gets its label's pivots.
    """
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    good &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(17), "embedding"))
    found = rows.where("good").groupBy("label", "a", "b").agg(F.count("*").alias("copies"), F.min(F.struct("vec_id", "embedding")).alias("first"))
    # A class's number is stable once it is written; ids could repeat.
    classes = cut(found.select(F.monotonically_increasing_id().alias("class"), "label", F.size("first.embedding").alias("dim"), "a", "b", "copies", F.col("first.vec_id").alias("rep"), F.col("first.embedding").alias("embedding")))

    label_sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    chunks = label_sizes.select("label", "dim", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chunked = classes.join(chunks, ["label", "dim"]).select("label", "dim", F.pmod(F.xxhash64("class", F.lit(5)), F.col("chunks")).cast("int").alias("chunk"), "class", "embedding")
    pivots = choose_pivots(classes, label_sizes).join(chunks, ["label", "dim"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pivots = pivots.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("chunk").alias("c"), "cell", F.col("embedding").alias("pivot"))
    located = cut(chunked.groupBy("label", "dim", "chunk").cogroup(pivots.groupBy("l", "d", "c")).applyInArrow(assign_cells(cosine), CELLS_SCHEMA))

    visits = located.select("label", "dim", "class", F.col("cells")[0].alias("home"), F.explode(F.arrays_zip("cells", "away")).alias("at"))
    visits = visits.select("label", "dim", "class", F.col("at.cells").alias("cell"), (F.col("home") == F.col("at.cells")).alias("own"), F.col("at.away").alias("away"))
    size = visits.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"), F.count_if("own").alias("h"), F.max(F.when(F.col("own"), F.col("away"))).alias("radius")).where("h > 0")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    size = cut(size.select("label", "dim", "cell", "radius", parts("h").alias("lefts"), parts("m").alias("rights")))
    inside = F.col("own") | (F.col("away") <= F.col("radius") + (math.sqrt(2 - 2 * cosine) + SLACK))
    member = visits.join(size, ["label", "dim", "cell"]).where(inside).select("label", "dim", "cell", "class", "own", "lefts", "rights")
    member = member.join(classes.select("class", "copies", "embedding"), "class")
    part = lambda salt, n: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n)).cast("int")
    place = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    # A vector of the cell stands on the left in all pairs of its block, and like each visitor on the right.
    lefts = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: place(part(1, "lefts"), j, 0))
    rights = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: place(i, part(2, "rights"), 1))
    placed = member.withColumn("at", F.explode(F.when(F.col("own"), F.concat(lefts, rights)).otherwise(rights)))
    placed = placed.select("label", "dim", "cell", "at.i", "at.j", "at.kind", "own", "class", "copies", "embedding")
    compared = cut(placed.groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare_cell(cosine), PAIRS_SCHEMA))

    links = compared.groupBy("class").agg(F.sum("links").alias("links"))
    groups = connected_components(compared.where("class <> root").select(F.col("root").alias("u"), F.col("class").alias("v")))
    groups = groups.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    smallest = groups.groupBy("component").agg(F.min("rep").alias("smallest"))
    groups = groups.join(smallest, "component").select(F.col("node").alias("class"), "smallest")
    named = classes.select("label", "a", "b", "class", "rep", "copies").join(links, "class", "left").join(groups, "class", "left")
    named = cut(named.select(F.col("label").alias("l"), F.col("a").alias("x"), F.col("b").alias("y"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "rep").alias("smallest")))
    ids = rows.select("vec_id", "good", "label", "a", "b")
    linked = ids.where("good").join(named, (F.col("label") == F.col("l")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("vec_id", F.col("links").alias("n_links"), F.col("smallest").alias("component_id"))
    alone = ids.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of a label."""
    return range_join(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
    SELECT vec_id AS node, vec_id AS least FROM embeddings
    UNION
    SELECT l.v, r.least FROM reach r JOIN links l ON l.u = r.node
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
LEFT JOIN (SELECT node, min(least) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
"""
