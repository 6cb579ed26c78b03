"""Join of documents by the Jaccard similarity of their word n-grams: a MinHash LSH forest with exact verification.

Documents with equal n-gram sets are one class from the start. The signature of a class is a path of MinHash values in each
of several trees. A path is kept as a root, its first values, and a suffix whose order is that of the trie below the root.
Matched prefixes are shortened value by value from whole paths to a floor that each set has of its own: the longest prefix
by which all partners that a set of its size can have are found with the target probability. At each node of a trie the
classes that stand there link to one of them, so links are stars, not pairs.

The connected candidates are compared exactly: all pairs of a group, in cells of two bounded blocks each, of which only
counts and a spanning forest leave the task.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.components import connected_components, with_least
from ostinato.llm.rows import arrow_schema, map_rows
from ostinato.llm.shingles import minhashes, mix, shingles
from ostinato.llm.storage import DOCUMENT_COLUMNS, cut, read_table

WORDS, THRESHOLD, TREES, LONGEST, TARGET = 5, 0.8, 24, 8, 0.9999
#: Groups up to this size are one cell; so many n-grams are in a block at most, but for a block of one document.
SMALL_GROUP, BLOCK_SHINGLES = 128, 2_000_000
COLUMNS_AT_ONCE = 8192


#: Sets of more n-grams than this have partners so close to the threshold that their floor is the common one.
SMALL_SET = 64


def prefix_length(similarity: float, trees: int = TREES, longest: int = LONGEST, target: float = TARGET) -> int:
    """The longest prefixes by which pairs of this similarity are found with the target probability.

    If even prefixes of one value are too few, these are used.
    """
    length = longest
    while length > 1 and 1 - (1 - similarity**length) ** trees < target:
        length -= 1
    return length


@cache
def least_similarity(n: int, threshold: float) -> float | None:
    """The least similarity from the threshold on that a set of n values can have with a different set; None if it has none."""
    if n > SMALL_SET:
        return threshold
    found = []
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        common = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if common <= min(n, m) - (n == m):
            found.append(common / (n + m - common))
    return min(found, default=None)


@cache
def floor_length(n: int, threshold: float, trees: int, longest: int, target: float) -> int:
    """To which length the prefixes of a set of n values are shortened; beyond the longest if it can have no partner."""
    similarity = least_similarity(n, threshold)
    return longest + 1 if similarity is None else prefix_length(similarity, trees, longest, target)


def suffix_bits(lowest: int, longest: int) -> int:
    """How many bits of a suffix each value below the root has."""
    return 63 // max(1, longest - lowest)


def paths(values: np.ndarray, trees: int, lowest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Root and suffix of a set's path in each tree, as signed 64-bit integers.

    A root is a hash of the first ``lowest`` values, a suffix has some bits of each further one, the first one highest.
    """
    least = minhashes(values, trees * longest).reshape(trees, longest)
    root, suffix = np.arange(trees, dtype=np.uint64), np.zeros(trees, np.uint64)
    for k in range(lowest):
        root = mix(root * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    bits = suffix_bits(lowest, longest)
    for k in range(lowest, longest):
        suffix = suffix << np.uint64(bits) | mix(least[:, k]) >> np.uint64(64 - bits)
    return root.view(np.int64), suffix.view(np.int64)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(rows: DataFrame, words: int, threshold: float, trees: int, target: float) -> DataFrame:
    """(doc_id, row, key, n_shingles, floor, roots, suffixes) of each row of (doc_id, row, text) that has words."""
    lowest = prefix_length(threshold, trees, LONGEST, target)

    def step():
        def call(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "key", "n_shingles", "floor", "roots", "suffixes")}
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                values = shingles(text, words)
                if n := len(values):
                    floor = floor_length(min(n, SMALL_SET + 1), threshold, trees, LONGEST, target)
                    roots, suffixes = paths(values, trees, lowest, LONGEST) if floor <= LONGEST else ((), ())
                    for name, x in zip(out, (doc_id, row, set_key(values), n, floor, roots, suffixes), strict=True):
                        out[name].append(x)
            return out

        return call

    return map_rows(rows.select("doc_id", "row", "text"), step, "doc_id long, row long, key binary, n_shingles long, floor int, roots array<long>, suffixes array<long>")


def forest_links(classes: DataFrame, lowest: int, longest: int = LONGEST) -> DataFrame:
    """(u, v): stars that connect all classes of (key, floor, roots, suffixes) with a common prefix in some tree.

    A row stands in the trie's nodes from its whole path of ``longest`` values up to the prefix at its floor, ``lowest`` or
    more; those of one node link to the one of them with the lowest floor. Only rows whose root others share are in a trie.
    """
    path = F.explode(F.arrays_zip("roots", "suffixes")).alias("path")
    members = classes.select(F.struct("floor", "key").alias("own"), path).select("own", "path.roots", "path.suffixes").toDF("own", "root", "suffix")
    shared = members.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select(F.col("root").alias("r"))
    bits = suffix_bits(lowest, longest)
    # A node's hash has the prefix only, whose length is told by the bits that are left of the suffix.
    nodes = F.transform(F.sequence(F.col("own.floor"), F.lit(longest)), lambda length: F.xxhash64("root", length, F.call_function("shiftright", F.col("suffix"), F.least(F.lit(63), (F.lit(longest) - length) * bits))))
    placed = cut(members.join(shared, F.col("root") == F.col("r")).select("own", F.explode(nodes).alias("node")))
    linked = with_least(placed, "node", "own", "hub").where("own <> hub")
    return linked.select(F.col("hub.key").alias("u"), F.col("own.key").alias("v")).distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share. Only values of several sets take part, some columns at a time."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    by_column = np.argsort(column, kind="stable")
    column, owner = column[by_column], owner[by_column]
    common = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + COLUMNS_AT_ONCE])
        part = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    return np.rint(common).astype(np.int64)


def forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row of its connected part."""
    root = np.full(len(links), -1)
    for start in range(len(links)):
        if root[start] < 0:
            new = np.zeros(len(links), bool)
            new[start] = True
            while new.any():
                root[new] = start
                new = links[new].any(axis=0) & (root < 0)
    return root


CELL_SCHEMA = "key binary, links long, root binary"


def compare_cell(words: int, threshold: float):
    """The function for one cell: links of each of its classes within the cell, weighted by copies, and its forest."""
    to = arrow_schema(CELL_SCHEMA)

    def compare(cell: tuple, table: pa.Table) -> pa.Table:
        first, second = cell[1].as_py(), cell[2].as_py()
        seen, sets, blocks, weights = {}, [], [], []
        for key, block, weight, text in zip(*(table.column(c).to_pylist() for c in ("key", "block", "copies", "text")), strict=True):
            values = shingles(text, words)
            # Ids that are not unique can bring texts of another class, or one several times.
            if key not in seen and set_key(values) == key:
                seen[key] = len(sets)
                sets.append(values)
                blocks.append(block)
                weights.append(weight)
        if len(sets) < 2:
            return to.empty_table()
        common, sizes = common_counts(sets), np.array([len(s) for s in sets])
        links = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        at = np.array(blocks)
        links &= (at[:, None] == first) & (at[None, :] == second) | (at[:, None] == second) & (at[None, :] == first)
        np.fill_diagonal(links, False)
        counts, root, keys = links @ np.array(weights), forest(links), list(seen)
        rows = np.flatnonzero(counts)
        return pa.Table.from_pydict({"key": [keys[r] for r in rows], "links": counts[rows].tolist(), "root": [keys[root[r]] for r in rows]}, schema=to)

    return compare


def _linked(rows: DataFrame, words: int, threshold: float, trees: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Of rows of (doc_id, row, text) with ids: (doc_id, row, key, ...) of those with words, and (k, links, group, smallest)
    of each class k: the links of its documents, the key that stands for its connected part and that part's smallest id."""
    lowest = prefix_length(threshold, trees, LONGEST, target)
    sets = cut(signatures(rows, words, threshold, trees, target))
    first = [F.first(c).alias(c) for c in ("n_shingles", "floor", "roots", "suffixes")]
    classes = cut(sets.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), *first))
    groups = cut(connected_components(forest_links(classes, lowest)).join(classes.select(F.col("key").alias("node"), "rep", "copies", "n_shingles"), "node"))

    blocks = F.when(F.col("g") <= SMALL_GROUP, 1).otherwise(F.ceil(F.sqrt("g") * 0.8)).cast("int")
    sizes = groups.groupBy("component").agg(F.count("*").alias("g"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("component", F.greatest(blocks, F.ceil(F.col("s") / BLOCK_SHINGLES).cast("int")).alias("blocks"))
    placed = groups.join(sizes, "component").select("rep", F.col("node").alias("key"), "component", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = rows.select("doc_id", "text").join(placed, F.col("doc_id") == F.col("rep"))
    cells = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "key", "block", "copies", "text")
    verified = cut(cells.groupBy("component", "first", "second").applyInArrow(compare_cell(words, threshold), CELL_SCHEMA))

    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.where("key <> root").select(F.col("root").alias("u"), F.col("key").alias("v")))
    named = joined.join(classes.select(F.col("key").alias("node"), "rep"), "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    parts = named.join(smallest, "component").select(F.col("node").alias("key"), F.col("component").alias("group"), "smallest")
    found = classes.select("key", "copies", "rep").join(links, "key", "left").join(parts, "key", "left")
    # Written out, so that joins with it deal both sides anew and can split a class that very many documents have.
    return sets, cut(found.select(F.col("key").alias("k"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("group", "key").alias("group"), F.coalesce("smallest", "rep").alias("smallest")))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """One row per document: doc_id, n_links, component_id and kept.

    n_links counts the other documents with a Jaccard similarity of at least the threshold, copies each; component_id
    is the smallest doc_id that links lead to; kept is whether that is the document itself. Texts of fewer than
    ``words`` words are one n-gram; null texts and those without words link with nothing, like null ids (whose
    component_id is null, and which are kept). Rows with equal doc_id are documents of their own and have a row each.
    An empty table gives an empty one. Columns other than doc_id and text aren't read.
    """
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    sets, found = _linked(rows.where("doc_id is not null"), words, threshold, trees, target)
    with_words = sets.select("doc_id", "key").join(found, F.col("key") == F.col("k")).select("doc_id", F.col("links").alias("n_links"), F.col("smallest").alias("component_id"))
    without = rows.where(_stands_alone()).select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).select("doc_id", "n_links", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _stands_alone():
    """Whether a document takes no part: it has no id or no words."""
    return F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; all others stay as they are.

    Rows that share an id but aren't near duplicates stay both; of several in a group that share the smallest id, one
    with the least fingerprint of its columns stays. Rows without an id or without words stay.
    """
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("row", F.xxhash64(*DOCUMENT_COLUMNS))
    sets, found = _linked(rows.where("doc_id is not null"), WORDS, THRESHOLD, TREES, TARGET)
    groups = sets.select("doc_id", "row", "key").join(found, F.col("key") == F.col("k")).groupBy("group", "doc_id", "row").agg(F.count("*").alias("n"))
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row", "n")).alias("first"))
    first = cut(first.select(F.col("first.doc_id").alias("d"), F.col("first.row").alias("r"), F.col("first.n").alias("n")))
    kept = rows.where(~_stands_alone()).join(first, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")))
    # Only rows that repeat as a whole are dealt again to leave one of them.
    kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["doc_id", "row"]))
    return kept.select(*DOCUMENT_COLUMNS).unionByName(rows.where(_stands_alone()).select(*DOCUMENT_COLUMNS))
