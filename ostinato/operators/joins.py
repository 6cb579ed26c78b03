"""Joins by position, by span, by name and by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import ranges
from ostinato.operators.spatial import nearest_reference as nearest_reference

#: Sides that are broadcast by hint are dimensions whose size in bytes the planner bounds.
MOST_BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, most: int = MOST_BROADCAST_BYTES) -> bool:
    """Whether the planner's bound on a table's bytes is at most ``most``.

    The bound comes from the files' sizes and the plan, so no job is run; it is never below what is read.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if the planner's bound on its bytes allows it, else as it is, for the planner to decide."""
    return F.broadcast(df) if is_small(df) else df


def positional(left: DataFrame, right: DataFrame, key: list[str], position: str) -> tuple[DataFrame, DataFrame]:
    """The k-th row of one sequence with the k-th of the other, and the sequences whose counts differ.

    A sequence whose counts differ is in the second table, with both counts, and not in the first.
    """
    n = left.groupBy(*key).agg(F.count("*").alias("n_left")).join(right.groupBy(*key).agg(F.count("*").alias("n_right")), key, "full")
    n = n.fillna(0, ["n_left", "n_right"])
    fit = n.where("n_left = n_right").select(*key)
    return left.join(right, [*key, position]).join(fit, key, "left_semi"), n.where("n_left <> n_right")


def on_spans(tokens: DataFrame, vectors: DataFrame, key: list[str], span: str, columns: dict[str, float]) -> DataFrame:
    """Values of the chord that a token belongs to; defaults where there is none."""
    joined = tokens.join(vectors.select(*key, span, *columns), [*key, span], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c, default in columns.items()})


def looked_up(df: DataFrame, dim: DataFrame, on: Column, value: str, default) -> DataFrame:
    """A value from a small dimension, or a default."""
    return df.join(small(dim), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def pairing_report(base: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """How many rows of a table have both partners, lack the first, or have the first and lack the second."""
    marked = base.select(key).join(first.select(key, F.lit(1).alias("_a")).distinct(), key, "left").join(second.select(key, F.lit(1).alias("_b")).distinct(), key, "left")
    status = F.when(F.col("_a").isNull(), "no_first").when(F.col("_b").isNull(), "no_second").otherwise("paired")
    return marked.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def set_parity(df: DataFrame, group: str, value: str, reference) -> DataFrame:
    """For each group other than the reference: how many values it lacks and how many it has besides."""
    own = df.select(group, value).distinct()
    base = own.where(F.col(group) == reference).select(value)
    groups = own.select(group).where(F.col(group) != reference).distinct()
    wanted = groups.crossJoin(small(base))  # groups are few: types of a corpus
    missing = wanted.join(own, [group, value], "left_anti").groupBy(group).agg(F.count("*").alias("missing"))
    extra = own.where(F.col(group) != reference).join(base, value, "left_anti").groupBy(group).agg(F.count("*").alias("extra"))
    return groups.join(missing, group, "left").join(extra, group, "left").fillna(0, ["missing", "extra"])


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def by_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, value: str, order: str) -> DataFrame:
    """A value of the right row with the same normalised name; of several the last in order counts."""
    names = right.groupBy(normalised_name(F.col(right_name)).alias("_name")).agg(F.max_by(value, order).alias(value))
    return left.withColumn("_name", normalised_name(F.col(left_name))).join(names, "_name", "left").drop("_name")


#: Characters of the pieces by which names are found.
PIECE = 3


def pieces_of(text: Column, length: Column | int) -> Column:
    """The distinct pieces of a length that a text has; none if it is shorter."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, length)))).otherwise(F.array().cast("array<string>"))


def resolve_fragments(fragments: DataFrame, names: DataFrame, fragment: str, name: str) -> DataFrame:
    """For each fragment that is not empty the shortest name that contains it, then the first by spelling.

    Names are found by their pieces of three characters. How many names have each piece is counted first, and a fragment
    is looked up by the one of its pieces that the fewest names have: what many fragments and names share, such as how
    they begin, brings nothing together. A piece that no name has ends the search for its fragments. Fragments of one or
    two characters are looked up as they are. Both sides may be large; what is found is compared as a whole.
    """
    wanted = fragments.where(F.length(fragment) > 0).select(F.col(fragment).alias("_fragment")).distinct()
    own = names.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    asked = wanted.select("_fragment", F.explode(pieces_of(F.col("_fragment"), F.least(F.length("_fragment"), F.lit(PIECE)))).alias("_piece"))
    held = F.flatten(F.array(*[pieces_of(F.col("_name"), k) for k in range(1, PIECE + 1)]))
    spread = own.select("_name", F.explode(held).alias("_piece")).join(asked.select("_piece").distinct(), "_piece", "left_semi")
    counted = asked.join(spread.groupBy("_piece").agg(F.count("*").alias("_names")), "_piece", "left")
    rarest = counted.groupBy("_fragment").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_piece")).alias("_r")).where("_r.n > 0")
    hits = rarest.select("_fragment", F.col("_r._piece").alias("_piece")).join(spread, "_piece").where(F.col("_name").contains(F.col("_fragment")))
    best = hits.groupBy("_fragment").agg(F.min(F.struct(F.length("_name").alias("n"), "_name")).alias("_m"))
    return best.select(F.col("_fragment").alias(fragment), F.col("_m._name").alias(name))


def compare_in_order(left: DataFrame, right: DataFrame, key: list[str], position: str, value: str) -> DataFrame:
    """(key, n, matches, accuracy): two sequences side by side up to the end of the shorter one."""
    both = left.select(*key, position, F.col(value).alias("_l")).join(right.select(*key, position, F.col(value).alias("_r")), [*key, position])
    return both.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("_l").eqNullSafe(F.col("_r"))).alias("matches")).withColumn("accuracy", F.col("matches") / F.col("n") * 100)


def side_by_side(left: DataFrame, right: DataFrame, key: list[str], position: str, value: str) -> DataFrame:
    """Every place of both sequences with the value of either; null where one is shorter."""
    return left.select(*key, position, F.col(value).alias("left")).join(right.select(*key, position, F.col(value).alias("right")), [*key, position], "full")


def still_to_do(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what isn't done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def first_of_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def first_n_of_each(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first rows of each group: a limit for each type of files."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


# --- vocabularies


def encoded(df: DataFrame, vocabulary: DataFrame, token: str = "tok", pad: int = 0) -> DataFrame:
    """Adds ``id`` from (tok, id); tokens that aren't in the vocabulary are padding."""
    own = vocabulary.select(F.col("tok").alias("_tok"), F.col("id").alias("_id"))
    return df.join(small(own), F.col(token) == F.col("_tok"), "left").withColumn("id", F.coalesce("_id", F.lit(pad)).cast("int")).drop("_tok", "_id")


def encoded_strictly(df: DataFrame, vocabulary: DataFrame, token: str = "tok") -> DataFrame:
    """As encoded; a token that isn't in the vocabulary fails the job."""
    own = vocabulary.select(F.col("tok").alias("_tok"), F.col("id").alias("_id"))
    fault = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce(token, F.lit("null"))))
    return df.join(small(own), F.col(token) == F.col("_tok"), "left").withColumn("id", F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(fault).cast("int")).drop("_tok", "_id")


def decoded(df: DataFrame, vocabulary: DataFrame, id_column: str = "id", unknown: str = "<pad>") -> DataFrame:
    """Adds ``tok`` from (tok, id); ids that aren't in the vocabulary have a token of their own."""
    own = vocabulary.select(F.col("tok").alias("_tok"), F.col("id").alias("_id"))
    return df.join(small(own), F.col(id_column) == F.col("_id"), "left").withColumn("tok", F.coalesce("_tok", F.lit(unknown))).drop("_tok", "_id")


def known_tokens(df: DataFrame, vocabulary: DataFrame, token: str = "tok") -> tuple[DataFrame, DataFrame]:
    """Rows whose token is in the vocabulary, and the tokens that aren't with how often they occur."""
    own = small(vocabulary.select(F.col("tok").alias("_tok")))
    same = F.col(token) == F.col("_tok")
    return df.join(own, same, "left_semi"), df.join(own, same, "left_anti").groupBy(token).agg(F.count("*").alias("n"))


def ordered_vocabulary(groups: list[DataFrame]) -> DataFrame:
    """(tok, id) of tables (nth, tok): one group after another, in the order of ``nth``; a token counts where it is first."""
    rows = None
    for g, group in enumerate(groups):
        own = group.select(F.lit(g).alias("g"), F.col("nth").cast("long").alias("nth"), "tok")
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("tok").agg(F.min(F.struct("g", "nth", "tok")).alias("at"))
    numbered, _ = ranges.numbered(first, ["at"], "id")
    return numbered.select("tok", F.col("id").cast("int").alias("id"))
