"""Connected components of a link table that no task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.storage import cut


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` among those of the same ``key``, of which any number may exist.

    The least values are aggregated before they are dealt, and written: so both sides of the join are dealt anew, and
    the rows of a key that has very many of them are split among tasks.
    """
    least = cut(rows.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(name)))
    return rows.join(least, F.col(key) == F.col("_key")).drop("_key")


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable, for each node of the links in columns ``u`` and ``v``.

    Alternates two steps until nothing changes: every node links its larger neighbours to the smallest of its
    neighbours and itself, then every node links all its smaller neighbours to the smallest of them. The number of
    rounds grows with the logarithm of the longest chain. By with_least a node with very many links is split among
    tasks. Self links and repeated links do no harm.
    """
    up = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = cut(up(edges.select("u", "v")))
    before = _fingerprint(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node without smaller neighbours is its own minimum.
        large = with_least(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        edges = cut(up(large))
        # Only few links lead down from a node now: each of its smaller neighbours has given it the smallest that it knows.
        least = edges.groupBy(F.col("u").alias("_key")).agg(F.min("v").alias("m"))
        small = edges.join(least, F.col("u") == F.col("_key")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(up(small))
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
