"""Vectors of a token stream while it arrives, put right when tokens come late.

A song's tokens may come in any order, in any micro-batches, more than once. What each token stands in (its chord's
number and the steps of that chord's notes) depends on tokens before and after it, so an arrival can change what was
given out before: a note that comes late changes its whole chord, a chord that comes late renumbers all that follow it.
Only rows that are new or changed come out, each with the number of the correction; for each token the last one counts.
When all tokens have come, these are the rows of ``streams.token_vectors`` over the whole song.

The state of a song is its tokens with what was last said of each, in a map by position; it goes once the song has its
end and no gap before it, or when nothing has come for the time to live. ``chord_vectors`` is joined without state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ostinato.operators import streams

OUT = "song string, pos int, tok string, span int, steps array<int>, correction long"
NOTES = ("PV_", "P_", "H_")


def step_of(token: str) -> int | None:
    """The step of a note token."""
    if token.startswith(NOTES):
        digits = token.split("_")[1]
        return int(digits) if digits.isdigit() else None
    return None


def standing(tokens: list[tuple[int, str]]) -> list[tuple[int, list[int]]]:
    """(span, steps) of each token of a song so far, in order: the block that it stands in, from its start to its end token."""
    spans, begun, ended = [], 0, 0
    for _, token in tokens:
        begun += token == streams.START
        spans.append(begun - 1 if begun > ended else -1)
        ended += token == streams.END
    steps: dict[int, set[int]] = {}
    for (_, token), span in zip(tokens, spans, strict=True):
        if span >= 0 and (step := step_of(token)) is not None:
            steps.setdefault(span, set()).add(step)
    return [(span, sorted(steps.get(span, ()))) for span in spans]


class Backfill(StatefulProcessor):
    """Keeps a song's tokens and says again what has changed."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "pos int", "tok string, span int, steps string", self.ttl_ms)
        self.rounds = handle.getValueState("rounds", "n long, ended boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        correction, ended = self.rounds.get() or (0, False)
        if ended:  # the song is whole: what comes again says nothing new
            return
        known = {k[0]: tuple(v) for k, v in self.tokens.iterator()}
        for frame in rows:
            for pos, token in zip(frame["pos"].tolist(), frame["tok"].tolist(), strict=True):
                if pos not in known:  # the first token of a place stays
                    known[pos] = (token, None, None)
        order = sorted(known)
        changed = []
        for pos, (span, steps) in zip(order, standing([(p, known[p][0]) for p in order]), strict=True):
            token, was, had = known[pos]
            said = " ".join(map(str, steps))
            if (was, had) != (span, said):
                self.tokens.updateValue((pos,), (token, span, said))
                changed.append((key[0], pos, token, span, steps, correction))
        whole = bool(order) and known[order[-1]][0] == "<end>" and order == list(range(len(order)))
        if whole:
            self.tokens.clear()
        if changed or whole:
            self.rounds.update((correction + 1, whole))
        if changed:
            yield pd.DataFrame(changed, columns=["song", "pos", "tok", "span", "steps", "correction"])

    def close(self) -> None:
        pass


def said_of_tokens(tokens: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """(song, pos, tok, span, steps, correction) of a stream of (song, pos, tok), in update mode: new rows and changed ones.

    Positions count from 0. Null tokens and positions are left out, of several tokens for one position the first that
    came counts. The session must be prepared, see ``prepare``.
    """
    rows = tokens.select("song", "pos", "tok").where("pos is not null and tok is not null")
    return rows.groupBy("song").transformWithStateInPandas(Backfill(ttl_ms), OUT, "Update", "ProcessingTime")


def with_vectors(said: DataFrame, dim: DataFrame, default: tuple = streams.DEFAULT_VECTOR) -> DataFrame:
    """Adds alpha, beta, gamma and d: a join with the small table of what chords can be, which needs no state."""
    inside = F.when(F.col("span") >= 0, F.col("steps"))
    made = streams.chord_vectors(said.withColumn("_steps", inside), "_steps", None, dim)
    kept = lambda c, value: F.when(F.col("span") >= 0, F.coalesce(F.col(c), F.lit(value))).otherwise(F.lit(value)).alias(c)
    return made.select("song", "pos", "tok", "span", "correction", *[kept(c, v) for c, v in zip(("alpha", "beta", "gamma", "d"), default, strict=True)])


def latest(said: DataFrame, key: list[str], version: str | Column = "correction") -> DataFrame:
    """Of rows that were written again the last one: the table that a stream's corrections stand for."""
    order = Window.partitionBy(*key).orderBy((F.col(version) if isinstance(version, str) else version).desc())
    return said.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: A store with several variables for a key; and no batches without data, as songs that are too old may wait for the next data.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def prepare(spark: SparkSession) -> None:
    """Sets what the state needs of a session, before the stream is started."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def follow(tokens: DataFrame, dim: DataFrame, out: str, checkpoint: str, *, ttl_ms: int = 24 * 3600 * 1000):
    """Writes the vectors of a token stream, and their corrections, as Parquet; begun again it goes on from its checkpoint.

    A micro-batch is a folder of its own, named by its number, so one that is repeated after a failure replaces itself.
    """
    said = said_of_tokens(tokens, ttl_ms)

    def write(batch: DataFrame, number: int) -> None:
        with_vectors(batch, dim).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return said.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


