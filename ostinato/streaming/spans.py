"""Streams of tokens: a chord's pitches come out when its end token arrives.

An extension: the work that this engine covers has no streaming runtime, only states that grow with a token stream. One
sequence's state is the steps of its open chord and how many chords have ended; it goes with the sequence's end token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "song string, chord int, steps string"
STATE = "chord int, open boolean, steps string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    chord, is_open, steps = state.get if state.exists else (0, False, "")
    own = [int(s) for s in steps.split()]
    done, ended = [], False
    for row in pd.concat(list(batches)).sort_values("pos", kind="stable").itertuples():
        if row.tok == "CHORD_START":
            is_open, own = True, []
        elif row.tok == "CHORD_END" and is_open:
            done.append((key[0], chord, " ".join(map(str, sorted(own)))))
            chord, is_open, own = chord + 1, False, []
        elif is_open and row.tok.startswith(("PV_", "H_", "P_")):
            own.append(int(row.tok.split("_")[1]))
        ended = ended or row.tok == "<end>"
    if ended:
        if state.exists:
            state.remove()
    else:
        state.update((chord, is_open, " ".join(map(str, own))))
    yield pd.DataFrame(done, columns=["song", "chord", "steps"])


def finished_chords(tokens: DataFrame) -> DataFrame:
    """(song, chord, steps) of a stream of (song, pos, tok), each chord once, when it ends.

    Tokens of one song arrive in order of micro-batches; within one they are sorted. After a song's ``<end>`` its chords
    would be numbered anew.
    """
    return tokens.groupBy("song").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
