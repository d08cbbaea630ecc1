"""Streams: a series of games that stops as soon as its test has decided, and the stages of a run from its events.

Both keep a little state a key and give the same rows as the batch queries on the same input,
in whatever order and batches it arrives.  The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import inference

#: What a session needs for these streams.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_COMMITTED = "series long, pair int, bin int, pairs_0 int, pairs_1 int, pairs_2 int, pairs_3 int, pairs_4 int, llr double, decision string"


class _Series(StatefulProcessor):
    """Commits the pairs of a series in order; what arrives early waits, what comes after the decision is discarded."""

    def __init__(self, null: float, alternative: float):
        self.null, self.alternative = null, alternative

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "next int, c0 int, c1 int, c2 int, c3 int, c4 int, decision string")
        self.waiting = handle.getMapState("waiting", "pair int", "bin int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = list(self.done.get()) if self.done.exists() else [0, 0, 0, 0, 0, 0, "continue"]
        at, counts, decision = state[0], np.array(state[1:6], float), state[6]
        out = []
        for frame in rows:
            for pair, b in zip(frame["pair"], frame["bin"]):
                if decision == "continue" and pair >= at:
                    self.waiting.updateValue((int(pair),), (int(b),))
        while decision == "continue" and self.waiting.containsKey((at,)):
            b = self.waiting.getValue((at,))[0]
            self.waiting.removeKey((at,))
            counts[b] += 1
            ratio = inference.log_likelihood_ratio(counts[None, :], self.null, self.alternative)
            decision = str(inference.decisions(ratio, np.array([counts.sum()]))[0])
            out.append((int(key[0]), at, b, *map(int, counts), float(ratio[0]), decision))
            at += 1
        if decision != "continue":
            self.waiting.clear()
        self.done.update((at, *map(int, counts), decision))
        names = [x.split()[0] for x in _COMMITTED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({n: "int64" if n == "series" else "int32" for n in names[:8]}) if out else pd.DataFrame({n: pd.Series(dtype="object") for n in names}).astype({n: "int64" if n == "series" else "int32" for n in names[:8]} | {"llr": "float64"})

    def close(self) -> None:
        pass


def committed_pairs(pairs: DataFrame, null: float = 0.0, alternative: float = 20.0) -> DataFrame:
    """Rows (series, pair, bin) of a stream, pairs numbered from 0 without gaps: the committed ones with running counts and decision."""
    return pairs.select("series", "pair", "bin").groupBy("series").transformWithStateInPandas(statefulProcessor=_Series(null, alternative), outputStructType=_COMMITTED, outputMode="append", timeMode="none")


_STATES = "stage string, sequence long, state string, attempts int, seconds double"
#: What an event makes of a stage.
MOVES = {"stage_started": "running", "stage_completed": "complete", "stage_failed": "failed", "stage_abandoned": "abandoned"}


class _Stages(StatefulProcessor):
    """The state of a stage, by the latest of its events in the order of their sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string, attempts int, seconds double, sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, attempts, seconds, last = self.held.get() if self.held.exists() else ("pending", 0, 0.0, 0)
        frame = pd.concat(list(rows)).sort_values("sequence")
        for n, kind, spent in zip(frame["sequence"], frame["type"], frame["seconds"]):
            if kind not in MOVES:
                continue
            if n > last:  # an event that comes late counts, but leaves the state to the later ones
                state, last = MOVES[kind], int(n)
            attempts += kind == "stage_started"
            seconds += 0.0 if pd.isna(spent) else float(spent)
        out = [(str(key[0]), int(last), state, int(attempts), float(seconds))]
        self.held.update((state, int(attempts), float(seconds), int(last)))
        yield pd.DataFrame(out, columns=["stage", "sequence", "state", "attempts", "seconds"]).astype({"sequence": "int64", "attempts": "int32", "seconds": "float64"})

    def close(self) -> None:
        pass


def stage_states(events: DataFrame) -> DataFrame:
    """Rows (sequence, type, stage, seconds) of a stream: each stage's state after each batch of its events, with attempts and seconds so far."""
    return events.select("sequence", "type", "stage", "seconds").filter("stage IS NOT NULL").groupBy("stage").transformWithStateInPandas(statefulProcessor=_Stages(), outputStructType=_STATES, outputMode="append", timeMode="none")
