"""Metric logs: the best epoch so far and when to stop, over a table and over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "best double, best_epoch long, bad long, last_epoch long, stopped_at long"


class Progress:
    """What is known of one run and metric; one epoch after the other goes in."""

    def __init__(self, state: tuple | None = None) -> None:
        self.best, self.best_epoch, self.bad, self.last, self.stopped = state or (None, -1, 0, -1, -1)

    def see(self, name: tuple, epoch: int, value: float, min_delta: float, patience: int) -> None:
        """Nothing changes once stopped, and epochs at or before the last one are ignored."""
        if self.stopped >= 0 or epoch <= self.last:
            return
        if value is None or value != value:
            raise ValueError(f"run {', '.join(map(str, name))}, epoch {epoch}: not a number")
        self.last = int(epoch)
        if self.best is None or value > self.best + min_delta:
            self.best, self.best_epoch, self.bad = float(value), int(epoch), 0
        else:
            self.bad += 1
            self.stopped = int(epoch) if self.bad >= patience else -1

    def state(self) -> tuple:
        return self.best, self.best_epoch, self.bad, self.last, self.stopped


def monitor(log: DataFrame, min_delta: float, patience: int, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys and the state after all epochs; log: keys (a run, or a run and the name of a metric), epoch, value. A value that is
    missing or not a number is an error, as in the stream.

    Each task reads its runs in the order of epochs and keeps one state at a time, so a run of very many epochs is no array."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows = [(*k, p.best, p.best_epoch, p.bad, p.last, None if p.stopped < 0 else p.stopped) for k, p in done]
            done.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                state = [pa.field("best", pa.float64())] + [pa.field(c, pa.int64()) for c in ("best_epoch", "bad", "last_epoch", "stopped_at")]
                schema = pa.schema([*(batch.schema.field(k) for k in keys), *state])
            for *key, epoch, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or tuple(key) != held:
                    if held is not None:
                        done.append((held, now))
                    held, now = tuple(key), Progress()
                now.see(held, epoch, value, min_delta, patience)
            if done:
                yield out()
        if held is not None:
            done.append((held, now))
            yield out()

    rows = log.select(*keys, F.col("epoch").cast("long").alias("epoch"), F.col("value").cast("double").alias("value")).repartition(*keys).sortWithinPartitions(*keys, "epoch")
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*keys).schema)
    return rows.mapInArrow(fold, f"{named}, {STATE}")


def invalid_metrics(log: DataFrame) -> DataFrame:
    """Epochs whose metric is missing or not a number."""
    return log.where(F.col("value").isNull() | F.isnan("value"))


def monitor_stream(log: DataFrame, min_delta: float, patience: int, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The same over a stream, in update mode: one state for each of the keys; epochs at or before the last one seen are ignored.
    A query that starts again from its checkpoint goes on from the states there."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Progress(tuple(state.get) if state.exists else None)
        rows = pd.concat(list(parts)).sort_values("epoch")
        for epoch, value in zip(rows["epoch"], rows["value"], strict=True):
            now.see(key, epoch, value, min_delta, patience)
        state.update(now.state())
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "best": [now.best], "best_epoch": [now.best_epoch], "bad": [now.bad], "last_epoch": [now.last], "stopped_at": [now.stopped]})

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*keys).schema)
    return log.groupBy(*keys).applyInPandasWithState(step, f"{named}, {STATE}", STATE, "update", "NoTimeout")
