"""Stateful operators of the streaming jobs: counts per window, open sessions per bucket of keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_ROWS = "kind string, window_us long, file_type string, batches long, failed_batches long"
SESSION_ROWS = "kind string, key string, start_us long, end_us long, num_events long"


def count_in_batches(rows: DataFrame) -> DataFrame:
    """Rows counted per window and type within each Arrow batch, before they are shuffled."""
    keys = ["window_us", "end_us", "file_type"]

    def count(stream):
        for batch in stream:
            counted = pa.Table.from_batches([batch]).group_by(keys).aggregate(
                [([], "count_all"), ("failed_batches", "sum")]
            )
            counted = counted.select([*keys, "count_all", "failed_batches_sum"])
            yield from counted.rename_columns([*keys, "batches", "failed_batches"]).to_batches()

    schema = "window_us long, end_us long, file_type string, batches long, failed_batches long"
    return rows.select(*keys, "failed_batches").mapInArrow(count, schema)


def merge_bursts(bursts: pd.DataFrame) -> pd.DataFrame:
    """Bursts of a key that overlap, merged: columns key, start_us, end_us, num_events."""
    bursts = bursts.sort_values(["start_us", "end_us"], kind="stable", ignore_index=True)
    codes, keys = pd.factorize(bursts["key"].astype(object), use_na_sentinel=False)
    # The latest end of a key's earlier bursts, all of which begin no later.
    before = bursts["end_us"].groupby(codes).cummax().groupby(codes).shift()
    number = (~(bursts["start_us"] < before)).groupby(codes).cumsum()
    merged = bursts.groupby([codes, number]).agg(
        start_us=("start_us", "min"), end_us=("end_us", "max"), num_events=("num_events", "sum")
    )
    names = [None if pd.isna(keys[c]) else keys[c] for c in merged.index.get_level_values(0)]
    merged.insert(0, "key", pd.Series(names, dtype=object, index=merged.index))
    return merged.reset_index(drop=True)


def bursts_in_batches(rows: DataFrame) -> DataFrame:
    """Rows (key, start_us, end_us) merged to bursts within each batch, before they are shuffled."""

    def merge(stream: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            if len(batch):
                yield merge_bursts(batch.assign(num_events=1))

    return rows.mapInPandas(merge, "key string, start_us long, end_us long, num_events long")


class WindowCounts(StatefulProcessor):
    """Batches and failed ones of a window and type, given out when the watermark passes its end.

    What arrives after that is given out at once, as late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "batches long, failed_batches long")

    def _row(self, kind: str, key: tuple, batches: int, failed: int) -> pd.DataFrame:
        row = (kind, key[0], key[2], batches, failed)
        return pd.DataFrame([row], columns=["kind", "window_us", "file_type", "batches", "failed_batches"])

    def handleInputRows(self, key, rows, timerValues):
        batches = failed = 0
        for part in rows:
            batches += int(part["batches"].sum())
            failed += int(part["failed_batches"].sum())
        end = -(-key[1] // 1000)  # in the milliseconds of the watermark, rounded up
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row("late", key, batches, failed)
            return
        if self.counts.exists():
            before = self.counts.get()
            batches, failed = batches + before[0], failed + before[1]
        else:
            self.handle.registerTimer(end)
        self.counts.update((batches, failed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        batches, failed = self.counts.get()
        self.counts.clear()
        yield self._row("closed", key, batches, failed)

    def close(self) -> None:
        pass


class OpenSessions(StatefulProcessor):
    """Sessions of a bucket of keys that can still grow; they are given out when they cannot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState(
            "sessions", "keys array<string>, starts array<long>, ends array<long>, counts array<long>"
        )

    def _open(self) -> pd.DataFrame:
        columns = self.sessions.get() if self.sessions.exists() else ([], [], [], [])
        names = ["key", "start_us", "end_us", "num_events"]
        return pd.DataFrame({n: pd.Series(list(c), dtype=object if n == "key" else "int64") for n, c in zip(names, columns, strict=True)})

    def _keep(self, sessions: pd.DataFrame) -> None:
        """Store what is open; a timer stands at the end of the first session to be closed."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sessions.empty:
            self.sessions.clear()
            return
        keys = [None if pd.isna(k) else k for k in sessions["key"]]
        self.sessions.update((keys, *(sessions[c].tolist() for c in ("start_us", "end_us", "num_events"))))
        self.handle.registerTimer(-(-int(sessions["end_us"].min()) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        arrived = pd.concat([part.drop(columns="bucket", errors="ignore") for part in rows])
        # No closed session reaches beyond the watermark, so only these can touch one.
        late = arrived["start_us"] < timerValues.getCurrentWatermarkInMs() * 1000
        if late.any():
            yield _labelled("late", merge_bursts(arrived[late]))
        if not late.all():
            self._keep(merge_bursts(pd.concat([self._open(), arrived[~late]])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sessions = self._open()
        done = sessions["end_us"] <= timerValues.getCurrentWatermarkInMs() * 1000
        if done.any():
            yield _labelled("closed", sessions[done])
        self._keep(sessions[~done])

    def close(self) -> None:
        pass


def _labelled(kind: str, sessions: pd.DataFrame) -> pd.DataFrame:
    return sessions.assign(kind=kind)[["kind", "key", "start_us", "end_us", "num_events"]]
