"""The monitor and the audit as streams."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docaudit.operators import monitor


def stream_stage_stats(events: DataFrame, length: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Windowed statistics of an event stream; rows later than the watermark are dropped."""
    return monitor.windowed_stats(events.withWatermark("ts", late), length, slide)


def stream_sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    return monitor.session_stats(events.withWatermark("ts", late), gap, key)


def stream_panes(events: DataFrame, length: str = "10 minutes", late: str = "1 hour", by: str = "event_type", good=None) -> DataFrame:
    """Panes of an event stream with quantile sketches: store them, and windows of any length are merged from the table."""
    return monitor.panes(events.withWatermark("ts", late), length, by, good)


class Pairing:
    """Open audits of one key, oldest first, as microseconds. Events come in order of time."""

    def __init__(self, opened: list[int], limit: int):
        self.opened, self.limit = opened, limit

    def until(self, now: int) -> list[tuple[int, float | None]]:
        """Audits whose time limit has passed: (began, no duration)."""
        n = next((i for i, at in enumerate(self.opened) if at + self.limit > now), len(self.opened))
        gone, self.opened = self.opened[:n], self.opened[n:]
        return [(at, None) for at in gone]

    def event(self, at: int, kind: str, start: str, finish: str) -> list[tuple[int, float | None]]:
        """What ends with an event: audits past their limit, then the oldest open one by a finish (of duration 0 if there is none)."""
        out = self.until(at)
        if kind == start:
            self.opened.append(at)
        elif kind == finish:
            began = self.opened.pop(0) if self.opened else at
            out.append((began, (at - began) / 1e6))
        return out


PAIRED = "began timestamp, seconds double, finished boolean"


def _paired(key: str, values: list, rows: list[tuple[int, float | None]]) -> pd.DataFrame:
    began = pd.to_datetime(pd.Series([x for x, _ in rows], dtype="int64"), unit="us", utc=True)
    return pd.DataFrame({key: pd.Series(values, dtype=object), "began": began, "seconds": pd.Series([s for _, s in rows], dtype="float64"), "finished": [s is not None for _, s in rows]})


def pair_each_audit(events: DataFrame, start: str, finish: str, limit: str = "1 day", key: str = "user_id", now: str | None = None) -> DataFrame:
    """(key, began, seconds, finished) for every audit of a table that has ended: a finish ends its key's oldest open audit
    (or counts 0 seconds without one), and an audit without a finish within `limit` ends unfinished, seconds NULL. `now` (a
    timestamp; default: never) ends what is over by then. Keys are read as sorted streams: only open audits are held."""
    micros, last = int(pd.Timedelta(limit).total_seconds() * 1e6), None if now is None else pd.Timestamp(now, tz="UTC").value // 1000

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, pairing = None, None
        for batch in batches:
            keys, out = [], []  # of one batch

            def ends(ended: list[tuple[int, float | None]]) -> None:
                keys.extend([own] * len(ended))
                out.extend(ended)

            for value, at, kind in zip(batch[key].tolist(), batch["at_micros"].tolist(), batch["event_type"].tolist()):
                if pairing is None or value != own:
                    if pairing is not None and last is not None:
                        ends(pairing.until(last))
                    own, pairing = value, Pairing([], micros)
                ends(pairing.event(at, kind, start, finish))
            if out:
                yield _paired(key, keys, out)
        if pairing is not None and last is not None:
            rest = pairing.until(last)
            yield _paired(key, [own] * len(rest), rest)

    rows = events.where(F.col(key).isNotNull() & F.col("event_type").isin(start, finish)).select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"), "event_type", "event_id")
    dealt = rows.repartition(key).sortWithinPartitions(key, "at_micros", "event_id")
    return dealt.mapInPandas(pair, f"{key} {dict(events.dtypes)[key]}, {PAIRED}")


class _PairAudits(StatefulProcessor):
    """Buffers a key's events until the watermark has passed them, so they count in order of time whatever order they come in; a
    timer wakes the key at its next event or limit, and state ends with the last open audit."""

    def __init__(self, key: str, start: str, finish: str, limit: int):
        self.key, self.start, self.finish, self.limit = key, start, finish, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, kind string")
        self.opened = handle.getListState("opened", "at bigint")

    def _wake(self, waiting: list[tuple], opened: list[int]) -> None:
        times = [x[0] for x in waiting] + [at + self.limit for at in opened]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(i), k) for batch in rows for a, i, k in zip(batch["at_micros"], batch["event_id"], batch["event_type"])]
        self.waiting.appendList(new)
        self._wake(new, [])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in waiting if x[0] < now], [x for x in waiting if x[0] >= now]
        pairing, ended = Pairing(sorted(x[0] for x in self.opened.get()), self.limit), []
        for at, _, kind in due:
            ended += pairing.event(at, kind, self.start, self.finish)
        ended += pairing.until(now)
        for state, rows in ((self.waiting, later), (self.opened, [(x,) for x in pairing.opened])):
            state.clear()
            if rows:
                state.put(rows)
        self._wake(later, pairing.opened)
        if ended:
            yield _paired(self.key, [key[0]] * len(ended), ended)

    def close(self) -> None:
        pass


def stream_pair_audits(events: DataFrame, start: str, finish: str, limit: str = "1 day", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """pair_each_audit as a stream: the same rows, whatever order events come in within `late`; an audit is told unfinished once
    the watermark has passed its limit. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    micros = int(pd.Timedelta(limit).total_seconds() * 1e6)
    rows = events.withWatermark("ts", late).where(F.col(key).isNotNull() & F.col("event_type").isin(start, finish))
    rows = rows.select(key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"), F.col("event_id").cast("long").alias("event_id"), "event_type")
    return rows.groupBy(key).transformWithStateInPandas(_PairAudits(key, start, finish, micros), f"{key} {dict(events.dtypes)[key]}, {PAIRED}", "Append", "EventTime")


def stream_audit(docs: DataFrame, audit: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Audits each batch of new documents; returns the query. Each batch's rows are a folder of their own, written anew if the
    batch runs again, so a retry repeats nothing."""
    write = lambda batch, number: audit(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
