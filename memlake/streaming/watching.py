"""Conversations watched as they come: names in view, and claims that are corrected later."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from memlake.functions.words import anchors

#: Turns after which a name that nobody mentions again is out of view.
VIEW_TURNS = 6
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
VIEW = "conv_id long, turn long, names array<string>"


class InView(StatefulProcessor):
    """A conversation's waiting turns, by time and turn, and the last turn of each name.

    A turn waits until the watermark has passed its time, for until then an earlier one may still come; a timer then
    reads all that is ready in order. So what is told does not depend on the order of arrival. After a pause of `idle`
    names begin anew; once the watermark is past such a pause, another timer drops the conversation's state.
    """

    def __init__(self, turns: int, idle: int) -> None:
        self.turns, self.idle = turns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, turn long", "names array<string>")
        self.last = handle.getMapState("last", "name string", "turn long")
        self.read = handle.getValueState("read", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, turn, text in zip(frame["ms"].tolist(), frame["turn"].tolist(), frame["text"].tolist(), strict=True):
                said = set(anchors(text or ""))
                if self.waiting.containsKey((at, turn)):  # a repeated turn
                    said |= set(self.waiting.getValue((at, turn))[0])
                self.waiting.updateValue((at, turn), (sorted(said),))
                self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted(k for k in self.waiting.keys() if k[0] < mark)
        held = {k[0]: v[0] for k, v in self.last.iterator()} if ready else {}
        prior, out = self.read.get()[0] if self.read.exists() else None, []
        for at, turn in ready:
            if prior is not None and at - prior >= self.idle:
                for name in held:
                    if self.last.containsKey((name,)):
                        self.last.removeKey((name,))
                held = {}
            prior = at
            for name in self.waiting.getValue((at, turn))[0]:
                held[name] = max(turn, held.get(name, turn))
            self.waiting.removeKey((at, turn))
            out.append((key[0], turn, sorted(n for n, t in held.items() if turn - self.turns < t <= turn)))
        if ready:
            for name, turn in held.items():
                if ready[-1][1] - turn < self.turns:
                    self.last.updateValue((name,), (turn,))
                elif self.last.containsKey((name,)):
                    self.last.removeKey((name,))
            self.read.update((prior,))
            self.handle.registerTimer(prior + self.idle + 1)
        if prior is not None and mark > prior + self.idle:
            self.last.clear()
            self.read.clear()
        return iter([pd.DataFrame(out, columns=["conv_id", "turn", "names"])] if out else [])


def watch(stream: DataFrame, turns: int = VIEW_TURNS, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(conv_id, turn, names): for each turn of a stream (conv_id, turn, text, at), the names in view of its
    conversation: those mentioned in it or in the turns just before, as names_in_view() tells of stored turns, but for
    those from before a pause of `idle`.

    A turn is told once the watermark has passed it, whatever order turns come in; later ones than that are dropped. A
    null text mentions nothing; turns without a time or a conversation are left out. The session's state store must be
    the one with timers (RocksDB).
    """
    if "RocksDB" not in stream.sparkSession.conf.get(PROVIDER, ""):
        raise ValueError(f"{PROVIDER} must name the RocksDB state store")
    timed = stream.withWatermark("at", late).filter("at is not null and conv_id is not null")
    rows = timed.select("conv_id", F.col("turn").cast("long").alias("turn"), "text", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("conv_id").transformWithStateInPandas(InView(turns, int(pd.Timedelta(idle).total_seconds() * 1000)), VIEW, "Append", "EventTime")


def corrected(claims: DataFrame, corrections: DataFrame, keys: list[str], value: str = "value", at: str = "at", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Claims with the corrections (of the same keys, another value) that came within a time after them, one row each;
    a claim that nobody corrected in that time comes with nulls. Both sides may be streams: their rows are kept only
    while a partner may come, and a claim without one is told when that time is over.
    """
    said = claims.withWatermark(at, late)
    told = corrections.withWatermark(at, late).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("corrected_value"), F.col(at).alias("corrected_at"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    soon = (F.col("corrected_at") >= F.col(at)) & (F.col("corrected_at") <= F.col(at) + F.expr(f"interval {within}")) & (F.col("corrected_value") != F.col(value))
    on = soon
    for s in same:
        on &= s
    return said.join(told, on, "left").drop(*[f"__{k}" for k in keys])
