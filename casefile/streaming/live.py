"""Streams: running and finished answers, observed rates in event time, and admission with state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casefile.functions.text import think_stripped
from casefile.operators.admission import admitted_flags

OPEN, CLOSE = "<think>", "</think>"


def _closed_removed(text: str) -> str:
    while (a := text.find(OPEN)) >= 0 and (b := text.find(CLOSE, a)) >= 0:
        text = text[:a] + text[b + len(CLOSE) :]
    return text


def shown_after(held: str, shown: int, chunk: str) -> tuple[str, int, str]:
    """(text kept, characters of it that were shown, what becomes visible) once ``chunk`` follows the kept text.

    Nothing is shown from an opening tag, or from what may become one, on. Of shown text as much is kept as
    a tag could still begin in."""
    held = _closed_removed(held + chunk)
    at = held.find(OPEN)
    if at < 0:
        at = len(held) - max(n for n in range(len(OPEN)) if held.endswith(OPEN[:n]))
    piece = held[shown:at]
    shown = max(shown, at)
    past = max(0, min(shown, len(held)) - len(OPEN) + 1)
    return held[past:], shown - past, piece


def visible(chunks: Iterable[str]) -> Iterator[str]:
    """What may be shown after each chunk; a block that never closes is shown at the end."""
    held, shown = "", 0
    for chunk in chunks:
        held, shown, piece = shown_after(held, shown, chunk)
        if piece:
            yield piece
    if len(held) > shown:
        yield held[shown:]


class _Answers(StatefulProcessor):
    """One running answer a key: the kept text, the next chunk's number, and chunks that came too early."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.text = handle.getValueState("text", "held string, shown int, next long")
        self.early = handle.getMapState("early", "seq long", "chunk string, final boolean")

    def handleInputRows(self, key, rows, timerValues):
        held, shown, due = self.text.get() if self.text.exists() else ("", 0, 0)
        for frame in rows:
            for seq, chunk, final in zip(frame["seq"].tolist(), frame["chunk"].tolist(), frame["final"].tolist(), strict=True):
                if seq >= due:  # a chunk that was shown before is not shown again
                    self.early.updateValue((seq,), (chunk or "", bool(final)))
        pieces, ended = [], False
        while not ended and self.early.containsKey((due,)):
            chunk, ended = self.early.getValue((due,))
            self.early.removeKey((due,))
            held, shown, piece = shown_after(held, shown, chunk)
            if ended:
                piece += held[shown:]
            pieces.append((due, piece))
            due += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            self._forget()
        else:
            self.text.update((held, shown, due))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._frame(key, [(n, piece, ended and n == due - 1) for n, piece in pieces if piece or (ended and n == due - 1)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, shown, due = self.text.get() if self.text.exists() else ("", 0, 0)
        rest = held[shown:]
        for (_,), (chunk, _) in sorted(self.early.iterator()):  # what waits for a chunk that never came
            rest += chunk
        self._forget()
        yield self._frame(key, [(due, rest, True)])

    def _forget(self) -> None:
        self.text.clear()
        self.early.clear()

    @staticmethod
    def _frame(key, rows) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["stream", "seq", "piece", "final"])

    def close(self) -> None:
        pass


def visible_stream(chunks: DataFrame, stream: str, seq: str, chunk: str, final: str, quiet: int = 60) -> DataFrame:
    """``(stream, seq, piece, final)``: of running answers, what each chunk makes visible, as it comes.

    ``seq`` counts a stream's chunks from 0, ``final`` marks its last. Chunks that come early wait for those before
    them, repeated ones are ignored. A stream that is quiet for ``quiet`` seconds ends: an unclosed block
    and waiting chunks are shown, and its state is dropped. Needs a state store with column families
    (``RocksDBStateStoreProvider``)."""
    rows = chunks.select(F.col(stream).cast("string").alias("stream"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk"), F.coalesce(F.col(final), F.lit(False)).alias("final"))
    return rows.groupBy("stream").transformWithStateInPandas(
        statefulProcessor=_Answers(quiet * 1000), outputStructType="stream string, seq long, piece string, final boolean", outputMode="Append", timeMode="ProcessingTime"
    )


def reassembled(chunks: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    """``(stream, content)``: a stream's chunks in order, without think blocks; batch or complete-mode stream."""
    rows = F.array_sort(F.collect_list(F.struct(seq, chunk)))
    joined = F.array_join(F.transform(rows, lambda x: x[chunk]), "")
    return chunks.groupBy(stream).agg(think_stripped(joined).alias("content"))


def windowed_rate(events: DataFrame, ts: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls per key and window of event time; rows later than the watermark are dropped by the sink's mode."""
    own = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = events.withWatermark(ts, late).groupBy(own.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def admission_stream(events: DataFrame, key: str, ts: str, per_minute: int, per_hour: int, interval: float) -> DataFrame:
    """``(key, ts, admitted)`` of a stream: each key keeps the times it admitted in the last hour. Within
    a micro-batch calls are taken in order of time."""
    rows = events.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))

    def walk(own, frames, state):
        past = list(state.get[0]) if state.exists else []
        times = sorted(t for pdf in frames for t in pdf["t"])
        # the admitted calls of the past are admitted again, so one rule serves batches and streams
        flags = admitted_flags(past + times, per_minute, per_hour, interval)[len(past) :]
        past = [t for t in past + [t for t, ok in zip(times, flags, strict=True) if ok] if not times or t > times[-1] - 3600]
        state.update((past,))
        yield pd.DataFrame({"key": own[0], "t": times, "admitted": flags})

    return rows.groupBy("key").applyInPandasWithState(walk, "key string, t double, admitted boolean", "past array<double>", "append", "NoTimeout")
