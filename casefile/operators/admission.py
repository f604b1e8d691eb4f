"""Rates of calls: observed in sliding windows, and admitted one after the other."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.sources.scratch import stored


def observed(df: DataFrame, key: str, ts: str, seconds: int, name: str) -> DataFrame:
    """Calls of the key in the ``seconds`` up to each, the far end exclusive. Microsecond clock.

    A key's history is cut into stretches of that length: a call is counted in its own and lent to the next, so
    a busy key is many groups. Null times count nothing."""
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_at", at).withColumn("_own", F.floor(F.col("_at") / span).cast("long"))
    lent = rows.withColumn("_in", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array("_own", F.col("_own") + 1))))
    own = Window.partitionBy(key, "_in").orderBy("_at").rangeBetween(-span + 1, 0)
    counted = lent.withColumn(name, F.count("_at").over(own)).filter(F.col("_in").eqNullSafe(F.col("_own")))
    return counted.select(*df.columns, name)


def admitted_flags(times: list[float], per_minute: int, per_hour: int, interval: float) -> list[bool]:
    """Which calls, in order of time, a limiter lets through: only those it admitted count against the next."""
    minute, hour, last, out = deque(), deque(), None, []
    for t in times:
        for held, span in ((minute, 60.0), (hour, 3600.0)):
            while held and held[0] <= t - span:
                held.popleft()
        ok = (last is None or t - last >= interval) and len(minute) < per_minute and len(hour) < per_hour
        if ok:
            minute.append(t)
            hour.append(t)
            last = t
        out.append(ok)
    return out


@dataclass(frozen=True)
class Limits:
    per_minute: int
    per_hour: int
    interval: float

    @property
    def memory(self) -> int:
        """Microseconds after which an admitted call counts against none."""
        return max(3_600_000_000, round(self.interval * 1e6))


def walked(times: np.ndarray, past: tuple[int, ...], limits: Limits) -> tuple[np.ndarray, tuple[int, ...]]:
    """(indices admitted, state after) of calls in order of time, in microseconds. The state is the admitted calls that
    still count; calls that are turned away change nothing, so the walk leaps from one admitted call to the next."""
    held, out, i = list(past), [], 0
    rules = [(1, round(limits.interval * 1e6)), (limits.per_minute, 60_000_000), (limits.per_hour, 3_600_000_000)]
    if min(limits.per_minute, limits.per_hour) < 1:
        return np.zeros(0, np.int64), past
    while i < len(times):
        free = max((held[-n] + span for n, span in rules if len(held) >= n), default=None)
        i = i if free is None else max(i, int(np.searchsorted(times, free)))
        if i < len(times):
            out.append(i)
            held.append(int(times[i]))
            held = held[-limits.per_hour :]
            i += 1
    end = int(times[-1]) if len(times) else 0
    return np.array(out, np.int64), tuple(t for t in held if not len(times) or t > end - limits.memory)


def _started(times: np.ndarray, starts: int, limits: Limits) -> set[tuple[int, ...]]:
    """States after ``times`` if the first call to count is one of ``starts`` calls; those that agree are one."""
    return {walked(times[at:], (), limits)[1] for at in {len(times) * n // starts for n in range(starts)} | {len(times)}}


def admission(df: DataFrame, key: str, ts: str, order: str, per_minute: int, per_hour: int, interval: float, pieces: int | None = None, starts: int = 8) -> DataFrame:
    """``(key, order, admitted)``. Admission depends on earlier ones, so calls are taken in order of time, ties by ``order``.

    All calls are dealt in ``pieces`` ranges of key and time. A key in one range is walked there. One that spans
    several is walked in parallel in time: each piece is entered with several states at once, those that
    walks from different calls of the last two hours before it lead to; which of them holds follows from
    piece to piece by looking states up. Where none does, that piece alone is walked again from its true
    state, before looking further: as many rounds as such pieces, none if histories forget, as they do
    wherever limits have room. A call without a time is not admitted; null keys are a key."""
    limits, spark = Limits(per_minute, per_hour, interval), df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("order"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    timeless = rows.filter("t is null").select("key", "order", F.lit(False).alias("admitted"))
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.filter("t is not null").repartitionByRange(pieces, "key", "t", "order").withColumn("piece", F.spark_partition_id()), "calls")
    held = dealt.groupBy("key", "piece").agg(F.min("t").alias("first"))
    several = held.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    chains: dict = {}
    for r in several.orderBy("key", "piece").collect():  # a key or two for each range
        chains.setdefault(r.key, []).append((r.piece, r.first))
    entries = _entries(dealt, chains, limits, starts) if chains else {}

    def flags(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t", "order"])
        past = tuple(own["past"].iloc[0]) if own["past"].iloc[0] is not None else ()
        admitted = np.zeros(len(own), bool)
        admitted[walked(own["t"].to_numpy(), past, limits)[0]] = True
        return own[["key", "order"]].assign(admitted=admitted)

    kind, order_kind = (rows.schema[c].dataType.simpleString() for c in ("key", "order"))
    known = spark.createDataFrame([(k, p, list(state)) for (k, p), state in entries.items()], f"k {kind}, p int, past array<long>")
    entered = dealt.join(F.broadcast(known), F.col("key").eqNullSafe(F.col("k")) & (F.col("piece") == F.col("p")), "left").drop("k", "p")
    found = entered.groupBy("key", "piece").applyInPandas(flags, f"key {kind}, `order` {order_kind}, admitted boolean")
    return found.unionByName(timeless).withColumnsRenamed({"key": key, "order": order})


def _entries(dealt: DataFrame, chains: dict, limits: Limits, starts: int) -> dict:
    """The state in which each piece of the keys in ``chains`` is entered. Of a piece, only states leave the tasks."""
    spark = dealt.sparkSession
    kind = dealt.schema["key"].dataType.simpleString()
    result = f"key {kind}, piece int, entry array<long>, after array<long>"

    def asked(wanted: list[tuple]) -> list:
        """Walk pieces ``(key, piece, lent, since, entry)``: from the given entry, or else from states of the calls since then in the piece ``lent``."""
        table = spark.createDataFrame(wanted, f"k {kind}, p int, lent int, since long, entry array<long>")
        on = F.col("key").eqNullSafe(F.col("k")) & ((F.col("piece") == F.col("p")) | ((F.col("piece") == F.col("lent")) & (F.col("t") >= F.col("since"))))
        some = dealt.filter(F.col("piece").isin(sorted({p for w in wanted for p in w[1:3]})))
        calls = some.join(F.broadcast(table), on).select("key", F.col("p").alias("piece"), "t", (F.col("piece") == F.col("p")).alias("own"), "entry")

        def walk(group: pd.DataFrame) -> pd.DataFrame:
            own, before = (np.sort(group.loc[group["own"] == x, "t"].to_numpy()) for x in (True, False))
            given = group["entry"].iloc[0]
            states = sorted(_started(before, starts, limits)) if given is None else [tuple(given)]
            found = [(group["key"].iloc[0], group["piece"].iloc[0], list(s), list(walked(own, s, limits)[1])) for s in states]
            return pd.DataFrame(found, columns=["key", "piece", "entry", "after"])

        return calls.groupBy("key", "piece").applyInPandas(walk, result).collect()

    known: dict = {(k, p): {} for k, chain in chains.items() for p, _ in chain}
    wanted = [(k, p, before, first - 2 * limits.memory, None) for k, chain in chains.items() for (before, _), (p, first) in zip(chain, chain[1:], strict=False)]
    answers = asked(wanted + [(k, chain[0][0], -1, 0, []) for k, chain in chains.items()])
    while True:
        for r in answers:
            known[r.key, r.piece][tuple(r.entry)] = tuple(r.after)
        entries, missing = {}, []
        for k, chain in chains.items():
            state: tuple[int, ...] = ()
            for p, first in chain:
                state = tuple(t for t in state if t > first - limits.memory)
                entries[k, p] = state
                match = {tuple(t for t in s if t > first - limits.memory): after for s, after in known[k, p].items()}
                if state not in match:
                    missing.append((k, p, -1, 0, list(state)))
                    break
                state = match[state]
        if not missing:
            return entries
        answers = asked(missing)
