"""Request limits as state over a log: a batch form for tables, a stateful processor for streams."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kbspark.session import scratch


class FixedWindow:
    """Failures in a window that opens at the first; blocked at `limit` until the window has passed."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window, self.started, self.count = limit, window, None, 0

    def step(self, now: float) -> tuple[bool, int]:
        if self.started is not None and self.count >= self.limit and (rest := self.window - (now - self.started)) > 0:
            return False, max(1, math.ceil(rest))
        if self.started is None or now - self.started >= self.window:
            self.started, self.count = now, 0
        self.count += 1
        return True, 0

    def dump(self) -> tuple:
        return self.started, [float(self.count)]

    def load(self, started: float | None, values: list[float]) -> None:
        self.started, self.count = started, int(values[0])


class SlidingWindow:
    """Admitted while fewer than `limit` admitted calls lie in the last `window`; refused calls do not count."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window, self.times = limit, window, deque()

    def step(self, now: float) -> tuple[bool, int]:
        while self.times and now - self.times[0] >= self.window:
            self.times.popleft()
        if self.limit <= 0:
            return False, max(1, math.ceil(self.window))
        if len(self.times) >= self.limit:
            return False, max(1, math.ceil(self.window - (now - self.times[0])))
        self.times.append(now)
        return True, 0

    def dump(self) -> tuple:
        return None, list(self.times)

    def load(self, started: float | None, values: list[float]) -> None:
        self.times = deque(values)


def _scan(kind: type, limit: int, window: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by client and time; one client's state is held at a time."""
        now, state = None, None
        for batch in batches:
            clients, times = batch.column("client").to_pylist(), batch.column("ts").to_pylist()
            out = []
            for client, ts in zip(clients, times):
                if state is None or client != now:
                    now, state = client, kind(limit, window)
                out.append(state.step(ts))
            ok, wait = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(wait, pa.int64())], [*batch.schema.names, "admitted", "retry_after"])

    return run


def limit_log(log: DataFrame, kind: type, limit: int, window: float) -> DataFrame:
    """log (client long, ts seconds, id) with admitted and retry_after, each client in time order.

    Sorting spills and the scan holds one client's state, so a client of any size is fine;
    one client's calls depend on one another and stay in one partition.
    """
    rows = log.select("client", "ts", "id").repartition("client").sortWithinPartitions("client", "ts", "id")
    return rows.mapInArrow(_scan(kind, limit, window), "client long, ts double, id long, admitted boolean, retry_after long")


# Clients are dealt to so many groups; a group's state is read and written as a whole.
GROUPS = 1024
CALL = np.dtype([("known", "?"), ("client", "<i8"), ("us", "<i8"), ("id", "<i8")])


class LimitProcessor(StatefulProcessor):
    """The same for streams: calls wait until the watermark has passed them, then are decided in order.

    State of a group of clients: what each client's limit holds, and the calls that wait, no more
    than come within the watermark's delay. A timer stands at the first of them. Once the
    watermark is there, no earlier call can come any more, so order across batches is settled.
    A client without waiting calls is forgotten `idle` seconds after its last call.
    """

    def __init__(self, kind: type, limit: int, window: float) -> None:
        self.make, self.idle_ms = (lambda: kind(limit, window)), math.ceil(window * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getValueState("clients", "known array<boolean>, client array<long>, started array<double>, held array<array<double>>, last array<long>")
        self.waiting = handle.getValueState("waiting", "calls binary")

    def _wake(self, at_ms: int, kept: list[int]) -> None:
        for old in kept:
            if old != at_ms:
                self.handle.deleteTimer(old)
        if at_ms not in kept:
            self.handle.registerTimer(at_ms)

    def _timers(self) -> list[int]:
        return [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]

    def _calls(self) -> np.ndarray:
        return np.frombuffer(self.waiting.get()[0], CALL) if self.waiting.exists() else np.empty(0, CALL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = [self._calls()]
        for frame in rows:
            some = np.empty(len(frame), CALL)
            for c in CALL.names:
                some[c] = frame[c].to_numpy()
            came.append(some)
        calls = np.concatenate(came)
        self.waiting.update((calls.tobytes(),))
        timers = self._timers()
        first = -(-int(calls["us"].min()) // 1000)
        # A timer that stands for waiting calls may be earlier; one for idle clients is later.
        self._wake(min([first, *timers]), timers)
        yield pd.DataFrame({"client": pd.Series(dtype="Int64"), "us": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "admitted": pd.Series(dtype="bool"), "retry_after": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        calls = self._calls()
        due, later = calls[calls["us"] <= now * 1000], calls[calls["us"] > now * 1000]
        due = due[np.lexsort((due["id"], due["us"], due["client"], due["known"]))]
        held: dict[tuple, tuple] = {}
        if self.clients.exists():
            for known, client, *state in zip(*self.clients.get()):
                held[known, client] = state
        admitted, wait = np.empty(len(due), bool), np.empty(len(due), np.int64)
        owner, limit, last = None, None, None
        keep = lambda: held.__setitem__(owner, [*limit.dump(), last])
        for i, (known, client, us, _) in enumerate(due.tolist()):
            if (known, client) != owner:
                if owner is not None:
                    keep()
                owner, limit = (known, client), self.make()
                if owner in held:
                    started, values, _ = held[owner]
                    limit.load(None if started is None or np.isnan(started) else started, list(values))
            admitted[i], wait[i] = limit.step(us / 1e6)
            last = us
        if owner is not None:
            keep()
        if len(later):
            self.waiting.update((later.tobytes(),))
        elif len(calls):
            self.waiting.clear()
        held = {c: x for c, x in held.items() if -(-x[2] // 1000) + self.idle_ms > now}
        if held:
            known, client = zip(*held)
            started, values, lasts = zip(*held.values())
            self.clients.update((list(known), list(client), [float("nan") if x is None else x for x in started], [[float(x) for x in v] for v in values], list(lasts)))
        elif self.clients.exists():
            self.clients.clear()
        wakes = [-(-int(later["us"].min()) // 1000)] if len(later) else [min(-(-x[2] // 1000) for x in held.values()) + self.idle_ms] if held else []
        if wakes:
            self.handle.registerTimer(max(now + 1, *wakes))
        if len(due):
            client = pd.array(due["client"], dtype="Int64")
            client[~due["known"]] = pd.NA
            yield pd.DataFrame({"client": client, "us": due["us"], "id": due["id"], "admitted": admitted, "retry_after": wait})

    def close(self) -> None:
        pass


DECIDED = "client long, us long, id long, admitted boolean, retry_after long"


def limit_stream(log: DataFrame, kind: type, limit: int, window: float, delay: str) -> DataFrame:
    """Decisions over a streaming log (client long, us microseconds, id), each client in (us, id) order.

    Calls may come late by `delay`, in any order and batch; later ones are dropped by the
    watermark. A call is decided once the watermark has passed it. Needs a state store that
    keeps several values a key (RocksDB).
    """
    group = F.pmod(F.xxhash64("client"), F.lit(GROUPS)).alias("group")
    timed = log.select(group, F.col("client").isNotNull().alias("known"), F.coalesce("client", F.lit(0)).alias("client"), "us", "id", F.timestamp_micros("us").alias("at")).withWatermark("at", delay)
    return timed.groupBy("group").transformWithStateInPandas(LimitProcessor(kind, limit, window), DECIDED, "Append", "EventTime")


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limit_files(spark: SparkSession, path: str, kind: type, limit: int, window: float, delay: str) -> DataFrame:
    """Run limit_stream over Parquet files of (client, us, id) below path, one a batch in the order written, and return what was decided.

    What waits when the files end is decided too: a last row of no client moves the watermark past everything.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    log = spark.read.schema("client long, us long, id long").parquet(f"{path}/*")
    end = log.agg(F.max("us").alias("us")).select(F.lit(None).cast("long").alias("client"), (F.coalesce("us", F.lit(0)) + 10**13).alias("us"), F.lit(-1).cast("long").alias("id"))
    end.coalesce(1).write.parquet(f"{path}/end")
    stream = spark.readStream.schema("client long, us long, id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out = scratch(spark)
    found = limit_stream(stream, kind, limit, window, delay).where("id >= 0")
    found.writeStream.format("parquet").option("path", f"{out}/decided").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(DECIDED).parquet(f"{out}/decided")
