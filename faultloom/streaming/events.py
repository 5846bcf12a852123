"""Stateful behaviour over arriving failures, as Structured Streaming."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultloom.session import Scratch


def sent_times(at: np.ndarray, last: int | None, window: int) -> tuple[np.ndarray, int | None]:
    """Which of the ascending times are sent: none within ``window`` of the last one sent.

    Suppressed events do not extend the window, so each step jumps to the next event that may be
    sent instead of visiting those between.
    """
    out, i = [], 0
    while True:
        if last is not None:
            i = max(i, int(np.searchsorted(at, last + window, "left")))
        if i >= len(at):
            return np.array(out, np.int64), last
        out.append(i)
        last = int(at[i])
        i += 1


def deduplicated(stream: DataFrame, window_seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """``(event, fingerprint, at, id)`` of events to send: one of an event and fingerprint is
    suppressed while less than the window has passed since the last one sent; 0 sends all.

    Input is ``(event, fingerprint, at timestamp, id long)``. State is one time per key and leaves
    once the watermark has passed its window.
    """
    out = "event string, fingerprint string, at timestamp, id long"
    if window_seconds <= 0:
        return stream.select("event", "fingerprint", "at", "id")
    window = window_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        at = pdf["at"].astype("datetime64[us, UTC]" if pdf["at"].dt.tz is not None else "datetime64[us]").astype("int64").to_numpy()
        keep, last = sent_times(at, state.get[0] if state.exists else None, window)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(last // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if len(keep):
            yield pdf.iloc[keep][["event", "fingerprint", "at", "id"]]

    return stream.withWatermark("at", delay).groupBy("event", "fingerprint").applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def only_events(stream: DataFrame, events: set[str]) -> DataFrame:
    """An empty set lets all events pass; names are compared without dashes and case."""
    plain = [e.replace("-", "").lower() for e in events]
    return stream.where(F.lower(F.replace("event", F.lit("-"), F.lit(""))).isin(plain)) if plain else stream


def run_to_table(stream: DataFrame, scratch: Scratch) -> DataFrame:
    """Run an append-mode stream over what is available and return its output as a table."""
    path = f"{scratch.root}/stream"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return scratch.spark.read.schema(stream.schema).parquet(f"{path}/out")


def daily_counts(stream: DataFrame, scratch: Scratch, time: str = "analyzed_at", delay: str = "30 days") -> DataFrame:
    """``(day, n)`` of UTC days, kept up to date while rows arrive up to ``delay`` late."""
    path = f"{scratch.root}/daily"
    agg = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")

    def write(df: DataFrame, no: int) -> None:
        df.write.mode("overwrite").parquet(path)  # one row a day

    agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return scratch.spark.read.parquet(path)


def blocks_before(no: int) -> list[tuple[int, int]]:
    """The fewest blocks of 2^k aligned batches that hold the batches 0 to no - 1."""
    out, at = [], 0
    while at < no:
        size = 1 << ((no - at).bit_length() - 1)
        out.append((at, at + size))
        at += size
    return out


def recurrence(stream: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, event)`` of arriving rows ``(id, fingerprint)``: ``new-failure`` for a fingerprint's
    first row in id order of its batch, else ``recurrence``. What was seen is kept in blocks of
    2^k batches, merged like a binary counter, so a batch reads at most log2 of them; batches are
    idempotent, each writes under its own number."""
    path, spark = f"{scratch.root}/recurrence", scratch.spark

    def write(df: DataFrame, no: int) -> None:
        first = df.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
        earlier = [f"{path}/seen/{a}-{b}" for a, b in blocks_before(no)]
        seen = spark.read.parquet(*earlier) if earlier else spark.createDataFrame([], "fingerprint string")
        first = first.join(seen.withColumn("seen", F.lit(True)), "fingerprint", "left")
        event = F.when(F.col("seen") | (F.col("id") > F.col("first_id")), "recurrence").otherwise("new-failure")
        df.join(first, "fingerprint").select("id", event.alias("event")).write.mode("overwrite").parquet(f"{path}/out/batch={no}")
        first.where("seen IS NULL").select("fingerprint").write.mode("overwrite").parquet(f"{path}/seen/{no}-{no + 1}")
        size = 2
        while (no + 1) % size == 0:
            a = no + 1 - size
            parts = spark.read.parquet(f"{path}/seen/{a}-{a + size // 2}", f"{path}/seen/{a + size // 2}-{no + 1}")
            parts.coalesce(max(1, parts.rdd.getNumPartitions() // 2)).write.mode("overwrite").parquet(f"{path}/seen/{a}-{no + 1}")
            size *= 2

    stream.select("id", "fingerprint").writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long, event string").parquet(f"{path}/out").select("id", "event")


def deliver(stream: DataFrame, send: Callable[[dict], None], scratch: Scratch) -> DataFrame:
    """Hand every row of an append-mode stream to ``send``, wherever it lies; a channel that fails
    for one event does not hold up the others. Rows may come again after a failure, so ``send``
    should be idempotent. What could not be sent comes back as ``(event json, error)``."""
    path = f"{scratch.root}/undelivered"

    def each(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            lost = []
            for r in pdf["event"]:
                try:
                    send(json.loads(r))
                except Exception as x:  # noqa: BLE001
                    lost.append((r, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(lost, columns=["event", "error"])

    def write(df: DataFrame, no: int) -> None:
        df.select(F.to_json(F.struct(*df.columns)).alias("event")).mapInPandas(each, "event string, error string").write.mode("overwrite").parquet(f"{path}/{no}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{scratch.root}/deliver").trigger(availableNow=True).start()
    q.awaitTermination()
    return scratch.spark.read.schema("event string, error string").option("recursiveFileLookup", "true").parquet(path)


class Budget:
    """At most ``per_run`` calls in all and ``per_minute`` within any 60 seconds."""

    def __init__(self, per_run: int | None = None, per_minute: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.per_run, self.per_minute, self.clock = per_run, per_minute, clock
        self.used = 0
        self.recent: deque[float] = deque()

    def take(self) -> bool:
        now = self.clock()
        while self.recent and now - self.recent[0] >= 60:
            self.recent.popleft()
        if (self.per_run is not None and self.used >= self.per_run) or (self.per_minute is not None and len(self.recent) >= self.per_minute):
            return False
        self.used += 1
        self.recent.append(now)
        return True


def limited(ask: Callable[[str], object], budget: Budget, chars: int = 6000) -> Callable[[str], object]:
    """``ask`` within a budget and on at most the last ``chars`` characters; None beyond it."""
    return lambda text: ask(text[-chars:]) if budget.take() else None
