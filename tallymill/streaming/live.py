"""Live counterparts of the roll-ups, as Structured Streaming transformations (all work on batch frames of the same shape too where they have no state)."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import BLOCK, PARTS, first_response_wins

LATE = "10 minutes"


_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: State in a store on the executors' disks, with a fixed part of their memory; a micro-batch writes down what it has changed.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.boundedMemoryUsage": "true", f"{_ROCKS}.maxMemoryUsageMB": "400", f"{_ROCKS}.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state on disk, so it may grow beyond the executors' memory."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    try:
        for k, v in ON_DISK.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedupe_event_stream(events: DataFrame, at: str = "occurred_at", late: str = LATE) -> DataFrame:
    """One event for each key, if its repeats come within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(["event_key"])


def minute_usage_stream(facts: DataFrame, at: str = "window_start", late: str = LATE) -> DataFrame:
    """Requests and tokens of each scope and UTC minute; rows may be signed (see window_moves)."""
    minute = F.window(at, "1 minute").alias("w")
    out = facts.withWatermark(at, late).groupBy(minute, "scope_id", "policy_id").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))
    return out.select(F.col("w.start").alias("minute"), "scope_id", "policy_id", "requests", "tokens")


def window_moves(moves: DataFrame) -> DataFrame:
    """Rows (scope_id, policy_id, requests, tokens, old_window, new_window) as facts: the old minute loses what the new one gains."""
    side = lambda window, sign: F.struct(F.col(window).alias("window_start"), (F.col("requests") * sign).alias("requests"), (F.col("tokens") * sign).alias("tokens"))
    both = moves.select("scope_id", "policy_id", F.explode(F.array(side("old_window", -1), side("new_window", 1))).alias("m"))
    return both.select("scope_id", "policy_id", "m.*").where("window_start IS NOT NULL")


def rolling_event_counts(events: DataFrame, at: str = "occurred_at", late: str = LATE, length: str = "15 minutes", step: str = "1 minute") -> DataFrame:
    w = F.window(at, length, step).alias("w")
    out = events.withWatermark(at, late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.end").alias("until"), "event_type", "n")


def rolling_latency(tasks: DataFrame, value: str = "seconds", at: str = "finished_at", late: str = LATE, length: str = "1 hour", step: str = "10 minutes") -> DataFrame:
    w = F.window(at, length, step).alias("w")
    out = tasks.withWatermark(at, late).groupBy(w).agg(F.count(value).alias("n"), F.percentile(value, F.array(*map(F.lit, (0.5, 0.95, 0.99)))).alias("p"))
    return out.select(F.col("w.end").alias("until"), "n", *(F.get("p", F.lit(k)).alias(f"p{q}") for k, q in enumerate((50, 95, 99))))


def live_progress_stream(responses: DataFrame, at: str = "created_at", late: str = LATE, block: int = BLOCK) -> DataFrame:
    """Sums of each run's blocks as responses with a position come in; the first of each (run, question) within the watermark counts."""
    first = responses.withWatermark(at, late).dropDuplicatesWithinWatermark(["run_id", "question_id"])
    return first.groupBy("run_id", F.expr(f"position div {block}").alias("block_index")).agg(*(F.expr(e).alias(k) for k, e in PARTS.items()))


class FirstResponses:
    """For foreachBatch over responses: a table in `path` of the first response of each (run, question), and what each epoch adds to the blocks' sums.

    The first epoch wins, inside it the first by time and id. The table takes the place of the stream's state, so a repeat is turned
    away however late it comes, and a first response is never too late. An epoch that is run again, after a loss
    between two micro-batches or in one, overwrites its own folders and sees earlier epochs alone, so it adds
    the same rows. Of the table only the buckets of the runs in the batch are read. The folder belongs to one query's checkpoint.
    """

    def __init__(self, path: str, buckets: int = 64, block: int = BLOCK):
        self.path, self.buckets, self.block = path, buckets, block

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark, keys = batch.sparkSession, ["run_id", "question_id"]
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(self.buckets)).cast("int")
        rows = first_response_wins(batch).withColumn("bucket", bucket).persist()
        new = rows
        if epoch:
            here = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
            stored = spark.read.schema(rows.withColumn("epoch", F.lit(0).cast("long")).schema).parquet(f"{self.path}/responses")
            known = stored.where((F.col("epoch") < epoch) & F.col("bucket").isin(here)).select(*(F.col(k).alias(f"known_{k}") for k in keys))
            new = rows.join(known, [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys], "left_anti")
        mine = f"{self.path}/responses/epoch={epoch}"
        # few files a bucket, and still several tasks for the bucket of a hot run
        dealt = new.repartition("bucket", F.pmod(F.xxhash64("question_id"), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(mine)
        rows.unpersist()
        added = spark.read.schema(rows.schema).parquet(mine)
        sums = added.groupBy("run_id", F.expr(f"position div {self.block}").alias("block_index")).agg(*(F.expr(e).alias(k) for k, e in PARTS.items()))
        sums.write.mode("overwrite").parquet(f"{self.path}/blocks/epoch={epoch}")

    def progress(self, spark: SparkSession) -> DataFrame:
        """The sums of each run's blocks over the epochs that have come."""
        return spark.read.parquet(f"{self.path}/blocks").groupBy("run_id", "block_index").agg(*(F.sum(k).alias(k) for k in PARTS))


class LateRows(StreamingQueryListener):
    """Adds up, over every micro-batch, the rows that stateful operators turn away because they come after the watermark.

    For use around a query: `with LateRows(spark) as late: ...`; late.of(query) waits until the query's end has been told.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.ended = spark, Counter(), defaultdict(threading.Event)

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        self.rows[str(event.progress.runId)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.ended[str(event.runId)].set()

    def of(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """Of a query that has ended."""
        if not self.ended[str(query.runId)].wait(wait):
            raise TimeoutError("the query's end has not been told")
        return self.rows[str(query.runId)]


def micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _alerts(hold_us: int, forget_us: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fired, seen, waiting = state.get if state.exists else (None, False, None, b"")
        # a sample is one number, twice its time and its value, so their order is that of time, false before true
        parts = [np.frombuffer(bytes(waiting), np.int64)]
        if not state.hasTimedOut:
            parts += [micros(b["at"]) * 2 + b["value"].to_numpy(bool) for b in batches]
        samples, mark = np.sort(np.concatenate(parts)), state.getCurrentWatermarkMs()
        settled = int(np.searchsorted(samples, (mark - 1) * 2000 + 1, "right"))
        at, value, rest = samples[:settled] >> 1, (samples[:settled] & 1).astype(bool), samples[settled:]
        out = []
        if len(at):
            apart = np.diff(at, prepend=at[0] if seen is None else seen) > (forget_us if forget_us is not None else np.iinfo(np.int64).max - 1)
            edges = np.flatnonzero(np.diff(value, prepend=not value[0]) | apart)
            for a, b in zip(edges, [*edges[1:], len(at)]):  # stretches of one value
                if apart[a] or not value[a]:
                    since, fired = None, False
                if not value[a]:
                    continue
                since = int(at[a]) if since is None else since
                held = a + int(np.searchsorted(at[a:b], since + hold_us))
                if not fired and held < b:
                    fired = True
                    out.append((key[0], stamp(since), stamp(int(at[held]))))
            seen = int(at[-1])
        over = None if forget_us is None or seen is None else (seen + forget_us) // 1000 + 1
        if over is not None and over < mark:
            since, fired = None, False
        if since is None and not len(rest):
            if state.exists:
                state.remove()
        else:
            state.update((since, fired, seen, rest.tobytes()))
            due = -(-int(rest[0] >> 1) // 1000) if len(rest) else over
            if due is not None:
                state.setTimeoutTimestamp(max(due, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["alert", "since", "fired_at"])

    return step


def alert_stream(samples: DataFrame, hold_s: int, late: str = LATE, forget_s: int | None = None) -> DataFrame:
    """(alert, since, fired_at) once a condition (alert, at, value) has held for hold_s, in the order of the samples' times, whatever the order they come in.

    Samples wait in the state until the watermark has passed them, timers see to alerts without new ones, and what comes
    later than `late` is turned away. An unknown value is not true; of samples of one time the true ones come last; a
    sample without a time is left out. With forget_s a stretch is over when no sample came for so long. State: the waiting
    samples of each alert, 8 bytes each, and a row for each alert that holds.
    """
    rows = samples.where("at IS NOT NULL").withWatermark("at", late).select("alert", "at", F.coalesce("value", F.lit(False)).alias("value"))
    step = _alerts(hold_s * 1_000_000, None if forget_s is None else forget_s * 1_000_000)
    return rows.groupBy("alert").applyInPandasWithState(step, "alert STRING, since TIMESTAMP, fired_at TIMESTAMP", "since LONG, fired BOOLEAN, seen LONG, waiting BINARY", "append", GroupStateTimeout.EventTimeTimeout)


def joined_stretches(stretches: list[tuple[int, int, bool]], times: np.ndarray, stopped: np.ndarray, most: int) -> list[tuple[int, int, bool]]:
    """Disjoint stretches (first, last, whether the last sign is a stop) with more signs: what lies at most `most` apart is one stretch."""
    order = np.lexsort((stopped, times))
    times, stopped = times[order], stopped[order]
    cuts = np.flatnonzero(np.diff(times) > most) + 1
    new = [(int(t[0]), int(t[-1]), bool(s[-1])) for t, s in zip(np.split(times, cuts), np.split(stopped, cuts)) if len(t)]
    out: list[tuple[int, int, bool]] = []
    for first, last, stop in sorted(stretches + new):
        if out and first - out[-1][1] <= most:
            last, stop = max(out[-1][1:], (last, stop))
            first = out.pop()[0]
        out.append((first, last, stop))
    return out


def _stalls(stale_us: int):
    names = ["worker_id", "status", "at"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [(*state.get, False)] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "stalled", stamp(known[0][1]))], columns=names)
            return
        stretches = known  # the signs fold into few stretches, batch by batch and in any order
        for b in batches:
            stretches = joined_stretches(stretches, micros(b["at"]), b["stopped"].to_numpy(bool), stale_us)
        out = []
        for k, (first, last, stop) in enumerate(stretches):
            if not known or not first <= known[0][0] <= last:
                out.append((key[0], "live", stamp(first)))
            if stop or k < len(stretches) - 1:
                out.append((key[0], "stopped" if stop else "stalled", stamp(last)))
        first, last, stop = stretches[-1]
        if not stop:
            state.update((first, last))
            state.setTimeoutTimestamp(max((last + stale_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    return step


def stalled_workers_stream(beats: DataFrame, stale_s: int, late: str = LATE) -> DataFrame:
    """(worker_id, status, at) of each stretch of signs with no gap above stale_s: live at its first sign; at its last one stopped
    if that says so, else stalled, once a later sign or the watermark is more than stale_s past it. State: one stretch a worker."""
    rows = beats.withWatermark("at", late).select("worker_id", "at", "stopped")
    return rows.groupBy("worker_id").applyInPandasWithState(_stalls(stale_s * 1_000_000), "worker_id LONG, status STRING, at TIMESTAMP", "first LONG, last LONG", "append", GroupStateTimeout.EventTimeTimeout)


def _states(terminal: tuple[str, ...]):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = place = state.get if state.exists else (-1, -1, None)
        for b in batches:  # the earliest terminal event, else the latest of all, is kept from batch to batch
            rows = list(zip(micros(b["occurred_at"]).tolist(), b["event_id"].tolist(), b["event_type"].tolist()))
            ends = [r for r in rows if r[2] in terminal]
            if place[2] in terminal:
                place = min([*ends, place])
            else:
                place = min(ends) if ends else max([*rows, place], key=lambda r: (r[0], r[1], r[2] or ""))
        state.update(tuple(place))
        if tuple(place) != tuple(before):
            yield pd.DataFrame([(key[0], place[2], stamp(place[0]))], columns=["run_id", "state", "since"])

    return step


def run_state_stream(events: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """(run_id, state, since) whenever a run's state changes; the earliest terminal event absorbs the rest, in whatever order they come."""
    rows = events.select("run_id", "occurred_at", "event_id", "event_type")
    return rows.groupBy("run_id").applyInPandasWithState(_states(terminal), "run_id LONG, state STRING, since TIMESTAMP", "at LONG, event_id LONG, kind STRING", "update", GroupStateTimeout.NoTimeout)
