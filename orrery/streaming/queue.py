"""The leased queue as a stream: each job is a keyed state, and timers end leases and waits.

Events (what is queued, what came of a claim) arrive as files. A job that is
due is leased at once and given out; a lease that ends without a result, and a
wait that is over, come due by a timer of the cluster's clock, so no event can
come too late to be looked at. The checkpoint has all states and timers: a
restart goes on where the stream ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orrery.operators.jobs import MOST_ATTEMPTS
from orrery.scratch import ship

#: ``kind``: queued (asset_id, model, available_at) or result (token, error).
EVENTS = "job long, kind string, asset_id long, model string, available_at timestamp, token timestamp, error string"
#: A job as it stands after ``change`` (queued, claimed, expired, retried, done, failed).
CHANGES = "id long, asset_id long, model string, status string, attempts int, available_at timestamp, lease_expires_at timestamp, last_error string, created_at timestamp, started_at timestamp, finished_at timestamp, change string, at timestamp"
STATE = "asset_id long, model string, status string, attempts int, available long, lease long, error string, created long, started long, finished long"
_NAMES = ("asset_id", "model", "status", "attempts", "available", "lease", "error", "created", "started", "finished")
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(value) -> int | None:
    return None if value is None or pd.isna(value) else int(pd.Timestamp(value).value // 1000)


def _time(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros * 1000)


class Job(StatefulProcessor):
    """One job: its row is the state, one timer at a time ends its lease or its wait."""

    def __init__(self, lease_seconds: float, wait_seconds: float, most: int):
        self.lease, self.wait, self.most = int(lease_seconds * 1_000_000), int(wait_seconds * 1_000_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, now = [], timerValues.getCurrentProcessingTimeInMs() * 1000
        for event in pd.concat(rows).sort_values("kind", kind="stable").itertuples():  # queued before result
            out += self._queued(key[0], event, now) if event.kind == "queued" else self._result(key[0], event, now)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, now, out = self._job(), timerValues.getCurrentProcessingTimeInMs() * 1000, []
        if job and job["status"] == "running" and job["lease"] <= now:
            out.append((key[0], job, "expired", now))
            out += self._claim(key[0], job, now)
        elif job and job["status"] == "pending" and job["available"] <= now:
            out += self._claim(key[0], job, now)
        yield _frame(out)

    def _job(self) -> dict | None:
        return dict(zip(_NAMES, self.row.get(), strict=True)) if self.row.exists() else None

    def _keep(self, job: dict, timer: int | None) -> None:
        self.row.update(tuple(job[n] for n in _NAMES))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if timer is not None:
            self.handle.registerTimer(-(-timer // 1000))

    def _queued(self, key: int, event, at: int) -> list[tuple]:
        if self.row.exists():  # told again: a batch that was run twice
            return []
        available = at if _micros(event.available_at) is None else _micros(event.available_at)
        job = dict(zip(_NAMES, (int(event.asset_id), event.model, "pending", 0, available, None, None, at, None, None), strict=True))
        if available <= at:
            return [(key, job, "queued", at), *self._claim(key, job, at)]
        self._keep(job, available)
        return [(key, job, "queued", at)]

    def _claim(self, key: int, job: dict, now: int) -> list[tuple]:
        job = job | {"status": "running", "attempts": job["attempts"] + 1, "lease": now + self.lease, "started": now}
        self._keep(job, job["lease"])
        return [(key, job, "claimed", now)]

    def _result(self, key: int, event, at: int) -> list[tuple]:
        job = self._job()
        if not job or job["status"] != "running" or job["lease"] != _micros(event.token):
            return []  # late: the lease has ended and is another's
        error = None if event.error is None or pd.isna(event.error) else event.error
        job = job | {"lease": None, "error": error}
        if error is None or job["attempts"] >= self.most:
            job |= {"status": "done" if error is None else "failed", "finished": at}
            self._keep(job, None)
            return [(key, job, job["status"], at)]
        job |= {"status": "pending", "started": None, "available": at + self.wait * 2 ** max(1, job["attempts"])}
        self._keep(job, job["available"])
        return [(key, job, "retried", at)]

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in CHANGES.split(", ")]
    made = [
        (key, j["asset_id"], j["model"], j["status"], j["attempts"], _time(j["available"]), _time(j["lease"]), j["error"], _time(j["created"]), _time(j["started"]), _time(j["finished"]), change, _time(at))
        for key, j, change, at in rows
    ]
    frame = pd.DataFrame(made, columns=names)
    return frame.astype({n: "datetime64[ns]" for n in names if n.endswith("_at") or n == "at"})


def changes(events: DataFrame, *, lease_seconds: float = 300, wait_seconds: float = 10, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The changes of all jobs that a stream of ``events`` brings about, in append mode.

    A result holds only under the lease that it names; one for a job that is
    unknown, or a job queued twice, changes nothing. After a failure a job waits
    ``wait_seconds``, doubled with each attempt. A hot asset is many jobs, so keys spread.
    """
    ship(events.sparkSession)
    return events.groupBy("job").transformWithStateInPandas(Job(lease_seconds, wait_seconds, most), CHANGES, "append", "processingTime")


def serve(
    spark: SparkSession,
    folder: str,
    work: Callable[[DataFrame], DataFrame],
    *,
    lease_seconds: float = 300,
    wait_seconds: float = 10,
    most: int = MOST_ATTEMPTS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the queue over ``folder``: events in ``events``, state in ``checkpoint``, changes by batch in ``changes``.

    ``work`` takes a batch's claims (id, asset_id, model, lease_expires_at) and
    gives id, lease_expires_at and ``error`` (null where it went well); the
    results are events of a later batch. A batch writes under its number, so
    one that is run again replaces what it wrote, and a result that comes
    twice finds its lease ended.
    """
    provider, name = STORE[1], STORE[0]
    spark.conf.set(name, provider)
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
    none = F.lit(None)

    def carry_out(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        written = batch.sparkSession.read.schema(CHANGES).parquet(f"{folder}/changes/batch={number}")
        # A claim whose lease has ended within the same batch is another's already.
        claims = written.where("change = 'claimed'").groupBy("id").agg(F.max_by(F.struct("asset_id", "model", "lease_expires_at"), "lease_expires_at").alias("c")).select("id", "c.*")
        if claims.isEmpty():
            return
        results = work(claims).select(F.col("id").alias("job"), F.lit("result").alias("kind"), none.cast("long").alias("asset_id"), none.cast("string").alias("model"), none.cast("timestamp").alias("available_at"), F.col("lease_expires_at").alias("token"), "error")
        results.write.mode("overwrite").parquet(f"{folder}/events/results-{number}")

    found = changes(stream, lease_seconds=lease_seconds, wait_seconds=wait_seconds, most=most)
    return found.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"processingTime": "2 seconds"})).foreachBatch(carry_out).start()


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """All jobs as the last change left them."""
    found = spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    rank = F.struct("at", F.col("attempts"), F.when(F.col("change") == "queued", 0).when(F.col("change") == "expired", 1).otherwise(2))
    names = [c.split()[0] for c in CHANGES.split(", ")][:-2]
    last = found.groupBy("id").agg(F.max_by(F.struct(*names[1:]), rank).alias("job"))
    return last.select("id", "job.*")
