import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.streaming import queue as Q
from orrery.streaming import worker

NOON = datetime(2024, 1, 1, 12)


class Served:
    """A queue over a folder; ``work`` answers with what ``results`` says for a job, in turn, or not at all."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.results, self.claims, self.told, self.query = spark, str(folder), {}, [], 0, None

    def tell(self, *events):
        names = [c.split()[0] for c in Q.EVENTS.split(", ")]
        self.told += 1
        self.spark.createDataFrame([tuple(e.get(n) for n in names) for e in events], Q.EVENTS).coalesce(1).write.parquet(f"{self.folder}/events/told-{self.told}")

    def work(self, claims):
        rows = [tuple(r) for r in claims.select("id", "lease_expires_at").collect()]
        self.claims += rows
        done = [(i, token, self.results[i].pop(0)) for i, token in rows if self.results.get(i)]
        return self.spark.createDataFrame(done, "id long, lease_expires_at timestamp, error string")

    def start(self):
        before = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", "1")  # a worker for each partition of the state is started in every batch
        self.query = Q.serve(self.spark, self.folder, self.work, lease_seconds=12, wait_seconds=1, trigger={"processingTime": "1 second"})
        self.spark.conf.set("spark.sql.shuffle.partitions", before)

    def jobs(self):
        return {r.id: r for r in Q.jobs(self.spark, self.folder).collect()} if (Path(self.folder) / "changes").exists() else {}

    def until(self, holds, seconds=240):
        end = time.time() + seconds
        while time.time() < end:
            if self.query.exception():
                raise self.query.exception()
            if holds(found := self.jobs()):
                return found
            time.sleep(0.5)
        raise AssertionError(self.jobs())


def queued(job, available=None):
    return {"job": job, "kind": "queued", "asset_id": job * 10, "model": "m", "available_at": available}


def test_leases_and_waits_end_by_timers_across_restarts(spark, tmp_path):
    served = Served(spark, tmp_path)
    served.results = {2: [None], 3: ["broken", "broken", "broken"], 4: [None]}
    later = datetime.now() + timedelta(seconds=25)
    served.tell(queued(1), queued(2), queued(3), queued(4, later), queued(1))
    served.start()
    try:
        found = served.until(lambda j: len(j) == 4 and j[2].status == "done")
        assert found[2].attempts == 1 and found[2].finished_at >= found[2].started_at and found[2].lease_expires_at is None
        assert found[4].status == "pending" or datetime.now() >= later
        assert [i for i, _ in served.claims].count(2) == 1
        first = next(token for i, token in served.claims if i == 1)
        served.query.stop()
        served.start()  # leases and waits go on from the checkpoint
        found = served.until(lambda j: j[1].attempts >= 2 and j[3].status == "failed" and j[4].status == "done")
        assert found[3].attempts == 3 and found[3].last_error == "broken" and found[1].status == "running"
        assert found[4].started_at >= later and [i for i, _ in served.claims].count(3) == 3
        served.tell({"job": 1, "kind": "result", "token": first}, {"job": 9, "kind": "result", "token": first})  # too late; unknown
        seen = served.query.lastProgress["batchId"]
        served.until(lambda j: served.query.lastProgress["batchId"] > seen + 2)
        found = served.jobs()
        assert found[1].status == "running" and 9 not in found
        served.results[1] = [None]  # the next claim is answered
        found = served.until(lambda j: j[1].status == "done")
        assert found[1].attempts >= 3
    finally:
        served.query.stop()
    assert len(served.claims) == len(set(served.claims))


def test_one_batch_and_a_pause_that_a_stop_ends():
    left = iter([4, 3, 0])
    assert worker.loop(lambda: next(left), once=True) == 4
    stop, calls = worker.Stop(), []

    def batch():
        calls.append(1)
        if len(calls) == 2:
            stop.ask()
        return 2

    assert worker.loop(batch, stop=stop) == 4
    stop = worker.Stop()

    def idle():
        stop.ask()  # as a signal does while the loop is idle
        return 0

    begun = datetime.now()
    assert worker.loop(idle, stop=stop, poll_seconds=60) == 0 and datetime.now() - begun < timedelta(seconds=5)
    assert worker.loop(pytest.fail, stop=stop) == 0


def test_a_claim_starts_its_job(spark):
    from orrery.operators import jobs as J
    from tests.test_worker import JOBS, job

    found = J.claim(spark.createDataFrame([job(1, 1)], JOBS), now=F.lit(NOON), limit=5).first()
    assert found.started_at == NOON and found.status == "running"
