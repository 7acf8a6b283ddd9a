from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orrery.operators import jobs as J
from orrery.streaming import worker

JOBS = "id long, asset_id long, model string, status string, attempts int, available_at timestamp, lease_expires_at timestamp, last_error string, created_at timestamp, started_at timestamp, finished_at timestamp"
NOON = datetime(2024, 1, 1, 12)


def job(id_, asset, status="pending", attempts=0, due=NOON, lease=None):
    return (id_, asset, "m", status, attempts, due, lease, None, NOON - timedelta(days=1), None, None)


def test_a_loop_goes_on_at_once_while_there_is_work():
    taken, waits = iter([3, 2, 0, 1, 0]), []
    stops = iter([False] * 5 + [True])
    assert worker.loop(lambda: next(taken), stop=lambda: next(stops), wait=waits.append) == 6 and waits == [2.0, 2.0]
    left = iter([4, 0])
    assert worker.loop(lambda: next(left), once=True, wait=waits.append) == 4 and len(waits) == 2


def test_draining_retries_until_spent(spark):
    jobs = spark.createDataFrame([job(1, 1), job(2, 2), job(3, 3, due=NOON + timedelta(days=9)), job(4, 4, "running", 1, lease=NOON - timedelta(hours=1)), job(5, 9)], JOBS)
    clock = iter(NOON + timedelta(hours=i) for i in range(50))
    work = lambda claims: claims.withColumn("error", F.when(F.col("asset_id") == 2, "broken"))
    named = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    found = {r.id: r for r in worker.drain(jobs, work, now=lambda: next(clock), asset_ids=named, limit=2).collect()}
    assert {i: r.status for i, r in found.items()} == {1: "done", 2: "failed", 3: "pending", 4: "done", 5: "pending"}
    assert found[2].attempts == 3 and found[2].last_error == "broken" and found[4].lease_expires_at is None


def test_a_late_finish_changes_nothing(spark):
    lease = NOON + timedelta(minutes=5)
    jobs = spark.createDataFrame([job(1, 1, "running", 2, lease=lease)], JOBS)
    late = spark.createDataFrame([(1, NOON, None)], "id long, lease_expires_at timestamp, error string")
    now = F.lit(NOON)
    assert J.finish(jobs, late, now=now).first().status == "running" and J.settle(jobs, late, now=now).first().status == "running"
    assert J.settle(jobs, spark.createDataFrame([(1, lease, None)], late.schema), now=now).first().status == "done"


def test_an_asset_without_work_is_not_indexed(spark):
    jobs = spark.createDataFrame([job(1, 1, "done")], JOBS)
    found = {r.asset_id: r.indexed for r in J.work_report(jobs, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    assert found == {1: True, 2: False}
