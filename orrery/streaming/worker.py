"""Carrying out queued work: a loop that claims, works and settles, and a stream of arriving work."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import jobs as J
from orrery.scratch import Scratch


class Stop:
    """A request to stop, which also ends a pause."""

    def __init__(self) -> None:
        self._asked = threading.Event()

    def ask(self) -> None:
        self._asked.set()

    def __call__(self) -> bool:
        return self._asked.is_set()

    def wait(self, seconds: float) -> bool:
        """Pause; true, and at once, when a stop is asked for."""
        return self._asked.wait(seconds)


def loop(batch: Callable[[], int], *, stop: Callable[[], bool] | None = None, poll_seconds: float = 2.0, once: bool = False, wait: Callable[[float], bool | None] | None = None) -> int:
    """Run ``batch`` until told to stop: again at once while it took work, else after a pause; ``once`` ends after one batch. Gives the work done.

    A stop is asked for between batches and while pausing, never inside a
    batch: what is claimed is finished. ``wait`` gives true where the pause
    ended in a stop; by default it is that of ``stop``.
    """
    stop = stop or Stop()
    wait = wait or getattr(stop, "wait", None) or time.sleep
    done = 0
    while not stop():
        taken = batch()
        done += taken
        if once or (not taken and wait(poll_seconds)):
            break
    return done


def drain(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], *, now: Callable[[], object], asset_ids: DataFrame | None = None, limit: int = 1000, most: int = J.MOST_ATTEMPTS, scratch: Scratch | None = None) -> DataFrame:
    """All jobs once nothing more of the named assets' work is due.

    Each round claims up to ``limit`` due jobs, has ``work`` give an ``error``
    (null where it went well) for each claim (id, asset_id, model, lease_expires_at),
    and settles them; its table is written, so a lost executor rereads it. One
    loop at a time may change a table of jobs.
    """
    scratch = scratch or Scratch(jobs.sparkSession, "drain")
    now_of = lambda: F.lit(now()).cast("timestamp")
    round_ = 0
    jobs = scratch.table(jobs, "jobs-0")
    while True:
        mine = jobs if asset_ids is None else jobs.join(asset_ids.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
        at = now_of()
        claimed = scratch.table(J.claim(mine, now=at, limit=limit).select(*jobs.columns), f"claimed-{round_}")
        if claimed.isEmpty():
            return jobs
        held = J.upsert(jobs, claimed, ["id"])
        results = work(claimed.select("id", "asset_id", "model", "lease_expires_at")).select("id", "lease_expires_at", "error")
        jobs = scratch.table(J.settle(held, results, now=now_of(), most=most), f"jobs-{round_ + 1}")
        round_ += 1
