"""Job log: state changes, final states, retries and rejected requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.operators.ordered import neighbors

TERMINAL = ("complete", "failed", "cancelled")
ATTEMPTS = 3


def status_changes(events: DataFrame, order: str, payload: list[str], block: DataFrame | None = None) -> DataFrame:
    """Events whose payload differs from the previous one, up to the first terminal event of a job."""
    end = events.where(F.col("status").isin(*TERMINAL)).groupBy("job_id").agg(F.min(order).alias("_end"))
    live = events.join(end, "job_id", "left").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")
    near = neighbors(live, ["job_id"], order, payload, before="_prev", block=block)
    return near.where(~F.struct(*payload).eqNullSafe(F.col("_prev"))).drop("_prev")


def lifecycle(events: DataFrame, order: list[str]) -> DataFrame:
    """Final state of each job with its start (first running event) and completion (last terminal event)."""
    def at(condition: Column) -> Column:
        return F.when(condition, F.col("ts"))

    last = F.struct("status", "progress")
    return events.groupBy("job_id").agg(
        F.max_by(last, F.struct(*order)).alias("_last"),
        F.min(at(F.col("status") == "running")).alias("started_at"),
        F.max(at(F.col("status").isin(*TERMINAL))).alias("completed_at"),
        F.count("*").alias("events"),
    ).select("job_id", "_last.*", "started_at", "completed_at", "events")


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Running jobs go back to the queue, or fail once their attempts are used up."""
    running = F.col("status") == "running"
    spent = running & (F.col("attempts") >= ATTEMPTS)
    return jobs.withColumns({
        "status": F.when(spent, "failed").when(running, "queued").otherwise(F.col("status")),
        "stage": F.when(spent, "failed").when(running, "queued-after-restart").otherwise(F.col("stage")),
        "progress": F.when(running, 0).otherwise(F.col("progress")),
        "error_code": F.when(spent, "IMPORT_INTERRUPTED").when(~running, F.col("error_code")),
    })


def quarantine(requests: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with the reason."""
    checked = requests.withColumn("error", error)
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")
