"""Job records, stage caches and heartbeats as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "completed", "failed")
STAGES = ("ingest", "physical", "evidence", "layout", "semantic", "translate", "render", "index")
ALIVE_SECONDS = 15


def status_counts(jobs: DataFrame) -> DataFrame:
    """A row for each status, zeros included."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("n"), F.min("created").alias("oldest")), "status", "left").na.fill({"n": 0})


def claim_order(jobs: DataFrame, by: str) -> DataFrame:
    """Queued jobs of each workspace, oldest first, then by id."""
    w = Window.partitionBy(by).orderBy("created", "job_id")
    return jobs.where("status = 'queued'").withColumn("position", F.row_number().over(w).cast("long"))
