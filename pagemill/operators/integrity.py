"""Constraint queries: each gives rows of rule, category, severity, subject; integrity() is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue(rows: DataFrame, rule: str, severity: str, subject: Column, category: str = "STRUCTURE") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return issue(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), rule, "ERROR", F.col(key))


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str, rule: str, severity: str = "ERROR") -> DataFrame:
    known = targets.select(F.col(key).alias("_k")).distinct()
    return issue(rows.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("_k"), "left_anti"), rule, severity, F.col(ref))


def uncovered(required: DataFrame, covered: DataFrame, key: str, ratio: float = 0.95) -> DataFrame:
    """Missing ids: errors if under `ratio` is covered, else warnings; ids covered twice are errors."""
    counts = covered.groupBy(key).agg(F.count("*").alias("n"))
    rows = required.select(key).distinct().join(counts, key, "left")
    share = rows.agg((F.count("n") / F.count("*")).alias("share"))
    missing = rows.where("n IS NULL").crossJoin(F.broadcast(share))  # one row
    found = missing.select(F.lit("coverage").alias("rule"), F.lit("COVERAGE").alias("category"), F.when(F.col("share") < ratio, "ERROR").otherwise("WARNING").alias("severity"), F.col(key).cast("string").alias("subject"))
    return found.unionByName(issue(counts.where("n > 1"), "covered twice", "ERROR", F.col(key), "COVERAGE"))


def integrity(checks: list[DataFrame]) -> DataFrame:
    """Issues once for each rule and subject, with an id from their content."""
    rows = reduce(DataFrame.unionByName, checks).distinct()
    return rows.withColumn("issue_id", F.substring(F.sha2(F.concat_ws("\x1f", "rule", "category", "severity", "subject"), 256), 1, 32))
