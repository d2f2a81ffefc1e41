"""Checkpoints: what is done, what is left, and what is put back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key, the latest by a time; ties by the row's own values. An aggregate, so no key's rows meet in one sort."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(by), F.hash(*[F.col(c).cast("string") for c in rest]))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def valid(checkpoints: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose source hash is empty or still that of the job's source. sources: (job_id, current_hash)."""
    return checkpoints.join(sources, "job_id").where("source_hash = '' or source_hash = current_hash").drop("current_hash")


def flagged(checkpoints: DataFrame, sources: DataFrame) -> DataFrame:
    """checkpoints + matches_current_source: whether the stored hash is that of the job's source now; false without one."""
    same = F.coalesce(F.col("source_hash") == F.col("current_hash"), F.lit(False))
    return checkpoints.join(sources, "job_id", "left").withColumn("matches_current_source", same).drop("current_hash")


def pending(wanted: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """wanted (job_id, idx) without the completed ones."""
    done = checkpoints.where("status = 'completed'").select("job_id", "idx").distinct()
    return wanted.join(done, ["job_id", "idx"], "left_anti")


def backfill(wanted: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(job_id, idx, status): the checkpoint's rows, and pending ones for what it lacks."""
    have = checkpoints.select("job_id", "idx", "status")
    lacking = wanted.select("job_id", "idx").join(have, ["job_id", "idx"], "left_anti").withColumn("status", F.lit("pending"))
    return have.unionByName(lacking)


def restore(wanted: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """wanted (job_id, idx, content) with the stored content of completed chapters that have one."""
    done = checkpoints.where("status = 'completed'").select("job_id", "idx", F.col("content").alias("stored"))
    return wanted.join(done, ["job_id", "idx"], "left").withColumn("restored", F.col("stored").isNotNull()).withColumn("content", F.coalesce("stored", "content")).drop("stored")


def summary(checkpoints: DataFrame) -> DataFrame:
    """(job_id, completed, failed, total, pending) of each job."""
    done, bad = (F.sum((F.col("status") == s).cast("long")) for s in ("completed", "failed"))
    out = checkpoints.groupBy("job_id").agg(done.alias("completed"), bad.alias("failed"), F.count("*").alias("total"))
    return out.withColumn("pending", F.greatest(F.col("total") - F.col("completed") - F.col("failed"), F.lit(0)))


def failures(results: DataFrame) -> DataFrame:
    """(job_id, failed, total, all_failed, hrefs): failed chapters in order. results: (job_id, idx, href, status)."""
    bad = F.col("status") == "failed"
    hrefs = F.array_sort(F.collect_list(F.when(bad, F.struct("idx", "href"))))
    return results.groupBy("job_id").agg(
        F.sum(bad.cast("long")).alias("failed"), F.count("*").alias("total"), F.array_join(F.transform(hrefs, lambda h: h["href"]), ", ").alias("hrefs")
    ).withColumn("all_failed", F.col("failed") == F.col("total"))
