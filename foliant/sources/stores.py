"""Tables that outlive a run: the cache of calls, checkpoints as JSON files, and the log as text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CACHE = "cache_key string, translation string, tokens int"


class CacheTable:
    """A Parquet folder of answered calls; rows are only appended, and the least text of a key counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All rows; none if the folder isn't there yet or can't be read as a cache."""
        try:
            return self.spark.read.schema(CACHE).parquet(self.path).where("cache_key is not null and translation is not null")
        except AnalysisException:
            return self.spark.createDataFrame([], CACHE)

    def put(self, answers: DataFrame) -> None:
        """Appends rows with a translation: one atomic write, which may repeat keys that are there."""
        have = answers.where("cache_key is not null and translation is not null")
        count = F.ceil(F.char_length("translation") / 4).cast("int")
        have.select("cache_key", "translation", count.alias("tokens")).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], CACHE).write.mode("overwrite").parquet(self.path)


_FILE = (
    "job_id string, source_hash string, source_path string, saved_at timestamp, "
    "chapters array<struct<index:int,href:string,status:string,content:string,error:string>>"
)
JOBS_A_FILE = 500


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, source_hash, source_path, saved_at, idx, href, status, content, error) of the JSON files below a path, the latest of each job.

    A file holds one job as an object, in any layout, or one job a line, as write_checkpoints makes them. What can't be
    parsed or names no job is left out; jobs without a time are older than all others; a job without chapters gives no rows.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    one = raw.select(F.explode(F.split("value", r"\n(?=\{)")).alias("value")).select(F.from_json("value", _FILE, {"mode": "PERMISSIVE"}).alias("j"))
    good = one.where("j.job_id is not null")
    last = good.groupBy("j.job_id").agg(F.max(F.struct(F.col("j.saved_at").alias("saved_at"), F.col("j").alias("j"))).alias("last")).select("last.j.*")
    each = last.select("job_id", F.coalesce("source_hash", F.lit("")).alias("source_hash"), "source_path", "saved_at", F.explode("chapters").alias("c"))
    return each.select(
        "job_id", "source_hash", "source_path", "saved_at", F.col("c.index").alias("idx"), "c.href", F.coalesce("c.status", F.lit("pending")).alias("status"), F.encode("c.content", "UTF-8").alias("content"), "c.error"
    )


def write_checkpoints(checkpoints: DataFrame, path: str, saved_at: datetime | None = None) -> None:
    """Adds a save of the jobs to path, one JSON line a job: read_checkpoints of the same path gives the latest save of each job.

    A job's chapters are gathered, as the format demands. The write is one commit: a run that dies adds nothing.
    """
    chapter = F.struct(F.col("idx").alias("index"), "href", "status", F.decode("content", "UTF-8").alias("content"), "error")
    time = F.lit(saved_at) if saved_at else F.current_timestamp()
    jobs = checkpoints.groupBy("job_id", "source_hash", "source_path").agg(F.array_sort(F.collect_list(chapter), lambda a, b: a["index"] - b["index"]).alias("chapters"))
    jobs.withColumn("saved_at", time).write.mode("append").option("maxRecordsPerFile", JOBS_A_FILE).json(path)


def log_text(log: DataFrame) -> DataFrame:
    """(value): lines of (time, message, details) as an export writes them; write it with .text()."""
    time = F.concat(F.lit("["), F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "message")
    return log.select(F.when(F.coalesce("details", F.lit("")) != "", F.concat_ws("\n  ", time, "details")).otherwise(time).alias("value"))
