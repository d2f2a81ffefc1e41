"""Progress of tasks: the fold of their events, in batch; `streaming.progress` has the same fold over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(total: Column, completed: Column, in_flight: Column) -> Column:
    """0 to 100, rounded down; 0 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) <= 0, 0).otherwise(F.floor(F.least((completed + in_flight) * 100 / total, F.lit(100.0)))).cast("int")


def remap(value: Column, offset: float, scale: float) -> Column:
    """A stage's percent as part of the whole."""
    return F.least(F.greatest(F.round(value * scale + offset), F.lit(0)), F.lit(100)).cast("int")


def fold(events: DataFrame) -> DataFrame:
    """(task_id, total, completed, progress) of (task_id, seq, event, total, chunk_index, chunk_total).

    What counts is what follows the last start: a task's state is an aggregate of three passes' partial sums, so no task's
    events are gathered, and a task with a third of all events needs no sort of them.
    """
    starts = events.where("event = 'Started'").groupBy("task_id").agg(F.max("seq").alias("since"), F.max_by("total", "seq").alias("t"))
    live = events.join(starts, "task_id", "left").where("since is null or seq >= since")
    done = F.sum(F.when(F.col("event") == "ChapterFinished", 1).otherwise(0)).alias("completed")
    last_event = F.max_by("event", F.when(F.col("event").isin("Started", "ChapterFinished", "Completed", "ChunkFinished"), F.col("seq"))).alias("last_event")
    chunk = F.max_by(F.struct("chunk_index", "chunk_total"), F.when(F.col("event") == "ChunkFinished", F.col("seq"))).alias("chunk")
    state = live.groupBy("task_id").agg(F.max("t").alias("t"), done, last_event, chunk)
    flight = F.when((F.col("last_event") == "ChunkFinished") & (F.col("chunk.chunk_total") > 0), (F.col("chunk.chunk_index") + 1) / F.col("chunk.chunk_total")).otherwise(F.lit(0.0))
    over = F.col("last_event") == "Completed"
    return state.select(
        "task_id", F.col("t").cast("bigint").alias("total"), F.when(over & F.col("t").isNotNull(), F.col("t")).otherwise(F.col("completed")).cast("bigint").alias("completed"),
        F.when(over, 100).otherwise(percent(F.col("t"), F.col("completed"), flight)).cast("int").alias("progress"),
    )


#: Events and their fields: whole numbers end in "#".
EVENTS = {
    "Started": ("total#",), "ChapterStarted": ("index#", "href"), "ChapterFinished": ("index#", "href"), "ChunkStarted": ("index#", "href", "chunk_index#", "chunk_total#"),
    "ChunkFinished": ("index#", "href", "chunk_index#", "chunk_total#"), "Failed": ("index#", "href", "error"),
}
PAYLOAD = "struct<event:string,total:bigint,index:bigint,href:string,chunk_index:bigint,chunk_total:bigint,error:string>"


def payload(json: Column) -> Column:
    """STRUCT of an event: the string "Completed", or an object with the event as its only key; null for anything else."""
    raw = F.try_parse_json(json)
    keys = F.json_object_keys(json)
    fields = ("total#", "index#", "href", "chunk_index#", "chunk_total#", "error")

    def value(event: str, field: str) -> tuple[Column, Column]:
        """(the value, whether it is there in its type)."""
        path = f"$.{event}.{field.rstrip('#')}"
        kind = F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
        if field.endswith("#"):
            return F.try_variant_get(raw, path, "bigint"), kind.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)")
        return F.try_variant_get(raw, path, "string"), kind == "STRING"

    out = F.when(F.trim(json) == '"Completed"', F.struct(F.lit("Completed").alias("event"), *[F.lit(None).cast("bigint" if f.endswith("#") else "string").alias(f.rstrip("#")) for f in fields]))
    for event, wanted in EVENTS.items():
        have = {f: value(event, f) for f in wanted}
        good = F.lit(True)
        for _, there in have.values():
            good = good & F.coalesce(there, F.lit(False))
        made = [(have[f][0] if f in have else F.lit(None).cast("bigint" if f.endswith("#") else "string")).alias(f.rstrip("#")) for f in fields]
        out = out.when((F.size(keys) == 1) & (F.get(keys, F.lit(0)) == event) & good, F.struct(F.lit(event).alias("event"), *made))
    return out.cast(PAYLOAD)


def last_state(events: DataFrame) -> DataFrame:
    """(task_id, percent, message): the last of (task_id, seq, percent, message) of each task; ties go to the greater state."""
    return events.groupBy("task_id").agg(F.max(F.struct("seq", "percent", "message")).alias("e")).select("task_id", "e.percent", "e.message")


def chunk_numbers(counts: DataFrame, keys: list[str], block: str) -> DataFrame:
    """keys + (block, first, total): the number that each block's first chunk has in its chapter, from 0, and the chapter's chunks.

    counts: keys, block, chunks: one row a block, so only numbers run through the windows of a chapter.
    """
    chapter = Window.partitionBy(*keys)
    before = F.sum("chunks").over(chapter.orderBy(block)) - F.col("chunks")
    return counts.select(*keys, block, before.cast("bigint").alias("first"), F.sum("chunks").over(chapter).cast("bigint").alias("total"))


#: The kinds of log entries by event.
LEVELS = {"Completed": "success", "Started": "info", "Failed": "error"}


def log_entries(events: DataFrame) -> DataFrame:
    """(task_id, seq, level, message, details) of events (task_id, seq, event, href, total, chunk_index, chunk_total, error)."""
    level = F.lit("chapter")
    for event, name in LEVELS.items():
        level = F.when(F.col("event") == event, name).otherwise(level)
    chunk = F.concat_ws(" ", "event", F.concat((F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("chunk_total").cast("string")), "href")
    message = (
        F.when(F.col("event") == "Started", F.concat_ws(" ", "event", F.col("total").cast("string"))).when(F.col("event").startswith("Chunk"), chunk)
        .when(F.col("event") == "Failed", F.concat_ws(" ", "event", "href", "error")).otherwise(F.concat_ws(" ", "event", "href"))
    )
    return events.select("task_id", "seq", level.alias("level"), message.alias("message"), F.when(F.col("event") == "Failed", F.col("error")).alias("details"))
