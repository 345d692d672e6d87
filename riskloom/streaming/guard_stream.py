"""Hook events as a stream: the batch functions between ``readStream`` and ``writeStream``.

Two queries, each with a checkpoint of its own. The first scans events and appends their risks to a table; the
second reads that table and keeps counts per window. Both resume from their checkpoints: a file or micro-batch
that was half done when a query stopped is done again and leaves no second trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.guard import verdict_risks, verdicts

EVENT_SCHEMA = "event_id bigint, ts timestamp, payload string"
LATE = "10 minutes"


#: Rows of a landed file, about: a scan of as many events is a task.
EVENTS_A_FILE = 20_000


def land_slice(events: DataFrame, path: str) -> None:
    """Appends events that are read as one micro-batch, in as many files as there are tasks to scan them."""
    files = max(1, -(-events.count() // EVENTS_A_FILE))
    events.repartition(files).write.mode("append").parquet(path)


def time_slices(events: DataFrame, slices: int) -> list[Column]:
    """Conditions that part the events by their time into slices of about equal size, the earliest first."""
    shares = [n / slices for n in range(1, slices)]
    bounds = events.agg(F.percentile_approx("ts", F.array(*map(F.lit, shares)), F.lit(10_000))).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    at = F.coalesce(sum((F.col("ts") >= F.lit(b)).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)
    return [at == n for n in range(len(bounds) + 1)]


def land_events(events: DataFrame, path: str, files: int) -> None:
    """Appends events to a landing folder as ``files`` files in the order of their time.

    Streams take files in the order in which they were written, and a file that comes after a later one is behind
    the watermark. So each is written before the next one is begun.
    """
    for of_slice in time_slices(events, files):
        events.filter(of_slice).coalesce(1).write.mode("append").parquet(path)


def read_events(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = EVENT_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def guard_risks(events: DataFrame, spark: SparkSession, block: bool = False) -> DataFrame:
    """One row per event and risk, row by row; repeated events give repeated risks."""
    return verdict_risks(verdicts(events, spark, block=block))


def guard_risks_once(events: DataFrame, spark: SparkSession, late: str = LATE, block: bool = False) -> DataFrame:
    """As ``guard_risks`` on a stream, an event that comes again within ``late`` left out.

    Events are scanned where they are read, so what is dealt out by event and kept as state is a verdict, not a
    payload. Events behind the watermark are dropped and counted (``late_rows``). Of events without an id those
    with one time and the same risks are one.
    """
    judged = verdicts(events, spark, block=block)
    unnamed = F.when(F.col("event_id").isNull(), F.xxhash64("ts", "host", "moment", F.to_json("risks")))
    once = judged.withColumn("_unnamed", unnamed).withWatermark("ts", late)
    return verdict_risks(once.dropDuplicatesWithinWatermark(["event_id", "_unnamed"]).drop("_unnamed"))


def verdict_counts(
    risks: DataFrame, width: str = "1 hour", late: str = LATE
) -> DataFrame:
    """Risks per event-time window, host, moment and rule.

    State holds one count per open window and key; the watermark closes windows. Counts are
    combined before the shuffle, so a host that sends most events does not burden one task.
    """
    return (
        risks.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "host", "moment", "rule_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "host", "moment", "rule_id", "n")
    )


def write_risks(risks: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a parquet table. ``checkpoint`` belongs in shared storage on a cluster."""
    writer = risks.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", checkpoint
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)


def write_counts(counts: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps counts current under ``out``: each micro-batch writes the windows it changed to a folder of its
    own, over what an attempt before may have left there."""

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The latest count of each window and key, open windows included."""
    keys = ["window_start", "host", "moment", "rule_id"]
    schema = "window_start timestamp, host string, moment string, rule_id string, n bigint, batch bigint"
    return spark.read.schema(schema).parquet(out).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators dropped behind the watermark, as far as it remembers its progress."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
