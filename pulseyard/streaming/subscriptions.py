"""Subscription event streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.subscriptions import counts_from_pairs, event_pairs, plan_subscription_count
from ..sources.readers import parse_subscription_events

EVENT_SCHEMA = "event_id bigint, ts timestamp, event_type string, plan_id string"


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def counter_stream(events: DataFrame, counts_path: str, checkpoint: str) -> DataStreamWriter:
    """Keep subscriber counts in ``counts_path/batch=N``, one full table per batch.

    Batch N starts from the counts of batch N-1 (batch -1 is the table before the first event), so
    a replay after a failure gives the same result. Events must arrive in order between batches.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        previous = batch.sparkSession.read.parquet(f"{counts_path}/batch={batch_id - 1}")
        counts = plan_subscription_count(batch, previous)
        counts.write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


RAW_EVENT_SCHEMA = "event_id string, received_at timestamp, body string"


def read_raw_event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Event bodies as they came, landed as JSON lines with the columns of ``RAW_EVENT_SCHEMA``."""
    return spark.readStream.schema(RAW_EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def distinct_events(raw: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each event id once, however often a sender repeats it ``within`` this time; the first one that came stays.

    State is one id per event and is dropped after that time. Events without an id are all kept.
    """
    marked = raw.withColumn("_key", F.coalesce("event_id", F.concat(F.lit("-"), F.expr("uuid()")))).withWatermark("received_at", within)
    return marked.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def raw_event_stream(raw: DataFrame, events_path: str, rejected_path: str, checkpoint: str, within: str = "1 hour") -> DataStreamWriter:
    """Write typed events, and rejects with their body and error, to two tables.

    Repeated deliveries count once. A body is parsed once. Each table has one folder per batch, and a replayed
    batch replaces its own, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_subscription_events(batch.withColumn("raw_body", F.col("body"))).persist()
        try:
            good = parsed.filter("error is null").select("event_id", F.col("received_at").alias("ts"), "event_type", "plan_id")
            bad = parsed.filter("error is not null").select("event_id", "received_at", F.col("raw_body").alias("body"), "error")
            good.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return distinct_events(raw, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def pair_stream(events: DataFrame, pairs_path: str, checkpoint: str) -> DataStreamWriter:
    """Append one (shift, floor) pair per plan and second to ``pairs_path``, one folder per batch.

    A batch is folded once and never again, and a replay replaces its own folder. Events may come late and in any
    order between batches: a late one is a pair of an earlier second.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        event_pairs(batch).write.mode("overwrite").parquet(f"{pairs_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def stored_counts(spark: SparkSession, pairs_path: str, meta: DataFrame) -> DataFrame:
    """Subscriber counts from all pairs so far; two pairs of one second stand in the order of their batches."""
    kept = spark.read.schema("plan_id string, cell bigint, part bigint, shift bigint, floor bigint, batch bigint").parquet(pairs_path)
    return counts_from_pairs(kept.drop("part").withColumnRenamed("batch", "part"), meta)
