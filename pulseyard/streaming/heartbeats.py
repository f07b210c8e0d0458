"""Heartbeat streams: ingestion, registry, sessions, census."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.arithmetic import ceil_div
from ..functions.clock import epoch_seconds
from ..operators.ingest import validate_heartbeats
from ..operators.registry import EXPIRY_SECONDS, SWEEP_SECONDS, purge_time, upsert_latest
from ..operators.timeseries import SAMPLE_SECONDS

# Seconds between writes of the history.
PERSIST_SECONDS = 15

# Bits of ``seq`` that hold the offset in a partition of a topic.
PARTITION_SHIFT = 47

RAW_SCHEMA = "body string, remote_ip string, received_at timestamp, seq bigint"


def read_raw_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Raw heartbeats landed as JSON lines with the columns of ``RAW_SCHEMA``."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw heartbeats from a topic whose record key is the sender address.

    Offsets count inside one partition, so ``seq`` puts them below the partition's number: it orders records of
    one receive time the same way in every run, and those of one partition as they came.
    """
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return records.select(
        F.col("value").cast("string").alias("body"),
        F.col("key").cast("string").alias("remote_ip"),
        F.col("timestamp").alias("received_at"),
        (F.shiftleft(F.col("partition").cast("bigint"), PARTITION_SHIFT) + F.col("offset")).alias("seq"),
    )


def ingest_stream(raw: DataFrame, valid_path: str, rejected_path: str, checkpoint: str) -> DataStreamWriter:
    """Validate every heartbeat and write accepted and rejected rows to two tables.

    Each table has one folder per batch, and a replayed batch overwrites its own folder, so an
    executor or driver loss leaves no duplicates. The batch is validated once for both tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        validated = validate_heartbeats(batch).persist()
        try:
            good = validated.filter(F.size("errors") == 0).drop("errors")
            bad = validated.filter(F.size("errors") > 0)
            good.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        finally:
            validated.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def registry_stream(heartbeats: DataFrame) -> DataFrame:
    """Newest row per instance; write with update or complete output."""
    return upsert_latest(heartbeats)


REGISTRY_CHANGE = "id string, live boolean, at bigint, instance_seq bigint, last_heartbeat bigint, seq bigint, row string"
_REGISTRY_STATE = "opening bigint, last bigint, seq bigint, row string"


def registry_changes(
    heartbeats: DataFrame,
    lateness: int = 60,
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> DataFrame:
    """Changes of the registry, for update output: newest heartbeats with ``live``, removals without.

    One state row per registered instance holds its newest heartbeat and the ``seq`` of the first one since it was
    registered (``instance_seq``). The row times out at the sweep that removes the instance, once the watermark
    (``lateness`` seconds behind the newest receive time) has passed it; then a removal is emitted and the state
    is gone, so state is bounded by what is registered and not by every id ever seen. A heartbeat that comes after
    the sweep opens the instance anew. Heartbeats older than the newest one change nothing; those older than
    the watermark are not read. Null ids are ignored. Window functions over sessions know no update output,
    which is why the state is a function of its own.
    """
    columns = heartbeats.columns
    rows = heartbeats.filter("id is not null").withWatermark("received_at", f"{lateness} seconds")
    narrow = rows.select(
        "id", "received_at", F.unix_seconds("received_at").alias("t"), F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct(*columns)).alias("row")
    )

    def gone_at(last: int) -> int:
        return last + expiry + 1 if sweep == 0 else ((last + expiry) // sweep + 1) * sweep

    def change(key: tuple, live: bool, at: int, state: tuple) -> pd.DataFrame:
        opening, last, seq, row = state
        return pd.DataFrame([(key[0], live, at, opening, last, seq, row)], columns=["id", "live", "at", "instance_seq", "last_heartbeat", "seq", "row"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield change(key, False, gone_at(held[1]), held)
            return
        held = state.get if state.exists else None
        # Of a batch only the newest heartbeat and the gaps before it matter; they are found on two numbers per row.
        came = pd.concat(list(batches), ignore_index=True).sort_values(["t", "seq"], kind="stable")
        for t, seq, row in zip(came["t"].tolist(), came["seq"].tolist(), came["row"], strict=True):
            if held is None or t >= gone_at(held[1]):
                held = (seq, t, seq, row)
            elif (t, seq) > (held[1], held[2]):
                held = (held[0], t, seq, row)
        due = gone_at(held[1])
        if due * 1000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield change(key, False, due, held)
            return
        state.update(held)
        state.setTimeoutTimestamp(due * 1000)
        yield change(key, True, held[1], held)

    return narrow.groupBy("id").applyInPandasWithState(update, REGISTRY_CHANGE, _REGISTRY_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def registry_from_changes(changes: DataFrame, heartbeat_schema: str) -> DataFrame:
    """The registry after these changes: the heartbeat columns, ``last_heartbeat`` and ``instance_seq`` of live instances.

    A removal at the very second of a new heartbeat comes before it.
    """
    newest = changes.groupBy("id").agg(F.max_by(F.struct("live", "instance_seq", "last_heartbeat", "row"), F.struct("last_heartbeat", "seq", ~F.col("live"))).alias("c"))
    read = newest.filter("c.live").select(F.from_json("c.row", heartbeat_schema).alias("r"), "c.instance_seq", "c.last_heartbeat")
    return read.select("r.*", "last_heartbeat", "instance_seq")


def session_stream(
    heartbeats: DataFrame, watermark: str = "1 minute", expiry: int = EXPIRY_SECONDS
) -> DataFrame:
    """Online stretches. Append output emits a stretch once the watermark has passed its end."""
    session = F.session_window("received_at", f"{expiry} seconds")
    return (
        heartbeats.withWatermark("received_at", watermark)
        .groupBy("id", session.alias("session"))
        .agg(F.count(F.lit(1)).alias("heartbeats"))
        .select(
            "id",
            F.unix_seconds("session.start").alias("start"),
            F.unix_seconds("session.end").alias("end"),
            "heartbeats",
        )
    )


def census_stream(
    heartbeats: DataFrame,
    tick: int = SAMPLE_SECONDS,
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
    lateness: int = 60,
) -> DataFrame:
    """Registered clients, instances and servers per tick, for append output.

    A heartbeat is placed on every tick at which it can still be the newest of its instance, the
    newest wins per instance and tick, and ticks are summed. Ticks lie up to ``expiry + sweep``
    ahead of the heartbeat, so the watermark trails by that much more than ``lateness``.
    """
    at = epoch_seconds(F.col("received_at"))
    step = F.lit(tick).cast("bigint")
    first = ceil_div(at, F.lit(tick)) * tick
    last = ceil_div(purge_time(at, expiry, sweep), F.lit(tick)) * tick - tick
    clients = F.aggregate("servers", F.lit(0).cast("bigint"), lambda t, s: t + s["clientnum"].cast("bigint"))
    placed = (
        heartbeats.select(
            "id",
            F.struct("received_at", "seq").alias("order"),
            F.struct(F.size("servers").cast("bigint").alias("servers"), clients.alias("clients")).alias("hb"),
            first.alias("first"),
            last.alias("last"),
        )
        .filter(F.col("first") <= F.col("last"))
        .select("id", "order", "hb", F.explode(F.sequence("first", "last", step)).alias("at"))
        .withColumn("at", F.timestamp_seconds("at"))
    )
    newest = (
        placed.withWatermark("at", f"{expiry + sweep + lateness} seconds")
        .groupBy(F.window("at", f"{tick} seconds").alias("slot"), "id")
        .agg(F.max_by("hb", "order").alias("hb"))
    )
    return (
        newest.groupBy(F.window(F.window_time("slot"), f"{tick} seconds").alias("slot"))
        .agg(
            F.sum("hb.clients").alias("clients"),
            F.count(F.lit(1)).alias("instances"),
            F.sum("hb.servers").alias("servers"),
        )
        .select(F.unix_seconds("slot.start").alias("tick"), "clients", "instances", "servers")
    )


def history_sink(samples: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append samples to the history table every 15 seconds."""
    return (
        samples.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{PERSIST_SECONDS} seconds")
    )
