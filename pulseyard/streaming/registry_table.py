"""A stored registry: a table in hash buckets that a stream of heartbeats keeps up to date."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import breakdown
from ..operators.registry import EXPIRY_SECONDS, SWEEP_SECONDS, expire_stale, first_seen, latest_by_aggregate

BUCKETS = 64

GROUPS = "dim string, key string, kind string, rows bigint, amount bigint, first decimal(38,0)"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(spark: SparkSession, path: str, batch_id: int) -> dict[int, tuple[int, int]]:
    """Of each bucket the batch that wrote it last and its oldest heartbeat, as of a batch; one small row per bucket."""
    if batch_id < 0:
        return {}
    rows = spark.read.schema("bucket int, batch long, oldest long").parquet(f"{path}/places/batch={batch_id}").collect()
    return {r["bucket"]: (r["batch"], r["oldest"]) for r in rows}


def _read_buckets(spark: SparkSession, path: str, places: dict[int, tuple[int, int]], schema) -> DataFrame:
    folders = [f"{path}/rows/batch={batch}/bucket={bucket}" for bucket, (batch, _) in sorted(places.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _gone_at(last: int, expiry: int, sweep: int) -> int:
    return last + expiry + 1 if sweep == 0 else ((last + expiry) // sweep + 1) * sweep


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    key: str = "id",
    time: str = "received_at",
    seq: str = "seq",
    buckets: int = BUCKETS,
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> tuple[DataFrame, DataFrame] | None:
    """Bring the heartbeats of one batch into the table; returns the rows of the touched buckets before and after.

    Only buckets that a heartbeat of the batch falls into, or that hold an instance due to be removed by its newest
    heartbeat, are read and written again, in folders of the batch's own; a list of one row per bucket says where
    each bucket's newest rows are. A batch reads what the batch before it left and replaces its own folders, so a
    replay after a failure ends the same. Batches are numbered from 0 without gaps. Instances keep
    ``instance_seq``, the position of their first heartbeat since they were registered. An empty batch changes
    nothing (None).
    """
    spark = batch.sparkSession
    placed = batch.filter(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets)).persist()
    try:
        places = _places(spark, path, batch_id - 1)
        seconds = F.unix_seconds(F.col(time).cast("timestamp"))
        now = placed.agg(F.max(seconds)).first()[0]
        changed = None
        if now is not None:
            hit = {r["bucket"] for r in placed.select("bucket").distinct().collect()}
            due = {b for b, (_, oldest) in places.items() if _gone_at(oldest, expiry, sweep) <= now}
            new = placed.drop("bucket").withColumn("instance_seq", F.col(seq).cast("bigint"))
            old = _read_buckets(spark, path, {b: places[b] for b in sorted(hit | due) if b in places}, new.schema)
            rows = old.unionByName(new)
            newest = latest_by_aggregate(rows.drop("instance_seq"), key, (time, seq))
            # A stored row stands for all heartbeats since its opening, so it takes part with the opening's seq.
            opened = first_seen(rows.select(key, time, F.col("instance_seq").alias(seq)), key, time, seq, expiry, sweep)
            merged = newest.join(opened, key).withColumn("last_heartbeat", seconds)
            alive = expire_stale(merged, now, "last_heartbeat", expiry, sweep)
            shaped = alive.select(*[F.col(f"`{c}`") for c in new.columns], _bucket(key, buckets).alias("bucket"))
            shaped.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch_id}")
            written = spark.read.schema(shaped.schema).parquet(f"{path}/rows/batch={batch_id}")
            oldest = {r["bucket"]: (batch_id, r["oldest"]) for r in written.groupBy("bucket").agg(F.min(seconds).alias("oldest")).collect()}
            places = {b: place for b, place in places.items() if b not in hit | due} | oldest
            changed = old, written.drop("bucket")
        rows = spark.createDataFrame([(b, *place) for b, place in sorted(places.items())], "bucket int, batch long, oldest long").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{path}/places/batch={batch_id}")
        return changed
    finally:
        placed.unpersist()


def _full(spark: SparkSession, schema):
    return spark.createDataFrame([], schema).withColumn("instance_seq", F.lit(None).cast("bigint")).schema


def stored_registry(
    spark: SparkSession,
    path: str,
    batch_id: int,
    schema,
    now: int,
    time: str = "received_at",
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> DataFrame:
    """The registered instances at ``now`` after a batch, for the pages: no heartbeat is read.

    ``schema`` is that of the heartbeats; ``instance_seq`` and ``last_heartbeat`` come beside it. What is too old at
    ``now``, which may be later than the batch, is left out.
    """
    rows = _read_buckets(spark, path, _places(spark, path, batch_id), _full(spark, schema))
    return expire_stale(rows.withColumn("last_heartbeat", F.unix_seconds(F.col(time).cast("timestamp"))), now, "last_heartbeat", expiry, sweep)


def stored_instances(spark: SparkSession, path: str, batch_id: int, schema, ids: list[str], now: int, key: str = "id", buckets: int = BUCKETS, **settings) -> DataFrame:
    """Instances by id: only the buckets of the ids asked for are read."""
    wanted = spark.createDataFrame([(i,) for i in ids], f"{key} string")
    numbers = {r[0] for r in wanted.select(_bucket(key, buckets)).collect()}
    places = {b: n for b, n in _places(spark, path, batch_id).items() if b in numbers}
    rows = _read_buckets(spark, path, places, _full(spark, schema))
    found = rows.filter(F.col(key).isin(ids)).withColumn("last_heartbeat", F.unix_seconds(F.col("received_at").cast("timestamp")))
    return expire_stale(found, now, "last_heartbeat", **settings)


def apply_statistics(changed: tuple[DataFrame, DataFrame] | None, current: DataFrame, batch_id: int, path: str) -> None:
    """Bring a batch's changes into the counted groups of the statistics page.

    ``changed`` is what ``apply_batch`` returned: instances before count down, those after count up, and whatever is
    the same cancels out. ``current`` is asked only for groups that lost their first member. One table per batch,
    made from the one before, so a replay ends the same.
    """
    spark = current.sparkSession
    groups = spark.createDataFrame([], GROUPS) if batch_id == 0 else spark.read.schema(GROUPS).parquet(f"{path}/groups/batch={batch_id - 1}")
    if changed is not None:
        groups = breakdown.changed_groups(groups, *changed, current)
    groups.write.mode("overwrite").parquet(f"{path}/groups/batch={batch_id}")


def stored_statistics(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The statistics page after a batch, from counted groups alone."""
    return breakdown.stats_of_groups(spark.read.schema(GROUPS).parquet(f"{path}/groups/batch={batch_id}"))


def registry_table_stream(heartbeats: DataFrame, path: str, checkpoint: str, statistics: bool = False, **settings) -> DataStreamWriter:
    """Keep the table at ``path`` up to date with a stream of heartbeats, and the statistics too if asked for."""

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = apply_batch(batch, batch_id, path, **settings)
        if statistics:
            spark = batch.sparkSession
            current = _read_buckets(spark, path, _places(spark, path, batch_id), _full(spark, batch.schema))
            apply_statistics(changed, current, batch_id, path)

    return heartbeats.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
