"""Batch sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import epoch_seconds
from ..operators.versions import VERSION_FIELDS


def write_history(history: DataFrame, path: str) -> None:
    """Replace the saved history, partitioned by series."""
    history.write.mode("overwrite").partitionBy("metric").parquet(path)


def write_instances(instances: DataFrame, path: str) -> None:
    """Current instances as JSON lines."""
    instances.write.mode("overwrite").json(path)


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Rejected heartbeats with their messages, by day of receipt."""
    day = F.to_date(F.timestamp_seconds(epoch_seconds(F.col("received_at"))))
    rejected.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def write_versions(config: DataFrame, path: str) -> None:
    """Replace the version table, one folder per API version."""
    config.select("api_version", *VERSION_FIELDS).write.mode("overwrite").partitionBy("api_version").parquet(path)


def meta_set(table: DataFrame, changes: DataFrame, key: str = "plan_id") -> DataFrame:
    """Table with the changed keys replaced; a document is replaced as a whole.

    Write the result to a new folder: Spark cannot overwrite a table that it is reading.
    """
    kept = table.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.select(*table.columns))
