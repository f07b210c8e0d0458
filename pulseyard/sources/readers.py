"""Batch readers. Schemas are declared, so reading never scans data to infer them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import accepted, validate_heartbeats
from ..operators.registry import upsert_latest
from ..operators.translations import SHEET_KEY
from ..operators.versions import DEFAULT_API_VERSION, versions_for
from ..schemas import HISTORY_SCHEMA

# File name of a version table and its fields.
VERSION_FILE = r"\.v(\d+)\.json$"
VERSION_KEYS = {
    "current-version-stable": "current_version_stable",
    "current-version-prerelease": "current_version_prerelease",
}
# Messages of rejected subscription events.
NOT_JSON, NO_EVENT_TYPE = "request body must be json", "event_type is required"
SERIES_FIELDS = {
    "client_history": "client",
    "instance_history": "instance",
    "server_history": "server",
}


def read_heartbeats(spark: SparkSession, path: str, remote_ip: str | None = None) -> DataFrame:
    """JSON heartbeats, one per line, as ``(body, remote_ip, received_at, seq)``.

    The sender comes from a ``remote_ip=`` folder unless given; the receive time is the file's. ``seq``
    rises with the place in the file: the byte at which the line's split begins, then the line's number
    among those a task reads. Splits lie far more bytes apart than a task reads lines per 2**24.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "body")
    sender = F.lit(remote_ip) if remote_ip is not None else F.col("remote_ip").cast("string")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return lines.select(
        "body",
        sender.alias("remote_ip"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        (F.shiftleft(F.col("_metadata.file_block_start"), 24) + number).alias("seq"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Instances dumped as JSON arrays, one array per file, validated and keyed by id, last one wins.

    A dumped instance keeps its address, which stands in for the sender.
    """
    files = spark.read.schema(T.StructType([T.StructField("doc", T.VariantType())])).option(
        "singleVariantColumn", "doc"
    ).option("multiLine", True).json(path)
    with_file = files.withColumn("_loaded", F.col("_metadata.file_modification_time"))
    items = with_file.select("_loaded", F.posexplode(F.try_variant_get("doc", "$", "array<variant>")).alias("seq", "item"))
    raw = items.select(
        F.to_json("item").alias("body"),
        F.coalesce(F.try_variant_get("item", "$.ip_address", "string"), F.lit("")).alias("remote_ip"),
        F.col("_loaded").alias("received_at"),
        F.col("seq").cast("bigint").alias("seq"),
    )
    return upsert_latest(accepted(validate_heartbeats(raw)), "id", ("received_at", "seq"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """Saved history (three arrays of ``{count, time}``) as a long table, empty when there is none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    sample = "array<struct<count:bigint,time:bigint>>"
    schema = ", ".join(f"{field} {sample}" for field in SERIES_FIELDS)
    saved = spark.read.schema(schema).json(path)
    series = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f).alias("samples")) for f, m in SERIES_FIELDS.items()]
    )
    return (
        saved.select(F.explode(series).alias("s"))
        .select("s.metric", F.inline("s.samples"))
        .select("metric", F.timestamp_seconds("time").alias("time"), "count")
    )


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Translation sheet with a ``row`` column that keeps the order of its rows.

    Every column is text; languages are whatever follows the key column in the header.
    """
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in sheet.columns if c != SHEET_KEY]
    return sheet.select(SHEET_KEY, *text, F.monotonically_increasing_id().alias("row"))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Version files as ``(api_version, current_version_stable, current_version_prerelease)``.

    A version may be a number or a text in the file; here it is text.
    """
    files = spark.read.option("singleVariantColumn", "doc").option("multiLine", True).json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), VERSION_FILE, 1).cast("int")
    return files.select(
        number.alias("api_version"),
        *[F.try_variant_get("doc", f"$['{key}']", "string").alias(name) for key, name in VERSION_KEYS.items()],
    )


def read_version(spark: SparkSession, path: str, api_version: int = DEFAULT_API_VERSION) -> DataFrame:
    return versions_for(read_versions(spark, path), api_version)


def meta_get(table: DataFrame, name: str = "", key: str = "plan_id") -> DataFrame:
    """Metadata of one key, or of all keys for an empty name."""
    return table.filter(F.col(key) == name) if name else table


def parse_subscription_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Event columns beside ``error``, which is set when the body is not a JSON object or has no event type.

    The body is parsed once: a one-row ``inline`` keeps the optimizer from copying the parsing into each field.
    """
    kept = [c for c in raw.columns if c != body]
    parsed = raw.select(*kept, F.inline(F.array(F.struct(F.try_parse_json(body).alias("_event")))))
    is_object = F.coalesce(F.schema_of_variant("_event").startswith("OBJECT"), F.lit(False))
    event_type = F.try_variant_get("_event", "$.event_type", "string")
    error = F.when(~is_object, F.lit(NOT_JSON)).when(event_type.isNull(), F.lit(NO_EVENT_TYPE))
    plan = F.try_variant_get("_event", "$.content.subscription.plan_id", "string")
    fields = F.struct(event_type.alias("event_type"), plan.alias("plan_id"), error.alias("error"))
    return parsed.select(*kept, F.inline(F.array(fields)))
