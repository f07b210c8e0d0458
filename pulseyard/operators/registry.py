"""Current state per instance: upsert, expiry, online stretches, tokens.

One instance may send a third of all heartbeats, so nothing here sorts the raw rows of a key in one
task. Either an aggregate with a map-side part reduces them first, or they are thinned to one row
per key and time cell, which bounds a key by the time range and not by its row count.
"""

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arithmetic import floor_to
from ..functions.clock import epoch_seconds
from ..functions.membership import BIT_WORDS, may_contain, membership_bits

# Seconds without a heartbeat before expiry, seconds between sweeps, token life.
EXPIRY_SECONDS = 60
SWEEP_SECONDS = 300
TOKEN_DAYS = 30


def _order(columns: Sequence[str]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def latest_by_aggregate(rows: DataFrame, key: str = "id", order: Sequence[str] = ("received_at", "seq")) -> DataFrame:
    """Newest row per key by one aggregate over whole rows; for streams, and for a few rows per key."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), _order(order)).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, "_row.*")


def _packed(high: Column, low: Column) -> Column:
    high = F.coalesce(high, F.lit(-(10**18))).cast("decimal(19,0)") * F.lit(Decimal(2**64)).cast("decimal(20,0)")
    return high.cast("decimal(38,0)") + F.coalesce(low.cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))


def packed_order(rows: DataFrame, order: Sequence[str]) -> Column | None:
    """Two order columns as one number that sorts like them, nulls first; null where their types do not allow it.

    A time counts in microseconds, and a whole number has 64 bits below it. One number keeps aggregates
    over it in hash form, where a struct would force a sort.
    """
    types = [rows.schema[c].dataType for c in order]
    whole = lambda t: isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    timed = lambda t: isinstance(t, (T.TimestampType, T.TimestampNTZType))
    if len(order) != 2 or not (timed(types[0]) or whole(types[0]) and not isinstance(types[0], T.LongType)) or not whole(types[1]):
        return None
    high = F.unix_micros(F.col(order[0]).cast("timestamp")) if timed(types[0]) else F.col(order[0]).cast("bigint")
    return _packed(high, F.col(order[1]))


def upsert_latest(
    rows: DataFrame, key: str = "id", order: Sequence[str] = ("received_at", "seq"), bit_words: int = BIT_WORDS
) -> DataFrame:
    """Newest row per key; of equally new rows any one. Works on batches and, with update or complete output, on streams.

    Rows are picked up late: a hash aggregate of key and packed order alone finds what is newest, a Bloom
    filter of ``bit_words`` words lets the winners (and few others) through a second scan, and these meet
    the aggregate. No whole row is sorted or moved but the winners. Null keys are a key. An order whose
    types cannot be packed, or a stream, takes one aggregate over whole rows.
    """
    packed = None if rows.isStreaming else packed_order(rows, order)
    if packed is None:
        return latest_by_aggregate(rows, key, order)
    rest = [c for c in rows.columns if c != key]
    if set(rest) <= set(order):  # nothing to pick up
        return rows.groupBy(key).agg(*[F.max_by(c, packed).alias(c) for c in rest]).select(*rows.columns)
    newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max(packed).alias("_newest"))
    placed = rows.withColumn("_order", packed)
    hopeful = placed.filter(may_contain(membership_bits(newest, bit_words), F.col(key), F.col("_order")))
    met = hopeful.join(newest, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_order") == F.col("_newest")))
    one = Window.partitionBy("_key", "_newest").orderBy("_newest")
    return met.withColumn("_place", F.row_number().over(one)).filter("_place = 1").select(*rows.columns)


def purge_time(last_heartbeat: Column, expiry: int = EXPIRY_SECONDS, sweep: int = SWEEP_SECONDS) -> Column:
    """Epoch second at which a row with this last heartbeat is removed.

    Sweeps run at multiples of ``sweep`` and remove what is more than ``expiry`` old; with
    ``sweep=0`` a row is removed as soon as it is too old.
    """
    if sweep == 0:
        return last_heartbeat + expiry + 1
    return floor_to(last_heartbeat + expiry, sweep) + sweep


def expire_stale(
    current: DataFrame,
    now: int,
    last_heartbeat: str = "last_heartbeat",
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> DataFrame:
    """Rows still registered at ``now``."""
    alive = purge_time(F.col(last_heartbeat), expiry, sweep) > now
    # The plain bound repeats part of the test in a form that reaches the scan.
    return current.filter((F.col(last_heartbeat) >= now - expiry - sweep) & alive)


def live_rows(
    heartbeats: DataFrame,
    now: int,
    key: str = "id",
    order: Sequence[str] = ("received_at", "seq"),
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> DataFrame:
    """Newest row per key with ``last_heartbeat``, of the keys still registered at ``now``.

    A row older than expiry and sweep can neither be alive nor newer than one that is, so the age bound
    stands below the aggregate, where it reaches the scan.
    """
    young = heartbeats.filter(F.col(order[0]) >= F.timestamp_seconds(F.lit(now - expiry - sweep)))
    latest = upsert_latest(young, key, order).withColumn("last_heartbeat", epoch_seconds(F.col(order[0])))
    return expire_stale(latest, now, "last_heartbeat", expiry, sweep)


def _thin(heartbeats: DataFrame, key: str, time: str, order: Sequence[str], cell: int, extra=()) -> DataFrame:
    """One row per key and time cell, with the ends of the cell's heartbeats."""
    return (
        heartbeats.withColumn("_t", epoch_seconds(F.col(time)))
        .groupBy(key, floor_to(F.col("_t"), cell).alias("_cell"))
        .agg(
            F.min("_t").alias("first_t"),
            F.max("_t").alias("last_t"),
            F.count(F.lit(1)).alias("n"),
            *extra,
        )
    )


def online_sessions(
    heartbeats: DataFrame,
    key: str = "id",
    time: str = "received_at",
    expiry: int = EXPIRY_SECONDS,
    sweep: int = 0,
) -> DataFrame:
    """Contiguous online stretches: ``(key, start, last, end, heartbeats)`` in epoch seconds.

    A heartbeat starts a new stretch when the row was removed before it came. ``end`` is the time of
    removal with sweeps, and ``last + expiry`` without. Two heartbeats in one cell are never parted,
    so cells are merged instead of rows.
    """
    cells = _thin(heartbeats, key, time, (time,), sweep or expiry)
    by_key = Window.partitionBy(key).orderBy("_cell")
    previous = F.lag("last_t").over(by_key)
    starts = previous.isNull() | (F.col("first_t") >= purge_time(previous, expiry, sweep))
    numbered = cells.withColumn("_starts", starts.cast("int")).withColumn(
        "_session", F.sum("_starts").over(by_key)
    )
    last = F.max("last_t")
    end = last + expiry if sweep == 0 else purge_time(last, expiry, sweep)
    return (
        numbered.groupBy(key, "_session")
        .agg(
            F.min("first_t").alias("start"),
            last.alias("last"),
            end.alias("end"),
            F.sum("n").alias("heartbeats"),
        )
        .drop("_session")
    )


def first_seen(
    heartbeats: DataFrame,
    key: str = "id",
    time: str = "received_at",
    seq: str = "seq",
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> DataFrame:
    """``(key, instance_seq)``: the ``seq`` of the first heartbeat of each key's latest stretch.

    This is a key's position in the registry: a replacement keeps it, a removal loses it.
    """
    opening = F.min_by(seq, F.struct(time, seq)).alias("first_seq")
    cells = _thin(heartbeats, key, time, (time, seq), sweep or expiry, (opening,))
    previous = F.lag("last_t").over(Window.partitionBy(key).orderBy("_cell"))
    starts = previous.isNull() | (F.col("first_t") >= purge_time(previous, expiry, sweep))
    return (
        cells.withColumn("_starts", starts)
        .filter("_starts")
        .groupBy(key)
        .agg(F.max_by("first_seq", "_cell").alias("instance_seq"))
    )


def current_registry(
    heartbeats: DataFrame,
    now: int,
    key: str = "id",
    time: str = "received_at",
    seq: str = "seq",
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
    position: bool = False,
) -> DataFrame:
    """Registered instances at ``now`` with ``last_heartbeat``, and ``instance_seq`` on request.

    Rows are read only for the seconds in which a registered heartbeat can lie, a filter that reaches
    the scan. A position needs the past as well, three narrow columns of it, and of the registered keys
    alone.
    """
    seen = heartbeats.filter(F.col(time) < F.timestamp_seconds(F.lit(now + 1)))
    recent = seen.filter(F.col(time) >= F.timestamp_seconds(F.lit(now - expiry - sweep)))
    latest = latest_by_aggregate(recent, key, (time, seq)).withColumn("last_heartbeat", epoch_seconds(F.col(time)))
    alive = expire_stale(latest, now, "last_heartbeat", expiry, sweep)
    if not position:
        return alive
    past = seen.select(key, time, seq).join(recent.select(key).distinct(), key, "left_semi")
    return alive.join(first_seen(past, key, time, seq, expiry, sweep), key)


def token_registry(
    issues: DataFrame,
    key: str = "id",
    issued_at: str = "issued_at",
    order: Sequence[str] = ("issued_at", "token"),
    days: int = TOKEN_DAYS,
) -> DataFrame:
    """Latest token per key with its expiry time."""
    latest = upsert_latest(issues, key, order)
    return latest.withColumn("expires_at", F.col(issued_at) + F.expr(f"INTERVAL {days} DAYS"))


def instance_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("instances"))


def exists_by_key(requests: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """Requests with ``found``."""
    known = registry.select(key).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, key, "left").select(
        *requests.columns, F.col("_known").isNotNull().alias("found")
    )


def not_found_by_key(requests: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """Requests whose key is not registered."""
    return requests.join(registry.select(key), key, "left_anti")


def registry_as_of(
    requests: DataFrame,
    heartbeats: DataFrame,
    at: str = "at",
    key: str = "id",
    time: str = "received_at",
    seq: str = "seq",
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
) -> DataFrame:
    """Requests with ``found``, ``last_heartbeat`` and ``heartbeat_seq``, as the registry was at each request's second.

    A request sees the newest heartbeat of its key at or before second ``at`` that was not purged by then. A
    heartbeat is of use for ``expiry + sweep`` seconds, so with time cells of that length a request needs
    its own cell and the last heartbeat of the cell before, which is carried over as one row. Cells of a hot key
    are windows of their own; nothing is compared by range. Null keys and null times find nothing.
    """
    cell = expiry + sweep + 1
    beats = heartbeats.select(F.col(key).alias("_key"), epoch_seconds(F.col(time)).alias("_t"), F.col(seq).cast("bigint").alias("_seq"))
    beats = beats.filter("_key is not null and _t is not null").withColumn("_cell", floor_to(F.col("_t"), cell))
    last = beats.groupBy("_key", "_cell").agg(F.max("_t").alias("_t"), F.max_by("_seq", _packed(F.col("_t"), F.col("_seq"))).alias("_seq"))
    following = F.col("_cell") + cell
    carried = last.select("_key", following.alias("_at"), following.alias("_cell"), F.lit(0).alias("_kind"), "_t", "_seq")
    seen = beats.select("_key", F.col("_t").alias("_at"), "_cell", F.lit(1).alias("_kind"), "_t", "_seq")
    asked = requests.withColumn("_at", F.col(at).cast("bigint"))
    payload = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    rows = asked.select(F.col(key).alias("_key"), "_at", floor_to(F.col("_at"), cell).alias("_cell"), F.lit(2).alias("_kind"), payload.alias("_asked"))
    both = carried.unionByName(seen).unionByName(rows, allowMissingColumns=True)
    before = Window.partitionBy("_key", "_cell").orderBy("_at", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("_t").isNotNull(), F.struct("_t", "_seq"))
    matched = both.withColumn("_hb", F.last(held, ignorenulls=True).over(before)).filter(F.col("_kind") == 2)
    alive = F.coalesce(purge_time(F.col("_hb._t"), expiry, sweep) > F.col("_at"), F.lit(False)) & F.col("_key").isNotNull()
    return matched.select(
        "_asked.*",
        alive.alias("found"),
        F.when(alive, F.col("_hb._t")).alias("last_heartbeat"),
        F.when(alive, F.col("_hb._seq")).alias("heartbeat_seq"),
    )


EXPORT_COLUMNS = ("id", "version", "servers", "uptime", "last_heartbeat", "ip_address", "webfront_url")


def export_instances(registry: DataFrame, as_json: bool = False) -> DataFrame:
    """Declared fields of every instance, or one ``json`` text per instance."""
    fields = [c for c in EXPORT_COLUMNS if c in registry.columns]
    if as_json:
        return registry.select("id", F.to_json(F.struct(*fields)).alias("json"))
    return registry.select(*fields)


def export_instance_by_id(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Each requested ``id`` with the exported fields and ``found``."""
    exported = export_instances(registry).withColumn("_known", F.lit(True))
    joined = requests.join(exported, "id", "left")
    return joined.withColumn("found", F.col("_known").isNotNull()).drop("_known")
