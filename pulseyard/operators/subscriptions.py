"""Plans, entitlements and subscriber counters.

No side is broadcast by hint: plan and customer tables grow, so adaptive execution picks the join
from the sizes it measures and splits skewed partitions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import floor_to
from ..functions.clock import DAY, HOUR, epoch_seconds
from ..functions.crypto import derive_key, seal_content
from ..functions.text import base64_encode, cents_to_text, content_type, count_or_zero, price_label
from .registry import packed_order

# Event types.
CREATED = "subscription_created"
CANCELLED = "subscription_cancelled"

# Counting events of one plan that are folded in one group, about; a fuller hour is cut into parts.
EVENTS_PER_BLOCK = 100_000


def active_plans(plans: DataFrame, limit: int | None = None) -> DataFrame:
    """Active plans, or the first ``limit`` of them by id."""
    active = plans.filter(F.col("status") == "active")
    return active if limit is None else active.orderBy("id").limit(limit)


def plan_catalogue(plans: DataFrame, meta: DataFrame, strict: bool = False) -> DataFrame:
    """Plans with their metadata; ``strict`` leaves out plans that have none."""
    joined = plans.join(meta, plans["id"] == meta["plan_id"], "inner" if strict else "left")
    price = cents_to_text(F.col("price"))
    return joined.select(
        "id",
        "name",
        "description",
        price.alias("price"),
        "period_unit",
        price_label(price, F.col("period_unit")).alias("price_label"),
        "author",
        "help_url",
        "subscription_count",
        count_or_zero(F.col("subscription_count")).alias("subscribers"),
    )


def customers_by_email(emails: DataFrame, customers: DataFrame, limit: int | None = None) -> DataFrame:
    """Customers per requested email with their position by id, all or the first ``limit``."""
    matches = customers.join(emails.select("email").distinct(), "email", "left_semi")
    by_id = Window.partitionBy("email").orderBy("id")
    numbered = matches.withColumn("position", F.row_number().over(by_id))
    return numbered if limit is None else numbered.filter(F.col("position") <= limit)


def first_customer(customers: DataFrame) -> DataFrame:
    """``(email, customer_id)``: the first customer of each email, reduced on the map side."""
    return customers.groupBy("email").agg(F.min("id").alias("customer_id"))


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.filter(F.col("status") == "active")


def subscribed_plans(plans: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Plans of any status that occur among the subscriptions."""
    return plans.join(subscriptions.select("plan_id"), F.col("id") == F.col("plan_id"), "left_semi")


def entitlements(
    requests: DataFrame, customers: DataFrame, subscriptions: DataFrame, plan_meta: DataFrame
) -> DataFrame:
    """Requests with the metadata of every plan they are entitled to, one row per plan.

    A request carries ``email``; its first customer's active subscriptions name the plans, each plan
    once. Subscriptions are made distinct per customer and plan before the joins, so a customer with
    very many of them brings at most one row per plan. Plans without metadata drop out.
    """
    owned = active_subscriptions(subscriptions).select("customer_id", "plan_id").distinct()
    return (
        requests.join(first_customer(customers), "email")
        .join(owned, "customer_id")
        .join(plan_meta, "plan_id")
    )


def require_params(requests: DataFrame) -> DataFrame:
    """Requests with ``error``, set when the email or the instance is missing."""
    complete = F.col("email").isNotNull() & F.col("instance_id").isNotNull()
    return requests.withColumn(
        "error", F.when(~complete, F.lit("subscription_id and instance_id are required"))
    )


def subscribed_content(
    requests: DataFrame,
    customers: DataFrame,
    subscriptions: DataFrame,
    plan_meta: DataFrame,
    contents: DataFrame,
    key_tasks: int = 64,
) -> DataFrame:
    """Encrypted content per request and plan, as ``(email, instance_id, plan_id, content, type)``.

    A key takes milliseconds of CPU, so it is derived once per request that has any item, on the
    distinct requests and before the items join. Those rows are too narrow for their size to ask for
    many tasks; ``key_tasks`` does. Items whose content is missing are left out.
    """
    complete = require_params(requests).filter(F.col("error").isNull())
    asked = complete.select("email", "instance_id").distinct()
    items = entitlements(asked, customers, subscriptions, plan_meta).select("email", "instance_id", "plan_id", "content_url")
    entitled = items.select("email", "instance_id").distinct()
    keys = entitled.repartition(key_tasks, F.xxhash64("email", "instance_id")).withColumn("_key", derive_key("email", "instance_id"))
    items = items.join(keys, ["email", "instance_id"])
    sealed = items.join(contents.filter(F.col("payload").isNotNull()), "content_url")
    return sealed.select(
        "email",
        "instance_id",
        "plan_id",
        base64_encode(seal_content(F.col("payload"), F.col("_key"))).alias("content"),
        content_type(F.col("content_url")).alias("type"),
    )


def event_delta(event_type: Column) -> Column:
    """+1, -1, or null for an event type that does not count."""
    return F.when(event_type == CREATED, 1).when(event_type == CANCELLED, -1).cast("bigint")


def _split_events(events: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(created and cancelled events of plans with a stored count, all others), both with ``delta``."""
    known = meta.filter(F.col("subscription_count").isNotNull()).select("plan_id", F.lit(True).alias("_known"))
    flagged = events.withColumn("delta", event_delta(F.col("event_type"))).join(known, "plan_id", "left")
    counts = F.col("delta").isNotNull() & F.col("_known").isNotNull()
    return flagged.filter(counts).drop("_known"), flagged.filter(~counts).drop("_known")


def _placed_events(counting: DataFrame, cell: int, most: int) -> DataFrame:
    """Counting events with ``cell`` and ``part``, the block they are folded in.

    A block is a function of the row and of the number of events in its plan's cell of time: a cell with
    more than ``most`` is cut into equal parts of its time. Nothing is sampled, so every run of the plan,
    and every retry of a task, gets the same blocks.
    """
    rows = counting.select("plan_id", "ts", "event_id", "delta").withColumn("cell", floor_to(epoch_seconds(F.col("ts")), cell))
    full = rows.groupBy("plan_id", "cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    parts = full.select("plan_id", "cell", F.ceil(F.col("_n") / most).alias("_parts"))
    inside = F.unix_micros(F.col("ts").cast("timestamp")) - F.col("cell") * 1_000_000
    part = F.call_function("div", inside * F.coalesce("_parts", F.lit(1).cast("bigint")), F.lit(cell * 1_000_000).cast("bigint"))
    return rows.join(parts, ["plan_id", "cell"], "left").withColumn("part", part).drop("_parts")


def _block_rows(counting: DataFrame, cell: int = HOUR, most: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Events in ordered blocks with the sum and the lowest sum inside their block so far."""
    in_block = Window.partitionBy("plan_id", "cell", "part").orderBy("ts", "event_id")
    summed = _placed_events(counting, cell, most).withColumn("sum", F.sum("delta").over(in_block))
    return summed.withColumn("low", F.min("sum").over(in_block))


def fold_blocks(rows: DataFrame) -> DataFrame:
    """One (``shift``, ``floor``) pair per block.

    A count that may not go below zero follows ``x -> max(floor, x + shift)`` over any stretch of events,
    where ``shift`` is the sum of the deltas and ``floor`` is ``shift`` less the lowest running sum, or less
    zero when that is lower. Two stretches make one again: ``(s + s', max(f + s', f'))``.
    """
    folds = rows.groupBy("plan_id", "cell", "part").agg(F.sum("delta").alias("shift"), F.min("low").alias("_low"))
    floor = F.col("shift") - F.least(F.col("_low"), F.lit(0).cast("bigint"))
    return folds.select("plan_id", "cell", "part", "shift", floor.alias("floor"))


def chain_blocks(pairs: DataFrame, meta: DataFrame, group: int = DAY) -> tuple[DataFrame, DataFrame]:
    """Counts along the blocks of each plan: (blocks with ``opening`` and ``closing``, groups of blocks with them).

    Pairs are chained inside a group of cells, the groups of a plan through one pair each; with T the sum of
    shifts so far, the count after a stretch is ``T + max(start, max(floor - T))``. No window holds events, and
    none all blocks of a plan.
    """
    start = meta.select("plan_id", count_or_zero(F.col("subscription_count")).alias("start"))
    placed = pairs.withColumn("_group", floor_to(F.col("cell"), group))
    inside = Window.partitionBy("plan_id", "_group").orderBy("cell", "part")
    blocks = placed.withColumn("_total", F.sum("shift").over(inside))
    blocks = blocks.withColumn("_rise", F.col("floor") - F.col("_total")).withColumn("_peak", F.max("_rise").over(inside))
    groups = blocks.groupBy("plan_id", "_group").agg(F.sum("shift").alias("_s"), F.max("_rise").alias("_r"))
    by_plan = Window.partitionBy("plan_id").orderBy("_group")
    groups = groups.join(start, "plan_id").withColumn("_t", F.sum("_s").over(by_plan))
    groups = groups.withColumn("closing", F.col("_t") + F.greatest("start", F.max(F.col("_s") + F.col("_r") - F.col("_t")).over(by_plan)))
    groups = groups.withColumn("opening", F.coalesce(F.lag("closing").over(by_plan), F.col("start")))
    groups = groups.select("plan_id", "_group", "opening", "closing")
    chained = blocks.join(groups.select("plan_id", "_group", F.col("opening").alias("_from")), ["plan_id", "_group"])
    chained = chained.withColumn("closing", F.col("_total") + F.greatest("_from", "_peak"))
    chained = chained.withColumn("opening", F.coalesce(F.lag("closing").over(inside), F.col("_from")))
    return chained.select("plan_id", "cell", "part", "opening", "closing"), groups


def _counted(counting: DataFrame, meta: DataFrame, cell: int, most: int) -> DataFrame:
    rows = _block_rows(counting, cell, most)
    opening = chain_blocks(fold_blocks(rows), meta)[0].select("plan_id", "cell", "part", "opening")
    in_block = Window.partitionBy("plan_id", "cell", "part").orderBy("ts", "event_id")
    zero = F.lit(0).cast("bigint")
    below = F.least(F.col("opening") + F.col("low"), zero)
    below_earlier = F.least(F.col("opening") + F.col("_low_before"), zero)
    return (
        rows.withColumn("_low_before", F.coalesce(F.lag("low").over(in_block), zero))
        .join(opening, ["plan_id", "cell", "part"])
        .select(
            "plan_id",
            "ts",
            "event_id",
            "delta",
            (F.col("opening") + F.col("sum") - below).alias("subscription_count"),
            (below == below_earlier).alias("applied"),
        )
    )


def clamped_counter(events: DataFrame, meta: DataFrame, cell: int = HOUR, most: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Subscriber count of the plan after every counting event, in order of ``(ts, event_id)``.

    Counts start at ``subscription_count`` and never go below zero: such a cancel is acknowledged
    (``applied`` is false) and changes nothing. Events are folded in blocks of (plan, cell of time, part), each a
    function of the row, and the blocks are chained in a tree of one small pair each, so a plan with a third
    of all events is spread over tasks. Nothing is written or run before the result is asked for.
    """
    counting, _ = _split_events(events, meta)
    return _counted(counting, meta, cell, most)


def plan_subscription_count(events: DataFrame, meta: DataFrame, cell: int = HOUR, most: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Final count of every known plan, including plans without events."""
    counting, _ = _split_events(events, meta)
    return counts_from_pairs(fold_blocks(_block_rows(counting, cell, most)), meta)


def counts_from_pairs(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Count of every known plan after all pairs, including plans without any."""
    _, groups = chain_blocks(pairs, meta)
    final = groups.groupBy("plan_id").agg(F.max_by("closing", "_group").alias("_final"))
    start = count_or_zero(F.col("subscription_count"))
    return (
        meta.select("plan_id", start.alias("_start"))
        .join(final, "plan_id", "left")
        .select("plan_id", F.coalesce("_final", "_start").alias("subscription_count"))
    )


def event_pairs(events: DataFrame) -> DataFrame:
    """(``plan_id``, ``cell``, ``part``, ``shift``, ``floor``) of the created and cancelled events, one pair per plan and second.

    Pairs of several batches of events can be kept and chained at any time (``counts_from_pairs``): an event
    that comes late falls into a second of its own, before those that are there already.
    """
    counting = events.withColumn("delta", event_delta(F.col("event_type"))).filter("delta is not null and plan_id is not null")
    cell = epoch_seconds(F.col("ts"))
    rows = counting.select("plan_id", "ts", "event_id", "delta", cell.alias("cell"), F.lit(0).cast("bigint").alias("part"))
    in_block = Window.partitionBy("plan_id", "cell", "part").orderBy("ts", "event_id")
    return fold_blocks(rows.withColumn("sum", F.sum("delta").over(in_block)).withColumn("low", F.min("sum").over(in_block)))


def event_outcome(events: DataFrame, meta: DataFrame, counts: bool = False) -> DataFrame:
    """Every event as ``applied``, ``acknowledged`` (cancel at zero) or ``error`` (unknown type, or a
    plan without metadata or without a stored count); with ``counts`` also the count after a counting event
    and its ``order``."""
    counting, others = _split_events(events, meta)
    counted = _counted(counting, meta, HOUR, EVENTS_PER_BLOCK)
    outcome = F.when(F.col("applied"), "applied").otherwise("acknowledged").alias("outcome")
    kind = F.when(F.col("delta") > 0, CREATED).otherwise(CANCELLED).alias("event_type")
    columns, spare = ["event_id", "plan_id", kind, outcome], []
    if counts:
        packed = packed_order(counted, ("ts", "event_id"))
        order = (F.struct("ts", "event_id") if packed is None else packed).alias("order")
        counted = counted.withColumn("order", order)
        columns += ["subscription_count", "order"]
        spare = [F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in ("subscription_count", "order")]
    return counted.select(*columns).unionByName(others.select("event_id", "plan_id", "event_type", F.lit("error").alias("outcome"), *spare))


def filter_has_attr(rows: DataFrame, attribute: str) -> DataFrame:
    return rows.filter(F.col(attribute).isNotNull())


def nested_attr_or_null(entries: Column, key: Column, attribute: str) -> Column:
    """Attribute of a map entry, null when the key or the attribute is missing."""
    return F.try_element_at(entries, key)[attribute]
