"""Top-k breakdowns with percentages.

A breakdown is one grouped aggregate, reduced on the map side, so a key with a third of all rows
costs one row per task. The grand total is a second aggregate over the same groups; it reads every
column of the groups, so both branches have the same plan and share one shuffle. Ranking keeps only
the best rows of each task before they are moved (``row_number`` with a literal bound).
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import percent_half_even
from ..functions.clock import format_duration
from .nested import server_place

# Rows kept per breakdown, and the eight breakdowns of the statistics page
# (segment, dimension, measure, metric name, count name).
TOP = 9
SEGMENTS = (
    ("Instances By Version", "version", "rows", "Version", "Instances"),
    ("Servers By Game", "game", "rows", "Game", "Servers"),
    ("Players By Game", "game", "amount", "Game", "Players"),
    ("Servers By Game Type", "gametype", "rows", "Game Type", "Servers"),
    ("Players By Game Type", "gametype", "amount", "Game Type", "Players"),
    ("Servers By Map", "map", "rows", "Map", "Servers"),
    ("Players By Map", "map", "amount", "Map", "Players"),
    ("Uptime By Instance", "ip_address", "amount", "IP Address", "Uptime"),
)


def _earliest(order: Sequence[str]) -> Column:
    return F.min(F.col(order[0]) if len(order) == 1 else F.struct(*order))


def count_by_key(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    count_by: str | None = None,
    sort_by: str = "count",
    limit: int = TOP,
    metric_name: str = "Metric",
    metric_count: str = "Count",
    formatter: Callable[[Column], Column] | None = None,
    key_class: str | None = None,
) -> DataFrame:
    """The ``limit`` largest groups of ``key`` with their share of the total over all rows.

    The measure is the row count, or the sum of ``count_by`` (0 where it is missing). Equal measures
    keep the order in which their key first occurs along ``order``, whose columns must not be null.
    ``formatter`` is applied to the counts that are kept. Keys of different ``key_class``, such as the
    number 1 and the text "1", are different groups.
    """
    if count_by is None:
        measure = F.count(F.lit(1))
    elif count_by in rows.columns:
        measure = F.sum(F.coalesce(F.col(count_by), F.lit(0)).cast("bigint"))
    else:
        measure = F.sum(F.lit(0).cast("bigint"))
    apart = [F.col(key_class).alias("_class")] if key_class else []
    groups = rows.groupBy(F.col(key).alias("key"), *apart).agg(
        measure.alias("count"), _earliest(order).alias("_first")
    )
    seen = F.col("_first").isNotNull()
    total = groups.agg(F.sum(F.when(seen, F.col("count"))).alias("total")).scalar()
    shares = groups.withColumn("total", total).withColumn(
        "percent", percent_half_even(F.col("count"), F.col("total"))
    )
    best = shares.orderBy(F.desc(sort_by), F.asc("_first")).limit(limit)
    count = formatter(F.col("count")) if formatter else F.col("count")
    return best.select(
        "key",
        count.alias("count"),
        "total",
        "percent",
        F.lit(metric_name).alias("metric_name"),
        F.lit(metric_count).alias("metric_count"),
    )


def _facts(instances: DataFrame) -> DataFrame:
    """(dim, key, kind, amount, seq) of every instance and server, from one explode.

    ``seq`` orders instances by position and servers by position inside their instance.
    """

    kind = F.col("version_kind") if "version_kind" in instances.columns else F.lit(None).cast("string")

    def fact(dim: str, key: Column, amount: Column, seq: Column) -> Column:
        return F.struct(
            F.lit(dim).alias("dim"),
            key.cast("string").alias("key"),
            (kind if dim == "version" else F.lit(None).cast("string")).alias("kind"),
            amount.cast("bigint").alias("amount"),
            seq.alias("seq"),
        )

    base = server_place(F.col("instance_seq"), F.lit(0))
    own = F.array(
        fact("version", F.col("version"), F.lit(0), base),
        fact("ip_address", F.col("ip_address"), F.col("uptime"), base),
    )
    nested = F.flatten(
        F.transform(
            "servers",
            lambda s, i: F.array(
                *[fact(d, s[d], s["clientnum"], server_place(F.col("instance_seq"), i)) for d in ("game", "gametype", "map")]
            ),
        )
    )
    facts = F.concat(own, F.coalesce(nested, F.slice(own, 1, 0)))
    return instances.select(F.explode(facts).alias("f")).select("f.*")


def stats_all(instances: DataFrame, limit: int = TOP) -> DataFrame:
    """All eight breakdowns as ``(segment, rank, key, count, percent, metric_name, metric_count)``.

    Rows and players of a dimension come from the same groups, so a server gives three facts for six
    breakdowns, and everything is grouped in one shuffle. ``count`` is text because the uptime
    breakdown shows a duration.
    """
    return stats_of_groups(stats_groups(instances), limit)


def stats_groups(instances: DataFrame) -> DataFrame:
    """(dim, key, kind, rows, amount, first) of every group that the breakdowns count."""
    return _facts(instances).groupBy("dim", "key", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"), F.min("seq").alias("first")
    )


def changed_groups(groups: DataFrame, left: DataFrame, came: DataFrame, current: DataFrame) -> DataFrame:
    """``groups`` after some instances ``left`` and others ``came``; a changed instance does both.

    Counts and sums take the changes with a sign. The first place of a group is the least of the old one and those
    that came; a group whose first member left looks it up among the ``current`` instances, and only such a group.
    Groups without members drop out.
    """
    keys = ["dim", "key", "kind"]
    signed = _facts(left).withColumn("sign", F.lit(-1)).unionByName(_facts(came).withColumn("sign", F.lit(1)))
    changes = signed.groupBy(*keys).agg(
        F.sum("sign").alias("d_rows"),
        F.sum(F.col("sign") * F.col("amount")).alias("d_amount"),
        F.min(F.when(F.col("sign") > 0, F.col("seq"))).alias("first_in"),
        F.min(F.when(F.col("sign") < 0, F.col("seq"))).alias("first_out"),
    )
    # Changes and states of a group meet in one aggregate; a join would need two sides without nulls.
    states = groups.select(*keys, "rows", "amount", "first")
    both = states.unionByName(changes, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("rows", "amount", "d_rows", "d_amount")], *[F.min(c).alias(c) for c in ("first", "first_in", "first_out")]
    )
    zero = F.lit(0).cast("bigint")
    merged = both.withColumns(
        {
            "rows": F.coalesce("rows", zero) + F.coalesce("d_rows", zero),
            "amount": F.when(F.col("amount").isNotNull() | F.col("d_amount").isNotNull(), F.coalesce("amount", zero) + F.coalesce("d_amount", zero)),
            "lost": F.coalesce(F.col("first_out") <= F.col("first"), F.lit(False)),
        }
    ).filter("rows > 0")
    kept = merged.filter("not lost").withColumn("first", F.least("first", "first_in")).select(*keys, "rows", "amount", "first")
    lost = merged.filter("lost").select(*[F.col(c).alias(f"l_{c}") for c in (*keys, "rows", "amount")])
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in keys]
    found = _facts(current).join(lost, same).groupBy(*keys).agg(F.max("l_rows").alias("rows"), F.max("l_amount").alias("amount"), F.min("seq").alias("first"))
    return kept.unionByName(found)


def stats_of_groups(groups: DataFrame, limit: int = TOP) -> DataFrame:
    """The eight breakdowns of counted groups; see ``stats_all``."""
    # One row per dimension, which is a fixed list, so this side is safe to broadcast.
    seen = F.col("first").isNotNull()
    totals = groups.groupBy("dim").agg(
        F.sum(F.when(seen, F.col("rows"))).alias("rows_total"),
        F.sum(F.when(seen, F.col("amount"))).alias("amount_total"),
    )
    segments = F.array(
        *[
            F.when(
                F.col("dim") == dim,
                F.struct(
                    F.lit(segment).alias("segment"),
                    F.col(measure).alias("measure"),
                    F.col(f"{measure}_total").alias("total"),
                    F.lit(metric_name).alias("metric_name"),
                    F.lit(metric_count).alias("metric_count"),
                ),
            )
            for segment, dim, measure, metric_name, metric_count in SEGMENTS
        ]
    )
    rows = (
        groups.join(F.broadcast(totals), "dim")
        .select("key", "first", F.explode(F.filter(segments, lambda s: s.isNotNull())).alias("s"))
        .select("key", "first", "s.*")
    )
    best = Window.partitionBy("segment").orderBy(F.desc("measure"), F.asc("first"))
    ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    shown = F.when(F.col("segment") == "Uptime By Instance", format_duration(F.col("measure")))
    return ranked.select(
        "segment",
        "rank",
        "key",
        shown.otherwise(F.col("measure").cast("string")).alias("count"),
        percent_half_even(F.col("measure"), F.col("total")).alias("percent"),
        "metric_name",
        "metric_count",
    )
