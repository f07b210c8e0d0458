"""The questions users ask, put together from the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_or_zero
from ..operators import breakdown, nested, registry, subscriptions, timeseries, translations, versions


def server_list(
    heartbeats: DataFrame, now: int, expiry: int = registry.EXPIRY_SECONDS, sweep: int = registry.SWEEP_SECONDS
) -> DataFrame:
    """Servers of all registered instances, by game and most players first."""
    current = registry.current_registry(heartbeats, now, expiry=expiry, sweep=sweep, position=True)
    return nested.sort_by_players(nested.describe_servers(nested.attach_parent(current)))


def stats(
    heartbeats: DataFrame, now: int, expiry: int = registry.EXPIRY_SECONDS, sweep: int = registry.SWEEP_SECONDS
) -> DataFrame:
    """The eight breakdowns of the registered instances."""
    return breakdown.stats_all(registry.current_registry(heartbeats, now, expiry=expiry, sweep=sweep, position=True))


def history(
    samples: DataFrame,
    now: int,
    start: int = 0,
    keep: int = timeseries.MAX_SAMPLES,
    points: int = timeseries.CHART_POINTS,
) -> DataFrame:
    """Plotted samples of the history page beside its zoom points and current values.

    Nothing is written on the way, and retained samples are not made: the slice counts its indexes in them. The
    zoom points follow from the number of retained samples alone.
    """
    sliced = timeseries.beside_last_values(timeseries.slice_stride(samples, start, points, keep=keep))
    total = timeseries.kept_length(samples, keep)
    return timeseries.history_series(sliced, now).select(
        "metric",
        "idx",
        F.unix_seconds("time").alias("t"),
        "value",
        "label",
        timeseries.next_zoom(total, start).alias("next_zoom_point"),
        timeseries.previous_zoom(total, start).alias("previous_zoom_point"),
        *[f"{metric}_count" for metric in timeseries.HISTORY_METRICS],
    )


def instances(
    heartbeats: DataFrame, now: int, expiry: int = registry.EXPIRY_SECONDS, sweep: int = registry.SWEEP_SECONDS
) -> DataFrame:
    return registry.export_instances(registry.current_registry(heartbeats, now, expiry=expiry, sweep=sweep))


def version_table(
    config: DataFrame, updates: DataFrame | None = None, api_version: int = versions.DEFAULT_API_VERSION
) -> DataFrame:
    current = versions.apply_version_updates(config, updates) if updates is not None else config
    return versions.versions_for(current, api_version)


def translation_page(requests: DataFrame, sheet: DataFrame) -> DataFrame:
    return translations.translation_for_tag(requests, sheet)


def plan_page(plans: DataFrame, meta: DataFrame, limit: int | None = None) -> DataFrame:
    """The listed plans with their labels."""
    return subscriptions.plan_catalogue(subscriptions.active_plans(plans, limit), meta)


def content_for_subscribers(
    requests: DataFrame, customers: DataFrame, subs: DataFrame, plan_meta: DataFrame, contents: DataFrame
) -> DataFrame:
    return subscriptions.subscribed_content(requests, customers, subs, plan_meta, contents)


def plan_counts(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Final count of every plan with the number of its events by outcome, from one fold of the events."""
    outcome = F.col("outcome")
    tallies = subscriptions.event_outcome(events, meta, counts=True).groupBy("plan_id").agg(
        F.max_by("subscription_count", "order").alias("_final"),
        *[F.count_if(outcome == name).alias(name) for name in ("applied", "acknowledged", "error")],
    )
    start = count_or_zero(F.col("subscription_count")).alias("_start")
    joined = meta.select("plan_id", start).join(tallies, "plan_id", "left")
    final = F.coalesce("_final", "_start").alias("subscription_count")
    return joined.select("plan_id", final, "applied", "acknowledged", "error").na.fill(0, ["applied", "acknowledged", "error"])
