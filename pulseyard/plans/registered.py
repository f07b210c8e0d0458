"""Registered queries: every operator over the given tables.

Timestamps are shown as epoch seconds and arrays as text, so that results compare across engines.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import (
    breakdown,
    ingest,
    nested,
    registry,
    subscriptions,
    timeseries,
    translations,
    versions,
)
from ..session import stored
from ..sources import readers, writers
from . import bindings as b
from . import pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _seconds(name: str) -> Column:
    return F.unix_seconds(name).alias(name)


def _registry(spark, folder, position=False) -> DataFrame:
    return registry.current_registry(
        b.heartbeats(spark, folder), b.NOW, expiry=b.STATS_EXPIRY, sweep=b.STATS_SWEEP, position=position
    )


def _servers(spark, folder) -> DataFrame:
    servers = nested.flatten_nested(_registry(spark, folder, position=True))
    return servers.withColumn("place", nested.server_place(F.col("instance_seq"), F.col("pos")))


def _all_servers(spark, folder) -> DataFrame:
    servers = nested.flatten_nested(b.heartbeats(spark, folder), parents=("seq",))
    return servers.withColumn("place", nested.server_place(F.col("seq"), F.col("pos")))


def _census(spark, folder, dense=False, tick=b.CENSUS_TICK) -> DataFrame:
    return timeseries.census_at_ticks(
        b.heartbeats(spark, folder),
        tick=tick,
        expiry=b.CENSUS_EXPIRY,
        sweep=b.CENSUS_SWEEP,
        dense=dense,
    )


def _history(spark, folder) -> DataFrame:
    return timeseries.census_to_history(_census(spark, folder))


def _validated(spark, folder) -> DataFrame:
    return ingest.validate_heartbeats(b.heartbeat_bodies(spark, folder))


def _error_text(errors: str = "errors") -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat(e["path"], F.lit(":"), e["message"])), ";")


def _accepted_servers(spark, folder, *columns: str) -> DataFrame:
    rows = ingest.accepted(_validated(spark, folder)).select("seq", F.posexplode("servers").alias("pos", "s"))
    return rows.select("seq", F.col("pos").cast("bigint").alias("pos"), *[f"s.{c}" for c in columns])


# Sources -------------------------------------------------------------------------------------


@query
def src_heartbeat_json(spark, folder):
    parsed = ingest.parse_heartbeats(b.heartbeat_bodies(spark, folder))
    return parsed.select(
        "seq",
        "remote_ip",
        F.unix_seconds("received_at").alias("received_at"),
        F.col("doc").isNotNull().alias("is_object"),
        F.size("servers").cast("bigint").alias("n_servers"),
    )


@query
def src_plans(spark, folder):
    return subscriptions.active_plans(b.plans(spark, folder)).select("id", "name", "price", "status")


@query
def limit_n(spark, folder):
    return subscriptions.active_plans(b.plans(spark, folder), limit=100).select("id", "name")


@query
def first_match(spark, folder):
    return subscriptions.first_customer(b.customers(spark, folder))


@query
def src_customer_by_email(spark, folder):
    asked = b.content_requests(spark, folder).select("email")
    found = subscriptions.customers_by_email(asked, b.customers(spark, folder))
    return found.select("email", "id", F.col("position").cast("bigint").alias("position"))


@query
def src_subscriptions_active(spark, folder):
    return subscriptions.active_subscriptions(b.subscriptions(spark, folder)).select("customer_id", "plan_id")


@query
def src_plans_by_ids(spark, folder):
    owned = subscriptions.active_subscriptions(b.subscriptions(spark, folder))
    return subscriptions.subscribed_plans(b.plans(spark, folder), owned).select("id", "name", "status")


@query
def src_meta_get(spark, folder):
    return readers.meta_get(b.plan_meta(spark, folder)).select("plan_id", "subscription_count", "author", "content_url")


@query
def src_subscription_events(spark, folder):
    parsed = readers.parse_subscription_events(b.subscription_event_bodies(spark, folder))
    return parsed.select("event_id", "event_type", "plan_id", "error")


# Sinks and exports -----------------------------------------------------------------------------


@query
def sink_version_update(spark, folder):
    updated = versions.apply_version_updates(b.version_config(spark, folder), b.version_updates(spark, folder))
    return updated.withColumn("api_version", F.col("api_version").cast("bigint"))


@query
def sink_meta_set(spark, folder):
    meta = b.plan_meta(spark, folder)
    counts = subscriptions.plan_subscription_count(b.subscription_events(spark, folder), meta)
    changed = meta.drop("subscription_count").join(counts, "plan_id")
    return writers.meta_set(meta, changed).select("plan_id", "subscription_count", "author")


@query
def export_instances(spark, folder):
    exported = registry.export_instances(_registry(spark, folder))
    return exported.select(
        "id",
        "version",
        F.col("uptime").cast("bigint").alias("uptime"),
        "last_heartbeat",
        "ip_address",
        "webfront_url",
        F.array_join(F.transform("servers", lambda s: s["hostname"]), ",").alias("hostnames"),
    )


@query
def export_instance_by_id(spark, folder):
    found = registry.export_instance_by_id(b.instance_requests(spark, folder), _registry(spark, folder))
    return found.select("o_orderkey", "id", "found", "last_heartbeat")


@query
def reject_quarantine(spark, folder):
    _, bad = ingest.reject_quarantine(b.heartbeat_bodies(spark, folder))
    return bad.select("seq", "remote_ip", _error_text().alias("errors"))


# Repair and validation --------------------------------------------------------------------------


@query
def validate_heartbeat(spark, folder):
    return _validated(spark, folder).select(
        "seq", (F.size("errors") == 0).alias("accepted"), _error_text().alias("errors")
    )


@query
def coerce_types(spark, folder):
    return _accepted_servers(spark, folder, "id", "clientnum", "maxclientnum").select(
        "seq", "pos", "id", F.col("clientnum").cast("bigint").alias("clientnum"),
        F.col("maxclientnum").cast("bigint").alias("maxclientnum"),
    )


@query
def fix_server_ip(spark, folder):
    return _accepted_servers(spark, folder, "ip")


@query
def fix_server_version(spark, folder):
    return _accepted_servers(spark, folder, "version")


@query
def fix_port(spark, folder):
    return _accepted_servers(spark, folder, "port").withColumn("port", F.col("port").cast("bigint"))


@query
def apply_defaults(spark, folder):
    return _accepted_servers(spark, folder, "gametype")


@query
def stamp_sender(spark, folder):
    return ingest.accepted(_validated(spark, folder)).select("seq", "id", "ip_address", "webfront_url")


@query
def stamp_received(spark, folder):
    return ingest.accepted(_validated(spark, folder)).select("seq", "id", "last_heartbeat")


@query
def array_length_check(spark, folder):
    good = ingest.accepted(_validated(spark, folder))
    return good.select("seq", F.size("servers").cast("bigint").alias("n_servers"))


@query
def normalize_webfront(spark, folder):
    return b.raw_urls(spark, folder).select(
        "page_id", fn.normalize_webfront(F.col("url"), F.lit(b.REMOTE_IP)).alias("webfront_url")
    )


@query
def url_parts(spark, folder):
    parts = b.raw_urls(spark, folder).select("page_id", fn.url_parts(F.col("url")).alias("p"))
    return parts.select("page_id", "p.origin", "p.host", "p.rest")


@query
def is_non_public(spark, folder):
    ip = F.concat_ws(
        ".", F.pmod("event_id", F.lit(260)), F.pmod("k", F.lit(256)), F.pmod("user_id", F.lit(256)), F.lit(9)
    )
    events = b._events(spark, folder)
    return events.select("event_id", ip.alias("ip"), fn.is_non_public(ip).alias("non_public"))


@query
def require_params(spark, folder):
    checked = subscriptions.require_params(b.content_requests(spark, folder))
    return checked.groupBy("email", "instance_id", "error").agg(F.count(F.lit(1)).alias("requests"))


@query
def filter_has_attr(spark, folder):
    joined = b.plans(spark, folder).join(b.plan_meta(spark, folder), F.col("id") == F.col("plan_id"), "left")
    return subscriptions.filter_has_attr(joined, "content_url").select("id", "content_url")


@query
def nested_attr_or_null(spark, folder):
    kind = F.create_map(
        F.lit("signup"), F.struct(F.col("user_id").alias("n")), F.lit("view"), F.struct(F.col("event_id").alias("n"))
    )
    n = subscriptions.nested_attr_or_null(kind, F.col("event_type"), "n")
    return b._events(spark, folder).select("event_id", n.alias("n"))


# Joins and lookups --------------------------------------------------------------------------------


@query
def flatten_nested(spark, folder):
    return _servers(spark, folder).select(
        "instance_seq", F.col("pos").cast("bigint").alias("pos"), "id", "game", "map",
        F.col("clientnum").cast("bigint").alias("clientnum"),
    )


@query
def filter_webfront_present(spark, folder):
    beats = b.heartbeats(spark, folder).withColumn(
        "instance_webfront_url", F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.col("webfront_url"))
    )
    return nested.webfront_link(beats).select("seq", "webfront")


@query
def attach_parent(spark, folder):
    return nested.attach_parent(_registry(spark, folder), key="seq").select(
        "id", "game", "instance_id", "instance_ip_address", "instance_version", "instance_last_heartbeat"
    )


@query
def plan_catalogue(spark, folder):
    return subscriptions.plan_catalogue(b.plans(spark, folder), b.plan_meta(spark, folder))


@query
def plan_catalogue_strict(spark, folder):
    listed = subscriptions.plan_catalogue(b.plans(spark, folder), b.plan_meta(spark, folder), strict=True)
    return listed.select("id", "name", "author", "subscribers")


@query
def entitlements(spark, folder):
    asked = b.content_requests(spark, folder).select("email").distinct()
    owned = subscriptions.entitlements(
        asked, b.customers(spark, folder), b.subscriptions(spark, folder), b.plan_meta(spark, folder)
    )
    return owned.select("email", "customer_id", "plan_id", "content_url")


@query
def in_list(spark, folder):
    owned = subscriptions.active_subscriptions(b.subscriptions(spark, folder))
    return subscriptions.subscribed_plans(b.plans(spark, folder), owned).select("id")


@query
def exists_by_key(spark, folder):
    found = registry.exists_by_key(b.instance_requests(spark, folder), _registry(spark, folder))
    return found.select("o_orderkey", "id", "found")


@query
def registry_as_of(spark, folder):
    asked = b.timed_requests(spark, folder)
    return registry.registry_as_of(asked, b.heartbeats(spark, folder), expiry=b.STATS_EXPIRY, sweep=b.STATS_SWEEP)


@query
def not_found_by_key(spark, folder):
    return registry.not_found_by_key(b.instance_requests(spark, folder), _registry(spark, folder))


@query
def translation_lookup(spark, folder):
    parts = b.sheet(spark, folder)
    sets = translations.translation_sets(parts)
    language = F.when(F.col("row") % 2 == 0, "fr-FR").otherwise("de-CH")
    rows = parts.select("row", F.col("STRING").alias("key"), language.alias("language"))
    return translations.translation_lookup(rows, sets)


# Breakdowns ----------------------------------------------------------------------------------------


@query
def count_by_key(spark, folder):
    servers = _all_servers(spark, folder)
    return breakdown.count_by_key(servers, "map", ("place",), "clientnum", metric_name="Map", metric_count="Players")


def _stat(name: str, key: str, count_by: str | None, metric: str, count: str, of_servers: bool, formatter=None):
    def run(spark, folder):
        rows = _servers(spark, folder) if of_servers else _registry(spark, folder, position=True)
        order = ("place",) if of_servers else ("instance_seq",)
        return breakdown.count_by_key(
            rows, key, order, count_by, metric_name=metric, metric_count=count, formatter=formatter,
            key_class="version_kind" if key == "version" else None,
        )

    QUERIES[name] = run


_stat("stat_instances_by_version", "version", None, "Version", "Instances", False)
_stat("stat_servers_by_game", "game", None, "Game", "Servers", True)
_stat("stat_players_by_game", "game", "clientnum", "Game", "Players", True)
_stat("stat_servers_by_gametype", "gametype", None, "Game Type", "Servers", True)
_stat("stat_players_by_gametype", "gametype", "clientnum", "Game Type", "Players", True)
_stat("stat_servers_by_map", "map", None, "Map", "Servers", True)
_stat("stat_players_by_map", "map", "clientnum", "Map", "Players", True)
_stat("stat_uptime_by_ip", "ip_address", "uptime", "IP Address", "Uptime", False, fn.format_duration)


@query
def formatter_callback(spark, folder):
    beats = b.heartbeats(spark, folder)
    return breakdown.count_by_key(beats, "id", ("seq",), "uptime", formatter=fn.format_duration)


@query
def top_k_stable(spark, folder):
    return breakdown.count_by_key(_all_servers(spark, folder), "gametype", ("place",), limit=3)


@query
def stats_all(spark, folder):
    return breakdown.stats_all(_registry(spark, folder, position=True)).withColumn("rank", F.col("rank").cast("bigint"))


@query
def fleet_totals(spark, folder):
    return nested.fleet_totals(_registry(spark, folder))


@query
def instance_count(spark, folder):
    return registry.instance_count(_registry(spark, folder))


@query
def game_summary(spark, folder):
    return nested.game_summary(nested.flatten_nested(_registry(spark, folder), parents=("seq",)))


@query
def group_servers(spark, folder):
    grouped = nested.group_servers(_servers(spark, folder))
    return grouped.select("game", "instance_seq", F.col("pos").cast("bigint").alias("pos"), "id")


def _placed_servers(spark, folder) -> DataFrame:
    servers = nested.flatten_nested(b.heartbeats(spark, folder).withColumnRenamed("seq", "instance_seq"))
    return servers.withColumn("place", nested.server_place(F.col("instance_seq"), F.col("pos")))


@query
def sort_by_game(spark, folder):
    servers = nested.row_before(_placed_servers(spark, folder))
    return nested.sort_by_game(servers).select("game", "instance_seq", "id", "follows")


@query
def sort_by_players(spark, folder):
    servers = nested.row_before(_placed_servers(spark, folder), falling="clientnum")
    clients = F.col("clientnum").cast("bigint").alias("clientnum")
    return nested.sort_by_players(servers).select("game", "instance_seq", clients, "id", "follows")


@query
def translation_sets(spark, folder):
    return translations.translation_sets(b.sheet(spark, folder))


# Time series and state ------------------------------------------------------------------------------


@query
def upsert_latest(spark, folder):
    latest = registry.upsert_latest(b.heartbeats(spark, folder))
    return latest.select("id", _seconds("received_at"), "seq", "version", F.size("servers").cast("bigint").alias("n_servers"))


@query
def expire_stale(spark, folder):
    alive = registry.live_rows(b.heartbeats(spark, folder), b.NOW, expiry=b.CENSUS_EXPIRY, sweep=0)
    return alive.select("id", "last_heartbeat", "seq")


@query
def online_sessions(spark, folder):
    return registry.online_sessions(b.heartbeats(spark, folder), expiry=b.CENSUS_EXPIRY)


@query
def registry_lifetimes(spark, folder):
    return registry.online_sessions(b.heartbeats(spark, folder), expiry=b.CENSUS_EXPIRY, sweep=b.CENSUS_SWEEP)


@query
def census_at_ticks(spark, folder):
    return _census(spark, folder, dense=True)


@query
def append_sample(spark, folder):
    count = F.floor("value").cast("bigint").alias("count")
    samples = b._events(spark, folder).select(F.col("ts").alias("time"), count)
    grown = timeseries.append_sample(_history(spark, folder), samples, "client")
    return grown.groupBy("metric", _seconds("time")).agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("samples")
    )


@query
def retain_last_n(spark, folder):
    kept = timeseries.retain_last_n(_history(spark, folder), 300)
    return kept.select("metric", _seconds("time"), "count")


@query
def fill_gaps(spark, folder):
    census = timeseries.census_to_history(_census(spark, folder, tick=b.ACTIVITY_STEP))
    history = stored(census.unionByName(b.activity(spark, folder)))  # read three times
    filled = timeseries.fill_gaps(history, b.ACTIVITY_STEP)
    return filled.select("metric", _seconds("time"), "count")


@query
def fill_after_stop(spark, folder):
    filled = timeseries.fill_after_stop(_history(spark, folder), b.NOW + 100_000, b.CENSUS_TICK)
    return filled.select("metric", _seconds("time"), "count")


@query
def slice_stride(spark, folder):
    sliced = timeseries.slice_stride(_history(spark, folder), start=37, points=50)
    return sliced.select("metric", "idx", _seconds("time"), "count")


@query
def zoom_points(spark, folder):
    return timeseries.zoom_points(_history(spark, folder), start=37, points=50)


@query
def last_value(spark, folder):
    return timeseries.last_value(timeseries.slice_stride(_history(spark, folder), start=37, points=50))


@query
def history_series(spark, folder):
    sliced = timeseries.slice_stride(_history(spark, folder), start=37, points=50)
    return timeseries.history_series(sliced, b.NOW).select("metric", "idx", _seconds("time"), "value", "label")


@query
def first_label(spark, folder):
    sliced = timeseries.slice_stride(_history(spark, folder), start=37, points=50)
    return timeseries.first_label(timeseries.history_series(sliced, b.NOW))


@query
def clamped_counter(spark, folder):
    counted = subscriptions.clamped_counter(b.subscription_events(spark, folder), b.plan_meta(spark, folder))
    return counted.select("plan_id", "event_id", "delta", "subscription_count", "applied")


@query
def event_outcome(spark, folder):
    return subscriptions.event_outcome(b.subscription_events(spark, folder), b.plan_meta(spark, folder))


@query
def plan_subscription_count(spark, folder):
    return subscriptions.plan_subscription_count(b.subscription_events(spark, folder), b.plan_meta(spark, folder))


@query
def token_registry(spark, folder):
    held = registry.token_registry(b.tokens(spark, folder))
    return held.select("id", "token", _seconds("issued_at"), _seconds("expires_at"))


# Languages --------------------------------------------------------------------------------------------


@query
def resolve_language(spark, folder):
    languages = translations.sheet_languages(b.sheet(spark, folder))
    resolved = translations.resolve_language(F.col("tag"), languages)
    return b.tag_requests(spark, folder).select("doc_id", "tag", resolved.alias("language"))


@query
def translation_for_tag(spark, folder):
    return translations.translation_for_tag(b.tag_requests(spark, folder), b.sheet(spark, folder))


@query
def translation_default(spark, folder):
    untagged = b.tag_requests(spark, folder).filter(F.col("tag").isNull())
    return translations.translation_for_tag(untagged, b.sheet(spark, folder)).select("language", "key", "text")


# Scalars ------------------------------------------------------------------------------------------------


@query
def strip_color_codes(spark, folder):
    part = b.table(spark, folder, "part")
    name = F.concat(F.lit("^"), (F.col("p_size") % 10).cast("string"), F.col("p_name"), F.lit("^:"))
    return part.select("p_partkey", fn.strip_color_codes(name).alias("hostname"))


@query
def regex_replace(spark, folder):
    customer = b.table(spark, folder, "customer")
    return customer.select("c_custkey", fn.regex_replace(F.col("c_name"), r"(\w+)#0*(\d*)", r"\2 \1").alias("name"))


@query
def format_duration(spark, folder):
    seconds = F.floor(F.col("value") * 1000).cast("bigint")
    return b._events(spark, folder).select("event_id", fn.format_duration(seconds).alias("duration"))


@query
def uptime_clock(spark, folder):
    seconds = F.floor(F.col("value") * 1000).cast("bigint")
    return b._events(spark, folder).select("event_id", fn.uptime_clock(seconds).alias("clock"))


@query
def time_ago(spark, folder):
    label = fn.time_ago(fn.epoch_seconds(F.col("ts")), F.lit(b.NOW))
    return b._events(spark, folder).select("event_id", label.alias("label"))


@query
def epoch_truncate(spark, folder):
    return b._events(spark, folder).select("event_id", fn.epoch_seconds(F.col("ts")).alias("t"))


@query
def percent_half_even(spark, folder):
    percent = fn.percent_half_even(F.col("k"), F.pmod("user_id", F.lit(9)))
    return b._events(spark, folder).select("event_id", percent.alias("percent"))


@query
def ceil_div(spark, folder):
    return b._events(spark, folder).select("event_id", fn.ceil_div(F.col("event_id") - 500, F.lit(30)).alias("n"))


@query
def mask16(spark, folder):
    return b._events(spark, folder).select("event_id", fn.mask16((F.col("event_id") - 9) * 997).alias("n"))


@query
def occupancy_label(spark, folder):
    servers = nested.flatten_nested(b.heartbeats(spark, folder), parents=("seq",))
    label = fn.occupancy_label(F.col("clientnum"), F.col("maxclientnum"))
    return servers.select("id", label.alias("occupancy"))


@query
def connect_string(spark, folder):
    servers = nested.flatten_nested(b.heartbeats(spark, folder), parents=("seq",))
    return servers.select("id", fn.connect_string(F.col("ip"), F.col("port")).alias("connect"))


@query
def cents_to_text(spark, folder):
    orders = b.table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return orders.select("o_orderkey", fn.cents_to_text(cents).alias("price"))


@query
def price_label(spark, folder):
    plans = b.plans(spark, folder)
    label = fn.price_label(fn.cents_to_text(F.col("price")), F.col("period_unit"))
    return plans.select("id", label.alias("label"))


@query
def count_or_zero(spark, folder):
    meta = b.plan_meta(spark, folder)
    return meta.select("plan_id", fn.count_or_zero(F.col("subscription_count")).alias("subscribers"))


@query
def content_type(spark, folder):
    kind = fn.content_type(F.col("content_url")).cast("bigint")
    return b.plan_meta(spark, folder).select("plan_id", kind.alias("type"))


@query
def base64_encode(spark, folder):
    text = b.table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return text.select("doc_id", F.md5(fn.base64_encode(F.col("bytes"))).alias("digest"))


@query
def json_nested_field(spark, folder):
    parsed = readers.parse_subscription_events(b.subscription_event_bodies(spark, folder))
    return parsed.filter(F.col("error").isNull()).select("event_id", "plan_id")


@query
def register_sql_functions(spark, folder):
    fn.register_sql_functions(spark, "py_")
    b.heartbeats(spark, folder).createOrReplaceTempView("py_heartbeats")
    return spark.sql(
        """SELECT seq, py_format_duration(uptime) AS duration, py_uptime_clock(uptime) AS clock,
                  py_mask16(uptime) AS masked, py_ceil_div(uptime, 30) AS slots,
                  py_ceil_div(9007199254740993L + seq, 1L) AS large, py_regex_replace(id, '(i)([0-9]+)', '\\\\2-\\\\1') AS swapped,
                  py_strip_color_codes(concat('^', seq, id, '^:')) AS plain, py_occupancy_label(CAST(seq % 9 AS INT), 9) AS occupancy,
                  py_connect_string(ip_address, 7) AS connect, py_cents_to_text(seq) AS price, py_price_label('0.00', id) AS free,
                  py_count_or_zero(nullif(seq % 3, 0)) AS counted, py_content_type(concat(id, '.DLL')) AS kind,
                  py_percent_half_even(seq % 7, 8) AS percent,
                  py_is_non_public(concat_ws('.', seq % 260, 64 + seq % 70, seq % 256, 9)) AS non_public,
                  py_is_non_public(concat('fe', seq % 90, '::', seq % 10)) AS non_public_6, py_url_parts(webfront_url).host AS host,
                  py_time_ago(py_epoch_truncate(received_at), 1706659200L) AS age, py_epoch_truncate(received_at) AS t,
                  py_base64_encode(encode(id, 'UTF-8')) AS coded,
                  length(py_seal_content(encode(id, 'UTF-8'), unhex(sha2(id, 256)))) AS sealed_bytes,
                  py_json_nested_field(concat('{"a":{"b":"', id, '"}}'), '$.a.b') AS inner_field, py_array_length_check(size(servers)) AS fits
           FROM py_heartbeats"""
    )


@query
def seal_content(spark, folder):
    """Sealed content opened again with the same key."""
    rows = b.contents(spark, folder).withColumn("key", F.unhex(F.sha2("content_url", 256)))
    sealed = rows.withColumn("sealed", fn.seal_content(F.col("payload"), F.col("key")))
    nonce = F.substring("sealed", F.length("sealed") - 11, F.lit(12))
    cipher = F.substring("sealed", F.lit(1), F.length("sealed") - 12)
    opened = F.aes_decrypt(F.concat(nonce, cipher), F.col("key"), F.lit("GCM"))
    return sealed.select(
        "content_url",
        opened.cast("string").alias("opened"),
        F.length("sealed").cast("bigint").alias("sealed_bytes"),
    )


# Pages ------------------------------------------------------------------------------------------------


@query
def q_server_list(spark, folder):
    listed = pages.server_list(b.heartbeats(spark, folder), b.NOW, b.STATS_EXPIRY, b.STATS_SWEEP)
    return listed.select(
        "game", "hostname", "map", "gametype", "occupancy", "connect", "webfront",
        F.col("clientnum").cast("bigint").alias("clientnum"),
    )


@query
def q_stats(spark, folder):
    page = pages.stats(b.heartbeats(spark, folder), b.NOW, b.STATS_EXPIRY, b.STATS_SWEEP)
    return page.withColumn("rank", F.col("rank").cast("bigint"))


@query
def q_history(spark, folder):
    return pages.history(_history(spark, folder), b.NOW, start=11, keep=600, points=50)


@query
def q_instances(spark, folder):
    listed = pages.instances(b.heartbeats(spark, folder), b.NOW, b.STATS_EXPIRY, b.STATS_SWEEP)
    return listed.select(
        "id", "version", F.col("uptime").cast("bigint").alias("uptime"), "last_heartbeat",
        "ip_address", "webfront_url", F.size("servers").cast("bigint").alias("n_servers"),
    )


@query
def q_versions(spark, folder):
    return pages.version_table(b.version_config(spark, folder), b.version_updates(spark, folder), 1)


@query
def q_translations(spark, folder):
    return pages.translation_page(b.tag_requests(spark, folder), b.sheet(spark, folder))


@query
def q_plans(spark, folder):
    return pages.plan_page(b.plans(spark, folder), b.plan_meta(spark, folder))


def _content(spark, folder) -> DataFrame:
    return pages.content_for_subscribers(
        b.content_requests(spark, folder),
        b.customers(spark, folder),
        b.subscriptions(spark, folder),
        b.plan_meta(spark, folder),
        b.contents(spark, folder),
    )


@query
def q_entitlements(spark, folder):
    """Every item of content a subscriber gets, with the size of its sealed bytes."""
    size = F.length(F.unbase64("content")).cast("bigint")
    return _content(spark, folder).select(
        "email", "instance_id", "plan_id", F.col("type").cast("bigint").alias("type"), size.alias("sealed_bytes")
    )


@query
def q_plan_counts(spark, folder):
    return pages.plan_counts(b.subscription_events(spark, folder), b.plan_meta(spark, folder))
