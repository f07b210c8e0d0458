"""The registered queries as plain SQL over the same tables."""

from ..functions.network import URL_PATTERN

NOW = 1_706_659_200

HB = """
hb AS (
  SELECT event_id AS seq, event_id, user_id, 'i' || user_id AS id, ts, event_type, value,
         epoch_us(ts) // 1000000 AS t,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k,
         CAST(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 5 AS VARCHAR) AS version,
         CAST(floor(value * 1000) AS BIGINT) AS uptime,
         CAST(floor(value) AS BIGINT) AS whole,
         '203.0.113.' || (user_id % 20) AS ip_address,
         'http://h' || (user_id % 9) || '.example.com' AS webfront_url,
         event_id % 4 AS n_servers, event_id % 2 AS kind
  FROM events)"""

SERVER_COLUMNS = """
         event_id * 4 + pos AS server_id, '198.51.100.' || (user_id % 250) AS ip, 28960 + pos AS port,
         event_type AS game, '^' || (k % 10) || 'host ' || event_id || '^:' AS hostname,
         (whole + pos) % 129 AS clientnum, 128 AS maxclientnum, 'map' || ((k + pos) % 12) AS map,
         CASE WHEN (event_id + pos) % 7 <> 0 THEN 'mode' || ((event_id + pos) % 5) END AS gametype"""

SRV = f"""
srv AS (SELECT *, {SERVER_COLUMNS} FROM (SELECT *, unnest(range(n_servers)) AS pos FROM hb))"""


def purge(t: str, expiry: int, sweep: int) -> str:
    if sweep == 0:
        return f"({t} + {expiry} + 1)"
    return f"((({t} + {expiry}) // {sweep} + 1) * {sweep})"


REG = f"""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn FROM hb)
           WHERE rn = 1),
starts AS (SELECT id, seq, ts FROM (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY ts, seq) AS prev FROM hb)
           WHERE prev IS NULL OR t >= {purge("prev", 86400, 7200)}),
seen AS (SELECT id, seq AS instance_seq FROM
           (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn FROM starts) WHERE rn = 1),
reg AS (SELECT latest.*, t AS last_heartbeat, instance_seq FROM latest JOIN seen USING (id)
        WHERE {purge("t", 86400, 7200)} > {NOW})"""

RSRV = f"""
rsrv AS (SELECT *, instance_seq * 64 + pos AS place, {SERVER_COLUMNS}
         FROM (SELECT *, unnest(range(n_servers)) AS pos FROM reg))"""

WITH_HB = f"WITH {HB}"
WITH_SRV = f"WITH {HB},{SRV}"
WITH_REG = f"WITH {HB},{REG}"
WITH_RSRV = f"WITH {HB},{REG},{RSRV}"


def census(tick: int) -> str:
    return f"""
beats AS (SELECT *, coalesce(list_sum([(whole + j) % 129 FOR j IN range(n_servers)]), 0) AS clients FROM hb),
spans AS (SELECT t, clients, n_servers, (t + {tick - 1}) // {tick} * {tick} AS first_tick,
                 least(coalesce(lead(t) OVER (PARTITION BY id ORDER BY ts, seq), 9223372036854775807),
                       {purge("t", 21600, 7200)}) AS until_t
          FROM beats),
counted AS (SELECT tick, CAST(sum(clients) AS BIGINT) AS clients, count(*) AS instances,
                   CAST(sum(n_servers) AS BIGINT) AS servers
            FROM (SELECT *, unnest(range(first_tick, until_t, {tick})) AS tick FROM spans) GROUP BY tick)"""


CENSUS = census(3600)

HISTORY = """
history AS (SELECT 'client' AS metric, tick AS time, clients AS count FROM counted
            UNION ALL SELECT 'instance', tick, instances FROM counted
            UNION ALL SELECT 'server', tick, servers FROM counted)"""

WITH_HISTORY = f"WITH {HB},{CENSUS},{HISTORY}"


def sliced(source: str, start: int, points: int) -> str:
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY time, count) - 1 AS idx FROM {source}),
size AS (SELECT count(*) AS n FROM {source} WHERE metric = 'instance'),
stride AS (SELECT n, greatest(1, CAST(ceil((n - {start}) / {points}.0) AS BIGINT)) AS step FROM size),
sliced AS (SELECT metric, idx, time, count FROM numbered, stride WHERE idx >= {start} AND (idx - {start}) % step = 0)"""


def label(age: str) -> str:
    """Age text from seconds, by unit thresholds in seconds."""
    # unit, seconds per unit, seconds at which the next unit takes over
    month = 86400 * 7 * (365.0 / 7.0 / 12.0)
    units = [
        ("second", 1, 60),
        ("minute", 60, 3600),
        ("hour", 3600, 86400),
        ("day", 86400, 604800),
        ("week", 604800, month),
        ("month", month, month * 12),
        ("year", month * 12, None),
    ]
    text = f"CASE WHEN {age} < 10 THEN 'just now'"
    for unit, size, upper in units:
        n = f"CAST(floor(({age}) / {size}) AS BIGINT)"
        shown = f"{n} || CASE WHEN {n} = 1 THEN ' {unit} ago' ELSE ' {unit}s ago' END"
        text += f" WHEN {age} < {upper} THEN {shown}" if upper else f" ELSE {shown} END"
    return text


def duration(s: str) -> str:
    clock = f"printf('%d:%02d:%02d', ({s}) % 86400 // 3600, ({s}) % 3600 // 60, ({s}) % 60)"
    days = f"(({s}) // 86400)"
    return (
        f"CASE {days} WHEN 0 THEN {clock} WHEN 1 THEN '1 day, ' || {clock} "
        f"ELSE {days} || ' days, ' || {clock} END"
    )


def _grouping(key: str) -> str:
    """A version that is a number and one that is a text are different groups."""
    return "version, kind" if key == "version" else key


def breakdown(source, key, measure, place, metric="Metric", count="Count", limit=9, shown="count") -> str:
    return f"""
SELECT key, {shown} AS count, total, CAST(round_even(m / greatest(total, 1)::DOUBLE * 100, 0) AS BIGINT) AS percent,
       '{metric}' AS metric_name, '{count}' AS metric_count
FROM (SELECT {key} AS key, CAST({measure} AS BIGINT) AS m, CAST({measure} AS BIGINT) AS count, min({place}) AS first,
             (SELECT CAST({measure} AS BIGINT) FROM {source}) AS total
      FROM {source} GROUP BY {_grouping(key)} ORDER BY m DESC, first LIMIT {limit})"""


STATS = (
    ("Instances By Version", "reg", "version", "count(*)", "Version", "Instances"),
    ("Servers By Game", "rsrv", "game", "count(*)", "Game", "Servers"),
    ("Players By Game", "rsrv", "game", "sum(clientnum)", "Game", "Players"),
    ("Servers By Game Type", "rsrv", "gametype", "count(*)", "Game Type", "Servers"),
    ("Players By Game Type", "rsrv", "gametype", "sum(clientnum)", "Game Type", "Players"),
    ("Servers By Map", "rsrv", "map", "count(*)", "Map", "Servers"),
    ("Players By Map", "rsrv", "map", "sum(clientnum)", "Map", "Players"),
    ("Uptime By Instance", "reg", "ip_address", "sum(uptime)", "IP Address", "Uptime"),
)


def stats_sql() -> str:
    parts = []
    for segment, source, key, measure, metric, count in STATS:
        place = "instance_seq" if source == "reg" else "place"
        shown = duration("m") if segment == "Uptime By Instance" else "CAST(m AS VARCHAR)"
        parts.append(f"""
SELECT '{segment}' AS segment, rank, key, {shown} AS count,
       CAST(round_even(m / greatest(total, 1)::DOUBLE * 100, 0) AS BIGINT) AS percent,
       '{metric}' AS metric_name, '{count}' AS metric_count
FROM (SELECT {key} AS key, CAST({measure} AS BIGINT) AS m,
             row_number() OVER (ORDER BY {measure} DESC, min({place})) AS rank,
             (SELECT CAST({measure} AS BIGINT) FROM {source}) AS total
      FROM {source} GROUP BY {_grouping(key)}) WHERE rank <= 9""")
    return WITH_RSRV + " UNION ALL ".join(parts)


# Expected validation result per fault of the generated bodies (fault = event_id % 23).
FAULTS = """
bodies AS (
  SELECT *, event_id % 23 AS fault,
         CASE WHEN event_id % 23 = 22 THEN 65 ELSE n_servers END AS sent,
         CASE WHEN n_servers > 0 OR event_id % 23 = 22 THEN true ELSE false END AS has_first
  FROM hb),
checked AS (
  SELECT *, CASE
    WHEN fault IN (1, 2) THEN 'uptime:invalid uptime'
    WHEN fault = 19 THEN 'servers:Missing data for required field.'
    WHEN fault = 20 THEN 'version:Missing data for required field.'
    WHEN fault = 21 THEN '_schema:Invalid input type.'
    WHEN fault = 22 THEN 'servers:invalid server count'
    WHEN NOT has_first THEN ''
    WHEN fault = 3 THEN 'servers.0.id:invalid id'
    WHEN fault = 4 THEN 'servers.0.port:invalid port'
    WHEN fault = 6 THEN 'servers.0.game:invalid game name'
    WHEN fault IN (7, 8) THEN 'servers.0.hostname:invalid hostname'
    WHEN fault IN (9, 10) THEN 'servers.0.clientnum:invalid clientnum'
    WHEN fault = 11 THEN 'servers.0.map:invalid map name'
    WHEN fault = 12 THEN 'servers.0.gametype:invalid gametype'
    WHEN fault = 14 THEN 'servers.0.version:invalid server version'
    WHEN fault = 15 THEN 'servers.0.clientnum:Not a valid integer.'
    WHEN fault = 17 THEN 'servers.0.extra:Unknown field.'
    ELSE '' END AS errors
  FROM bodies),
good AS (SELECT * FROM checked WHERE errors = ''),
gsrv AS (SELECT *, pos = 0 AS is_first FROM (SELECT *, unnest(range(sent)) AS pos FROM good))"""

WITH_FAULTS = f"WITH {HB},{FAULTS}"

URLS = """
WITH urls AS (
  SELECT page_id, CASE page_id % 7
    WHEN 0 THEN NULL
    WHEN 1 THEN 'https://10.0.0.4:' || page_id || '/a?b'
    WHEN 2 THEN 'ftp://host' || page_id || '.com'
    WHEN 3 THEN 'http://localhost:' || page_id
    WHEN 4 THEN url || ' x'
    ELSE url END AS url FROM pages)"""
URL_OK = f"regexp_matches(url, '{URL_PATTERN}')"
URL_SPLIT = r"""'(?i)^(https?://([a-z0-9.-]+))(.*)$'"""

SHEET = """
sheet AS (SELECT concat_ws(' ', p_name, CAST(p_size AS VARCHAR)) AS key, p_brand, p_type, p_name, p_partkey AS row FROM part),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row DESC) AS rn FROM sheet) WHERE rn = 1),
sets AS (SELECT 'en-US' AS language, key, p_brand AS text FROM kept
         UNION ALL SELECT 'de-DE', key, lower(p_type) FROM kept
         UNION ALL SELECT 'de-CH', key, p_type FROM kept
         UNION ALL SELECT 'fr-FR', key, reverse(p_name) FROM kept),
tags AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-CH' WHEN 2 THEN 'xx' END AS tag
         FROM documents),
resolved AS (SELECT doc_id, tag, CASE
    WHEN tag IS NULL THEN 'en-US'
    WHEN tag IN ('en-US', 'de-DE', 'de-CH', 'fr-FR') THEN tag
    WHEN tag[1:2] = 'en' THEN 'en-US' WHEN tag[1:2] = 'de' THEN 'de-DE' WHEN tag[1:2] = 'fr' THEN 'fr-FR'
    ELSE 'en-US' END AS language FROM tags)"""

VERSIONS = """
updates AS (SELECT event_id AS seq, user_id % 3 <> 0 AS authorised,
                   CASE WHEN event_type = 'signup' THEN 'v' || k END AS stable,
                   CASE WHEN event_type = 'purchase' THEN 'p' || k END AS prerelease FROM hb),
given AS (SELECT arg_max(stable, seq) FILTER (WHERE stable IS NOT NULL) AS stable,
                 arg_max(prerelease, seq) FILTER (WHERE prerelease IS NOT NULL) AS prerelease
          FROM updates WHERE authorised),
config AS (SELECT CAST(r_regionkey AS BIGINT) AS api_version,
                  CASE WHEN r_regionkey = 1 THEN coalesce(stable, '1.' || r_regionkey) ELSE '1.' || r_regionkey END
                    AS current_version_stable,
                  CASE WHEN r_regionkey = 1 THEN coalesce(prerelease, '1.' || r_regionkey) ELSE '1.' || r_regionkey END
                    AS current_version_prerelease
           FROM region, given)"""

STORE = """
plans AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey, s_name AS name, 'Plan of ' || s_name AS description,
                 CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE CAST(round(s_acctbal * 100) AS BIGINT) END AS price,
                 CASE WHEN s_suppkey % 2 = 0 THEN 'month' ELSE 'year' END AS period_unit,
                 CASE WHEN s_suppkey % 5 = 0 THEN 'archived' ELSE 'active' END AS status FROM supplier),
meta AS (SELECT CAST(p_partkey * 2 AS VARCHAR) AS plan_id, p_partkey * 2 AS plan_key,
                CAST(CASE WHEN p_size % 5 <> 0 THEN p_size % 5 END AS BIGINT) AS subscription_count,
                'author ' || p_brand AS author, 'https://help.example.com/' || (p_partkey * 2) AS help_url,
                'https://c.example.com/' || (p_partkey * 2) || CASE WHEN p_partkey * 2 % 7 = 0 THEN '.txt'
                  WHEN p_partkey * 2 % 3 = 1 THEN '.dll' ELSE '.JS' END AS content_url
         FROM part),
catalogue AS (SELECT id, name, description, printf('%.2f', price / 100.0) AS price, period_unit,
                     CASE WHEN price = 0 THEN 'Free' ELSE '$' || printf('%.2f', price / 100.0) || ' per ' || period_unit END
                       AS price_label,
                     author, help_url, subscription_count, coalesce(subscription_count, 0) AS subscribers, plan_id, status
              FROM plans LEFT JOIN meta ON id = plan_id),
cust AS (SELECT c_custkey AS id, 'u' || (c_custkey % 1200) || '@x' AS email,
                CASE WHEN c_custkey % 13 <> 0 THEN 'i' || (c_custkey % 50) END AS instance_id FROM customer),
subs AS (SELECT o_custkey AS customer_id, CAST(o_orderkey % 100 AS VARCHAR) AS plan_id,
                CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'cancelled' END AS status FROM orders),
first_customer AS (SELECT email, min(id) AS customer_id FROM cust GROUP BY email),
owned AS (SELECT DISTINCT customer_id, plan_id FROM subs WHERE status = 'active'),
entitled AS (SELECT email, customer_id, plan_id, content_url, author
             FROM first_customer JOIN owned USING (customer_id) JOIN meta USING (plan_id)),
contents AS (SELECT content_url, CASE WHEN plan_key % 10 <> 0 THEN 'content of ' || plan_id || ' ' || repeat(author, 5) END AS payload
             FROM meta)"""

COUNTS = """
subscription_events AS (
  SELECT event_id, ts, CAST(user_id % 120 AS VARCHAR) AS plan_id,
         CASE event_type WHEN 'signup' THEN 'subscription_created' WHEN 'error' THEN 'subscription_cancelled'
              ELSE event_type END AS event_type FROM events),
counting AS (
  SELECT e.*, CASE WHEN event_type = 'subscription_created' THEN 1 ELSE -1 END AS delta,
         coalesce(subscription_count, 0) AS start
  FROM subscription_events e JOIN meta USING (plan_id)
  WHERE subscription_count IS NOT NULL AND event_type IN ('subscription_created', 'subscription_cancelled')),
summed AS (SELECT *, sum(delta) OVER (PARTITION BY plan_id ORDER BY ts, event_id) AS s FROM counting),
lowest AS (SELECT *, min(s) OVER (PARTITION BY plan_id ORDER BY ts, event_id) AS low FROM summed),
folded AS (SELECT *, CAST(start + s - least(0, start + low) AS BIGINT) AS n FROM lowest),
stepped AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY plan_id ORDER BY ts, event_id), start) AS prior FROM folded),
clamped AS (SELECT plan_id, ts, event_id, CAST(delta AS BIGINT) AS delta, n AS subscription_count,
                   n = prior + delta AS applied FROM stepped),
final AS (SELECT meta.plan_id, CAST(coalesce(last_n, subscription_count, 0) AS BIGINT) AS subscription_count, author
          FROM meta LEFT JOIN (SELECT plan_id, arg_max(subscription_count, (ts, event_id)) AS last_n
                               FROM clamped GROUP BY plan_id) USING (plan_id)),
outcomes AS (SELECT e.event_id, e.plan_id, event_type,
                    CASE WHEN c.event_id IS NULL THEN 'error' WHEN applied THEN 'applied' ELSE 'acknowledged' END
                      AS outcome
             FROM subscription_events e LEFT JOIN clamped c ON e.event_id = c.event_id)"""

WITH_SHEET = f"WITH {SHEET}"
WITH_VERSIONS = f"WITH {HB},{VERSIONS}"
WITH_STORE = f"WITH {STORE}"
WITH_COUNTS = f"WITH {STORE},{COUNTS}"


def sessions(expiry: int, sweep: int) -> str:
    end = f"max(t) + {expiry}" if sweep == 0 else purge("max(t)", expiry, sweep)
    return f"""{WITH_HB},
gaps AS (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY t, ts, seq) AS prev FROM hb),
marked AS (SELECT *, sum(CASE WHEN prev IS NULL OR t >= {purge("prev", expiry, sweep)} THEN 1 ELSE 0 END)
             OVER (PARTITION BY id ORDER BY t, ts, seq) AS session FROM gaps)
SELECT id, min(t) AS start, max(t) AS last, {end} AS "end", count(*) AS heartbeats
FROM marked GROUP BY id, session"""


def _stat(index: int) -> str:
    segment, source, key, measure, metric, count = STATS[index]
    place = "instance_seq" if source == "reg" else "place"
    shown = duration("m") if segment == "Uptime By Instance" else "count"
    return WITH_RSRV + breakdown(source, key, measure, place, metric, count, shown=shown)


PLOT = f"SELECT metric, idx, time, count AS value, {label(f'({NOW} - time)')} AS label FROM sliced WHERE metric <> 'server'"
GAPPY = f"""WITH {HB},{census(600)},{HISTORY},
gappy AS (SELECT * FROM history
          UNION ALL SELECT event_type AS metric, t // 600 * 600 AS time, count(*) AS count FROM hb GROUP BY ALL)"""
LAST = """
last AS (SELECT coalesce(arg_max(count, idx) FILTER (WHERE metric = 'client'), 0) AS client_count,
                coalesce(arg_max(count, idx) FILTER (WHERE metric = 'instance'), 0) AS instance_count,
                coalesce(arg_max(count, idx) FILTER (WHERE metric = 'server'), 0) AS server_count FROM sliced)"""


def zoom(start: int) -> str:
    return f"""
zoom AS (SELECT n AS total, step AS stride, {start} + CAST(ceil((n - {start}) / 2.0) AS BIGINT) AS next_zoom_point,
                CASE WHEN n = {start} THEN 0 ELSE greatest(0, {start} - (n - {start})) END AS previous_zoom_point
         FROM stride)"""


ORACLE: dict[str, str] = {
    "src_heartbeat_json": f"""{WITH_FAULTS}
        SELECT seq, '203.0.113.9' AS remote_ip, t AS received_at, fault <> 21 AS is_object,
               CASE WHEN fault NOT IN (19, 21) THEN sent END AS n_servers FROM checked""",
    "src_plans": f"""{WITH_STORE}
        SELECT id, name, price, status FROM plans WHERE status = 'active'""",
    "limit_n": f"{WITH_STORE} SELECT id, name FROM plans WHERE status = 'active' ORDER BY id LIMIT 100",
    "first_match": f"{WITH_STORE} SELECT email, customer_id FROM first_customer",
    "filter_webfront_present": f"{WITH_HB} SELECT seq, CASE WHEN seq % 3 = 1 THEN webfront_url END AS webfront FROM hb",
    "src_customer_by_email": f"""{WITH_STORE}
        SELECT email, id, row_number() OVER (PARTITION BY email ORDER BY id) AS position FROM cust""",
    "src_subscriptions_active": f"{WITH_STORE} SELECT customer_id, plan_id FROM subs WHERE status = 'active'",
    "src_plans_by_ids": f"""{WITH_STORE}
        SELECT id, name, status FROM plans WHERE id IN (SELECT plan_id FROM subs WHERE status = 'active')""",
    "src_meta_get": f"{WITH_STORE} SELECT plan_id, subscription_count, author, content_url FROM meta",
    "src_subscription_events": f"""{WITH_COUNTS}
        SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS event_type,
               CASE WHEN event_id % 17 <> 0 THEN plan_id END AS plan_id,
               CASE WHEN event_id % 17 = 0 THEN 'request body must be json' END AS error FROM subscription_events""",
    "sink_version_update": f"{WITH_VERSIONS} SELECT * FROM config",
    "sink_meta_set": f"""{WITH_COUNTS}
        SELECT plan_id, subscription_count, author FROM final""",
    "export_instances": f"""{WITH_REG}
        SELECT id, version, uptime, last_heartbeat, ip_address, webfront_url,
               array_to_string(['^' || (k % 10) || 'host ' || event_id || '^:' FOR j IN range(n_servers)], ',') AS hostnames
        FROM reg""",
    "export_instance_by_id": f"""{WITH_REG}
        SELECT o_orderkey, 'i' || (o_custkey % 400) AS id, reg.id IS NOT NULL AS found, last_heartbeat
        FROM orders LEFT JOIN reg ON reg.id = 'i' || (o_custkey % 400)""",
    "reject_quarantine": f"""{WITH_FAULTS}
        SELECT seq, '203.0.113.9' AS remote_ip, errors FROM checked WHERE errors <> ''""",
    "validate_heartbeat": f"{WITH_FAULTS} SELECT seq, errors = '' AS accepted, errors FROM checked",
    "coerce_types": f"""{WITH_FAULTS}
        SELECT seq, pos, event_id * 4 + pos AS id,
               CASE WHEN fault = 16 AND is_first THEN 12 ELSE (whole + pos) % 129 END AS clientnum,
               CAST(128 AS BIGINT) AS maxclientnum FROM gsrv""",
    "fix_server_ip": f"""{WITH_FAULTS}
        SELECT seq, pos, CASE WHEN (event_id + pos) % 6 = 4 THEN '8.8.8.8' ELSE '203.0.113.9' END AS ip FROM gsrv""",
    "fix_server_version": f"{WITH_FAULTS} SELECT seq, pos, 'Unknown' AS version FROM gsrv",
    "fix_port": f"""{WITH_FAULTS}
        SELECT seq, pos, CAST(CASE WHEN fault = 5 AND is_first THEN 4464 ELSE 28960 + pos END AS BIGINT) AS port
        FROM gsrv""",
    "apply_defaults": f"""{WITH_FAULTS}
        SELECT seq, pos, CASE WHEN fault = 13 AND is_first THEN 'Unknown' ELSE 'dm' END AS gametype FROM gsrv""",
    "stamp_sender": f"""{WITH_FAULTS}
        SELECT seq, id, '203.0.113.9' AS ip_address, 'http://203.0.113.9:1624' AS webfront_url FROM good""",
    "stamp_received": f"{WITH_FAULTS} SELECT seq, id, t AS last_heartbeat FROM good",
    "array_length_check": f"{WITH_FAULTS} SELECT seq, sent AS n_servers FROM good",
    "normalize_webfront": f"""{URLS}
        SELECT page_id, CASE WHEN url IS NULL THEN 'http://203.0.113.9:1624'
                             WHEN NOT {URL_OK} THEN NULL
                             WHEN starts_with(url, 'https://10.0.0.4:') THEN 'http://203.0.113.9:' || page_id || '/a?b'
                             ELSE url END AS webfront_url FROM urls""",
    "url_parts": f"""{URLS}
        SELECT page_id,
               CASE WHEN {URL_OK} THEN regexp_extract(url, {URL_SPLIT}, 1) END AS origin,
               CASE WHEN {URL_OK} THEN regexp_extract(url, {URL_SPLIT}, 2) END AS host,
               CASE WHEN {URL_OK} THEN regexp_extract(url, {URL_SPLIT}, 3) END AS rest FROM urls""",
    "is_non_public": f"""{WITH_HB},
        parts AS (SELECT event_id, event_id % 260 AS a, k % 256 AS b, user_id % 256 AS c FROM hb)
        SELECT event_id, concat_ws('.', a, b, c, 9) AS ip,
               CASE WHEN a > 255 THEN NULL ELSE
                 a IN (10, 127, 239) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
                 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c = 0) OR (a = 192 AND b = 168)
                 OR (a = 198 AND b BETWEEN 18 AND 19) END AS non_public FROM parts""",
    "require_params": f"""{WITH_STORE}
        SELECT email, instance_id,
               CASE WHEN instance_id IS NULL THEN 'subscription_id and instance_id are required' END AS error,
               count(*) AS requests FROM cust GROUP BY ALL""",
    "filter_has_attr": f"""{WITH_STORE}
        SELECT id, content_url FROM plans JOIN meta ON id = plan_id""",
    "nested_attr_or_null": """
        SELECT event_id, CASE event_type WHEN 'signup' THEN user_id WHEN 'view' THEN event_id END AS n FROM events""",
    "flatten_nested": f"""{WITH_RSRV}
        SELECT instance_seq, pos, server_id AS id, game, map, clientnum FROM rsrv""",
    "attach_parent": f"""{WITH_RSRV}
        SELECT server_id AS id, game, id AS instance_id, ip_address AS instance_ip_address,
               version AS instance_version, last_heartbeat AS instance_last_heartbeat FROM rsrv""",
    "plan_catalogue": f"""{WITH_STORE}
        SELECT id, name, description, price, period_unit, price_label, author, help_url, subscription_count, subscribers
        FROM catalogue""",
    "plan_catalogue_strict": f"""{WITH_STORE}
        SELECT id, name, author, subscribers FROM catalogue WHERE plan_id IS NOT NULL""",
    "entitlements": f"{WITH_STORE} SELECT email, customer_id, plan_id, content_url FROM entitled",
    "in_list": f"""{WITH_STORE}
        SELECT id FROM plans WHERE id IN (SELECT plan_id FROM subs WHERE status = 'active')""",
    "exists_by_key": f"""{WITH_REG}
        SELECT o_orderkey, 'i' || (o_custkey % 400) AS id, ('i' || (o_custkey % 400)) IN (SELECT id FROM reg) AS found
        FROM orders""",
    "registry_as_of": f"""{WITH_HB},
        beats AS (SELECT id, t, max(seq) AS seq FROM hb GROUP BY id, t),
        asked AS (SELECT o_orderkey, 'i' || (o_custkey % 400) AS id, 1704067200 + (o_orderkey * 7919) % 2592000 AS "at" FROM orders),
        met AS (SELECT asked.o_orderkey, asked.id, asked."at", t, seq, coalesce({purge("t", 86400, 7200)} > "at", false) AS found
                FROM asked ASOF LEFT JOIN beats ON asked.id = beats.id AND asked."at" >= beats.t)
        SELECT o_orderkey, id, "at", found, CASE WHEN found THEN t END AS last_heartbeat, CASE WHEN found THEN seq END AS heartbeat_seq FROM met""",
    "not_found_by_key": f"""{WITH_REG}
        SELECT o_orderkey, 'i' || (o_custkey % 400) AS id FROM orders
        WHERE ('i' || (o_custkey % 400)) NOT IN (SELECT id FROM reg)""",
    "translation_lookup": f"""{WITH_SHEET},
        asked AS (SELECT row, key, CASE WHEN row % 2 = 0 THEN 'fr-FR' ELSE 'de-CH' END AS language FROM sheet)
        SELECT row, key, language, text FROM asked LEFT JOIN sets USING (language, key)""",
    "count_by_key": WITH_SRV + breakdown("srv", "map", "sum(clientnum)", "seq * 64 + pos", "Map", "Players"),
    "stat_instances_by_version": _stat(0),
    "stat_servers_by_game": _stat(1),
    "stat_players_by_game": _stat(2),
    "stat_servers_by_gametype": _stat(3),
    "stat_players_by_gametype": _stat(4),
    "stat_servers_by_map": _stat(5),
    "stat_players_by_map": _stat(6),
    "stat_uptime_by_ip": _stat(7),
    "formatter_callback": WITH_HB + breakdown("hb", "id", "sum(uptime)", "seq", shown=duration("m")),
    "top_k_stable": WITH_SRV + breakdown("srv", "gametype", "count(*)", "seq * 64 + pos", limit=3),
    "stats_all": stats_sql(),
    "fleet_totals": f"""{WITH_RSRV}
        SELECT (SELECT CAST(coalesce(sum(clientnum), 0) AS BIGINT) FROM rsrv) AS clients,
               (SELECT count(*) FROM reg) AS instances, (SELECT count(*) FROM rsrv) AS servers""",
    "instance_count": f"{WITH_REG} SELECT count(*) AS instances FROM reg",
    "game_summary": f"""{WITH_RSRV}
        SELECT game, CAST(sum(clientnum) AS BIGINT) AS players, count(*) AS servers FROM rsrv GROUP BY game""",
    "group_servers": f"{WITH_RSRV} SELECT game, instance_seq, pos, server_id AS id FROM rsrv",
    "sort_by_game": f"""{WITH_SRV}
        SELECT game, seq AS instance_seq, server_id AS id, lag(server_id) OVER (PARTITION BY game ORDER BY seq, pos) AS follows FROM srv""",
    "sort_by_players": f"""{WITH_SRV}
        SELECT game, seq AS instance_seq, clientnum, server_id AS id,
               lag(server_id) OVER (PARTITION BY game ORDER BY clientnum DESC, seq, pos) AS follows FROM srv""",
    "translation_sets": f"{WITH_SHEET} SELECT language, key, text FROM sets",
    "upsert_latest": f"""{WITH_REG}
        SELECT id, t AS received_at, seq, version, n_servers FROM latest""",
    "expire_stale": f"{WITH_REG} SELECT id, t AS last_heartbeat, seq FROM latest WHERE {NOW} - t <= 21600",
    "online_sessions": sessions(21600, 0),
    "registry_lifetimes": sessions(21600, 7200),
    "census_at_ticks": f"""WITH {HB},{CENSUS},
        spine AS (SELECT unnest(range(lo, hi + 1, 3600)) AS tick FROM (SELECT min(tick) AS lo, max(tick) AS hi FROM counted))
        SELECT tick, coalesce(clients, 0) AS clients, coalesce(instances, 0) AS instances, coalesce(servers, 0) AS servers
        FROM spine LEFT JOIN counted USING (tick)""",
    "append_sample": f"""{WITH_HISTORY},
        grown AS (SELECT * FROM history UNION ALL SELECT 'client', t, whole FROM hb)
        SELECT metric, time, CAST(sum(count) AS BIGINT) AS count, count(*) AS samples FROM grown GROUP BY metric, time""",
    "retain_last_n": f"""{WITH_HISTORY}
        SELECT metric, time, count FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY time DESC) AS rn FROM history)
        WHERE rn <= 300""",
    "fill_gaps": f"""{GAPPY},
        spine AS (SELECT metric, unnest(range(lo, hi + 1, 600)) AS time
                  FROM (SELECT metric, min(time) AS lo, max(time) AS hi FROM gappy GROUP BY metric))
        SELECT metric, time, coalesce(count, 0) AS count FROM spine LEFT JOIN gappy USING (metric, time)""",
    "fill_after_stop": f"""{WITH_HISTORY},
        slots AS (SELECT unnest(range(hi + 3600, {NOW} + 100000 + 3600, 3600)) AS time
                  FROM (SELECT max(time) AS hi FROM history WHERE metric = 'instance'))
        SELECT metric, time, count FROM history
        UNION ALL SELECT unnest(['client', 'instance', 'server']), time, 0 FROM slots""",
    "slice_stride": f"{WITH_HISTORY},{sliced('history', 37, 50)} SELECT * FROM sliced",
    "zoom_points": f"{WITH_HISTORY},{sliced('history', 37, 50)},{zoom(37)} SELECT * FROM zoom",
    "last_value": f"{WITH_HISTORY},{sliced('history', 37, 50)},{LAST} SELECT * FROM last",
    "history_series": f"{WITH_HISTORY},{sliced('history', 37, 50)} {PLOT}",
    "first_label": f"""{WITH_HISTORY},{sliced('history', 37, 50)}
        SELECT label FROM ({PLOT}) WHERE metric = 'instance' ORDER BY idx LIMIT 1""",
    "clamped_counter": f"{WITH_COUNTS} SELECT plan_id, event_id, delta, subscription_count, applied FROM clamped",
    "event_outcome": f"{WITH_COUNTS} SELECT event_id, plan_id, event_type, outcome FROM outcomes",
    "plan_subscription_count": f"{WITH_COUNTS} SELECT plan_id, subscription_count FROM final",
    "token_registry": f"""{WITH_HB},
        issued AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn FROM hb)
        SELECT id, seq AS token, t AS issued_at, t + 30 * 86400 AS expires_at FROM issued WHERE rn = 1""",
    "resolve_language": f"{WITH_SHEET} SELECT doc_id, tag, language FROM resolved",
    "translation_for_tag": f"""{WITH_SHEET}
        SELECT tag, language, key, text FROM (SELECT DISTINCT tag, language FROM resolved) JOIN sets USING (language)""",
    "translation_default": f"{WITH_SHEET} SELECT language, key, text FROM sets WHERE language = 'en-US'",
    "strip_color_codes": "SELECT p_partkey, p_name AS hostname FROM part",
    "regex_replace": r"""
        SELECT c_custkey, regexp_replace(c_name, '(\w+)#0*(\d*)', '\2 \1', 'g') AS name FROM customer""",
    "format_duration": f"{WITH_HB} SELECT event_id, {duration('uptime')} AS duration FROM hb",
    "uptime_clock": f"""{WITH_HB}
        SELECT event_id, printf('%02d:%02d:%02d', uptime % 86400 // 3600, uptime % 3600 // 60, uptime % 60) AS clock
        FROM hb""",
    "time_ago": f"{WITH_HB} SELECT event_id, {label(f'({NOW} - t)')} AS label FROM hb",
    "epoch_truncate": f"{WITH_HB} SELECT event_id, t FROM hb",
    "percent_half_even": f"""{WITH_HB}
        SELECT event_id, CAST(round_even(k / greatest(user_id % 9, 1)::DOUBLE * 100, 0) AS BIGINT) AS percent FROM hb""",
    "ceil_div": "SELECT event_id, CAST(ceil((event_id - 500) / 30.0) AS BIGINT) AS n FROM events",
    "mask16": "SELECT event_id, ((event_id - 9) * 997) & 65535 AS n FROM events",
    "occupancy_label": f"{WITH_SRV} SELECT server_id AS id, clientnum || '/' || maxclientnum AS occupancy FROM srv",
    "connect_string": f"{WITH_SRV} SELECT server_id AS id, 'connect ' || ip || ':' || port AS connect FROM srv",
    "cents_to_text": """
        SELECT o_orderkey, printf('%.2f', CAST(round(o_totalprice * 100) AS BIGINT) / 100.0) AS price FROM orders""",
    "price_label": f"{WITH_STORE} SELECT id, price_label AS label FROM catalogue",
    "count_or_zero": f"{WITH_STORE} SELECT plan_id, coalesce(subscription_count, 0) AS subscribers FROM meta",
    "content_type": f"""{WITH_STORE}
        SELECT plan_id, CAST(CASE WHEN lower(content_url) LIKE '%.dll' THEN 0 WHEN lower(content_url) LIKE '%.js' THEN 1 END
                             AS BIGINT) AS type FROM meta""",
    "base64_encode": "SELECT doc_id, md5(to_base64(encode(text))) AS digest FROM documents",
    "json_nested_field": f"{WITH_COUNTS} SELECT event_id, plan_id FROM subscription_events WHERE event_id % 17 <> 0",
    "register_sql_functions": f"""{WITH_HB}
        SELECT seq, {duration('uptime')} AS duration,
               printf('%02d:%02d:%02d', uptime % 86400 // 3600, uptime % 3600 // 60, uptime % 60) AS clock,
               uptime & 65535 AS masked, CAST(ceil(uptime / 30.0) AS BIGINT) AS slots, 9007199254740993 + seq AS large,
               regexp_replace(id, '(i)([0-9]+)', '\\2-\\1') AS swapped, id AS plain, (seq % 9) || '/9' AS occupancy,
               'connect ' || ip_address || ':7' AS connect, printf('%.2f', seq / 100.0) AS price, 'Free' AS free, seq % 3 AS counted,
               0 AS kind, CAST(round_even((seq % 7) / 8.0::DOUBLE * 100, 0) AS BIGINT) AS percent,
               CASE WHEN seq % 260 < 256 THEN
                 seq % 260 IN (10, 127, 239) OR (seq % 260 = 100 AND 64 + seq % 70 <= 127) OR (seq % 260 = 198 AND 64 + seq % 70 BETWEEN 18 AND 19)
                 OR (seq % 260 = 172 AND 64 + seq % 70 BETWEEN 16 AND 31) OR (seq % 260 IN (169, 192) AND 64 + seq % 70 IN (254, 168)) END AS non_public,
               CASE WHEN seq % 90 >= 10 THEN seq % 90 BETWEEN 80 AND 89 ELSE false END AS non_public_6,
               'h' || (user_id % 9) || '.example.com' AS host, {label(f'({NOW} - t)')} AS age, t, to_base64(encode(id)) AS coded,
               strlen(id) + 28 AS sealed_bytes, id AS inner_field, true AS fits FROM hb""",
    "seal_content": f"""{WITH_STORE}
        SELECT content_url, payload AS opened, strlen(payload) + 28 AS sealed_bytes FROM contents""",
    "q_server_list": f"""{WITH_RSRV}
        SELECT game, 'host ' || event_id AS hostname, map, gametype, clientnum || '/128' AS occupancy,
               'connect ' || ip || ':' || port AS connect, webfront_url AS webfront, clientnum FROM rsrv""",
    "q_stats": stats_sql(),
    "q_history": f"""{WITH_HISTORY},
        recent AS (SELECT metric, time, count FROM
                     (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY time DESC) AS rn FROM history) WHERE rn <= 600),
        {sliced('recent', 11, 50)},{zoom(11)},{LAST}
        SELECT metric, idx, time AS t, value, label, next_zoom_point, previous_zoom_point,
               client_count, instance_count, server_count FROM ({PLOT}), zoom, last""",
    "q_instances": f"""{WITH_REG}
        SELECT id, version, uptime, last_heartbeat, ip_address, webfront_url, n_servers FROM reg""",
    "q_versions": f"""{WITH_VERSIONS}
        SELECT current_version_stable, current_version_prerelease FROM config WHERE api_version = 1""",
    "q_translations": f"""{WITH_SHEET}
        SELECT tag, language, key, text FROM (SELECT DISTINCT tag, language FROM resolved) JOIN sets USING (language)""",
    "q_plans": f"""{WITH_STORE}
        SELECT id, name, description, price, period_unit, price_label, author, help_url, subscription_count, subscribers
        FROM catalogue WHERE status = 'active'""",
    "q_entitlements": f"""{WITH_STORE}
        SELECT email, instance_id, plan_id,
               CAST(CASE WHEN lower(content_url) LIKE '%.dll' THEN 0 WHEN lower(content_url) LIKE '%.js' THEN 1 END AS BIGINT)
                 AS type,
               strlen(payload) + 28 AS sealed_bytes
        FROM (SELECT DISTINCT email, instance_id FROM cust WHERE instance_id IS NOT NULL)
        JOIN entitled USING (email) JOIN contents USING (content_url) WHERE payload IS NOT NULL""",
    "q_plan_counts": f"""{WITH_COUNTS},
        tallies AS (SELECT plan_id, count(*) FILTER (WHERE outcome = 'applied') AS applied,
                           count(*) FILTER (WHERE outcome = 'acknowledged') AS acknowledged,
                           count(*) FILTER (WHERE outcome = 'error') AS error FROM outcomes GROUP BY plan_id)
        SELECT plan_id, subscription_count, coalesce(applied, 0) AS applied, coalesce(acknowledged, 0) AS acknowledged,
               coalesce(error, 0) AS error FROM final LEFT JOIN tallies USING (plan_id)""",
}
