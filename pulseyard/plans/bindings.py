"""The given tables in the shape the operators read.

Every function takes the session and the folder of the tables, and stays a plain projection, so the
work of a query grows with its table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_706_659_200  # 2024-01-31 00:00:00 UTC
# The users of `events` report about twice a day, so periods are hours instead of seconds.
STATS_EXPIRY, STATS_SWEEP = 86_400, 7_200
CENSUS_EXPIRY, CENSUS_SWEEP, CENSUS_TICK = 21_600, 7_200, 3_600
ACTIVITY_STEP = 600
REMOTE_IP = "203.0.113.9"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    )


def _positions() -> Column:
    """0 .. event_id % 4 - 1, empty when event_id % 4 is 0."""
    n = F.pmod(F.col("event_id"), F.lit(4)).cast("int")
    return F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), n)


def _server(j: Column) -> Column:
    whole = F.floor("value").cast("bigint")
    mode = F.pmod(F.col("event_id") + j, F.lit(5)).cast("string")
    return F.struct(
        (F.col("event_id") * 4 + j).alias("id"),
        F.concat(F.lit("198.51.100."), F.pmod(F.col("user_id"), F.lit(250)).cast("string")).alias("ip"),
        (F.lit(28960) + j).alias("port"),
        F.lit("1.0").alias("version"),
        F.col("event_type").alias("game"),
        F.concat(
            F.lit("^"), F.pmod("k", F.lit(10)).cast("string"), F.lit("host "), F.col("event_id").cast("string"), F.lit("^:")
        ).alias("hostname"),
        F.pmod(whole + j, F.lit(129)).cast("int").alias("clientnum"),
        F.lit(128).alias("maxclientnum"),
        F.concat(F.lit("map"), F.pmod(F.col("k") + j, F.lit(12)).cast("string")).alias("map"),
        F.when(F.pmod(F.col("event_id") + j, F.lit(7)) != 0, F.concat(F.lit("mode"), mode)).alias("gametype"),
    )


def raw_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Web addresses of pages, some of them missing, private, local or malformed."""
    pages = table(spark, folder, "pages")
    case = F.pmod("page_id", F.lit(7))
    number = F.col("page_id").cast("string")
    url = (
        F.when(case == 0, F.lit(None).cast("string"))
        .when(case == 1, F.concat(F.lit("https://10.0.0.4:"), number, F.lit("/a?b")))
        .when(case == 2, F.concat(F.lit("ftp://host"), number, F.lit(".com")))
        .when(case == 3, F.concat(F.lit("http://localhost:"), number))
        .when(case == 4, F.concat(F.col("url"), F.lit(" x")))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", url.alias("url"))


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Typed heartbeats: one per event, with up to three servers."""
    return _events(spark, folder).select(
        F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("seq"),
        F.pmod("k", F.lit(5)).cast("string").alias("version"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "number").otherwise("string").alias("version_kind"),
        F.floor(F.col("value") * 1000).cast("int").alias("uptime"),
        F.concat(F.lit("203.0.113."), F.pmod("user_id", F.lit(20)).cast("string")).alias("ip_address"),
        F.concat(F.lit("http://h"), F.pmod("user_id", F.lit(9)).cast("string"), F.lit(".example.com")).alias(
            "webfront_url"
        ),
        F.transform(_positions(), _server).alias("servers"),
    )


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


ADDRESSES = ("", "x", "10.0.0.4", "127.0.0.1", "8.8.8.8", "fd00::1")


def _server_address(j: Column) -> Column:
    texts = [f',"ip":"{address}"' if address else "" for address in ADDRESSES]
    return F.coalesce(F.get(F.array(*map(F.lit, texts)), F.pmod(F.col("event_id") + j, F.lit(len(texts))).cast("int")), F.lit(""))


def _next_server_json(j: Column) -> Column:
    """JSON text of a server without faults. What all servers of a heartbeat share is in the columns ``game``, ``whole`` and ``first_id``."""
    return F.concat(
        F.lit('{"id":'),
        (F.col("first_id") + j).cast("string"),
        _server_address(j),
        F.lit(',"port":'),
        (F.lit(28960) + j).cast("string"),
        F.col("game"),
        F.lit(',"clientnum":'),
        F.pmod(F.col("whole") + j, F.lit(129)).cast("int").cast("string"),
        F.lit(',"maxclientnum":128,"map":"map'),
        F.pmod(F.col("k") + j, F.lit(12)).cast("string"),
        F.lit('","gametype":"dm"}'),
    )


def _first_server_json() -> Column:
    """JSON text of the first server, which carries the fault of its heartbeat."""
    j, fault = F.lit(0), F.pmod("event_id", F.lit(23))

    def field(name: str, value: Column, **faults: str | None) -> Column:
        text = F.concat(F.lit(f',"{name}":'), value)
        for code, replacement in faults.items():
            shown = "" if replacement is None else f',"{name}":{replacement}'
            text = F.when(fault == int(code[1:]), F.lit(shown)).otherwise(text)
        return text

    server = _server(j)
    return F.concat(
        F.lit("{"),
        F.substring(field("id", server["id"].cast("string"), _3="25525525525565536"), F.lit(2), F.lit(99)),
        _server_address(j),
        field("port", server["port"].cast("string"), _4="65536", _5="70000"),
        F.when(fault == 14, F.lit(',"version":"' + "v" * 129 + '"')).otherwise(F.lit("")),
        field("game", _quoted(server["game"]), _6='"ninechars"'),
        field("hostname", _quoted(server["hostname"]), _7='""', _8='"' + "h" * 257 + '"'),
        field("clientnum", server["clientnum"].cast("string"), _9="129", _10="-1", _15="true", _16='"12"'),
        field("maxclientnum", server["maxclientnum"].cast("string")),
        field("map", _quoted(server["map"]), _11='"' + "m" * 129 + '"'),
        field("gametype", F.lit('"dm"'), _12='""', _13=None),
        F.when(fault == 17, F.lit(',"extra":1')).otherwise(F.lit("")),
        F.lit("}"),
    )


def heartbeat_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Raw JSON heartbeats, one per event, with a fault chosen by ``event_id % 23``."""
    fault = F.pmod("event_id", F.lit(23))
    positions = F.when(fault == 22, F.sequence(F.lit(0), F.lit(64))).otherwise(_positions())
    first = F.when(F.size(positions) > 0, F.array(_first_server_json())).otherwise(F.array().cast("array<string>"))
    texts = F.concat(first, F.transform(F.slice(positions, 2, 64), _next_server_json))
    servers = F.concat(F.lit(',"servers":['), F.array_join(texts, ","), F.lit("]"))
    uptime = F.floor(F.col("value") * 1000).cast("string")
    uptime = F.when(fault == 1, "-1").when(fault == 2, "2147483648").otherwise(uptime)
    version = F.when(F.pmod("k", F.lit(2)) == 0, F.lit(',"version":1.0')).otherwise(F.lit(',"version":"1.0.0.0"'))
    body = F.concat(
        F.lit('{"id":"i'),
        F.col("user_id").cast("string"),
        F.lit('"'),
        F.when(fault == 20, "").otherwise(version),
        F.lit(',"last_heartbeat":5,"uptime":'),
        uptime,
        F.when(fault == 19, "").otherwise(servers),
        F.lit("}"),
    )
    shared = _server(F.lit(0))
    events = _events(spark, folder).withColumns(
        {
            "first_id": F.col("event_id") * 4,
            "whole": F.floor("value").cast("bigint"),
            "game": F.concat(F.lit(',"game":'), _quoted(shared["game"]), F.lit(',"hostname":'), _quoted(shared["hostname"])),
        }
    )
    return events.select(
        F.when(fault == 21, "not json").otherwise(body).alias("body"),
        F.lit(REMOTE_IP).alias("remote_ip"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("seq"),
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").alias("issued_at"),
        F.col("event_id").alias("token"),
    )


def instance_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One requested instance id per order; some ids are unknown."""
    orders = table(spark, folder, "orders")
    asked = F.pmod("o_custkey", F.lit(400)).cast("string")
    return orders.select("o_orderkey", F.concat(F.lit("i"), asked).alias("id"))


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Translation sheet from parts; text keys repeat."""
    return table(spark, folder, "part").select(
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("STRING"),
        F.col("p_brand").alias("en-US"),
        F.lower("p_type").alias("de-DE"),
        F.col("p_type").alias("de-CH"),
        F.reverse("p_name").alias("fr-FR"),
        F.col("p_partkey").alias("row"),
    )


def tag_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A requested language tag per document."""
    case = F.pmod("doc_id", F.lit(4))
    tag = (
        F.when(case == 0, F.col("lang"))
        .when(case == 1, F.concat("lang", F.lit("-CH")))
        .when(case == 2, F.lit("xx"))
    )
    return table(spark, folder, "documents").select("doc_id", tag.alias("tag"))


def version_config(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("1."), F.col("r_regionkey").cast("string"))
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("int").alias("api_version"),
        text.alias("current_version_stable"),
        text.alias("current_version_prerelease"),
    )


def version_updates(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k").cast("string")
    return _events(spark, folder).select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("v"), k)).alias("current_version_stable"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), k)).alias("current_version_prerelease"),
        (F.pmod("user_id", F.lit(3)) != 0).alias("authorised"),
    )


def plans(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Plan of "), F.col("s_name")).alias("description"),
        F.when(key % 11 == 0, 0).otherwise(F.round(F.col("s_acctbal") * 100)).cast("bigint").alias("price"),
        F.when(key % 2 == 0, "month").otherwise("year").alias("period_unit"),
        F.when(key % 5 == 0, "archived").otherwise("active").alias("status"),
    )


def plan_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata from parts. Their keys are the even numbers, so every other plan has none, and many of them have no plan."""
    key = F.col("p_partkey") * 2
    suffix = F.when(key % 7 == 0, ".txt").when(key % 3 == 1, ".dll").otherwise(".JS")
    return table(spark, folder, "part").select(
        key.cast("string").alias("plan_id"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 5).cast("bigint").alias("subscription_count"),
        F.concat(F.lit("author "), F.col("p_brand")).alias("author"),
        F.concat(F.lit("https://help.example.com/"), key.cast("string")).alias("help_url"),
        F.concat(F.lit("https://c.example.com/"), key.cast("string"), suffix).alias("content_url"),
    )


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Content of every plan with metadata; one in five could not be fetched and is null."""
    text = F.concat(F.lit("content of "), F.col("plan_id"), F.lit(" "), F.repeat("author", F.lit(5)))
    payload = F.when(F.col("plan_id").cast("bigint") % 10 != 0, F.encode(text, "UTF-8"))
    return plan_meta(spark, folder).select("content_url", payload.alias("payload"))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """A history of events per type and ten minutes; slots without events are missing."""
    slot = F.unix_seconds("ts") - F.pmod(F.unix_seconds("ts"), F.lit(ACTIVITY_STEP))
    counted = _events(spark, folder).groupBy(F.col("event_type").alias("metric"), F.timestamp_seconds(slot).alias("time"))
    return counted.agg(F.count(F.lit(1)).alias("count"))


def timed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The instance requests, each at a second of its own within the month of the events."""
    at = F.lit(1_704_067_200) + F.pmod(F.col("o_orderkey") * 7919, F.lit(2_592_000))
    return instance_requests(spark, folder).withColumn("at", at)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers; some share an email."""
    number = F.pmod("c_custkey", F.lit(1200)).cast("string")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("u"), number, F.lit("@x")).alias("email")
    )


def content_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per customer; one in thirteen lacks its instance."""
    instance = F.concat(F.lit("i"), F.pmod("id", F.lit(50)).cast("string"))
    return customers(spark, folder).select(
        "email", F.when(F.pmod("id", F.lit(13)) != 0, instance).alias("instance_id")
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.pmod("o_orderkey", F.lit(100)).cast("string").alias("plan_id"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("cancelled").alias("status"),
    )


def subscription_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "subscription_created")
        .when(F.col("event_type") == "error", "subscription_cancelled")
        .otherwise(F.col("event_type"))
    )
    return _events(spark, folder).select(
        "event_id", "ts", kind.alias("event_type"), F.pmod("user_id", F.lit(120)).cast("string").alias("plan_id")
    )


def subscription_event_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The subscription events as JSON; one in seventeen is not JSON."""
    nested = F.struct(
        "event_type",
        F.struct(F.struct("plan_id").alias("subscription")).alias("content"),
    )
    body = F.when(F.pmod("event_id", F.lit(17)) == 0, "plan=1").otherwise(F.to_json(nested))
    return subscription_events(spark, folder).select("event_id", body.alias("body"))
