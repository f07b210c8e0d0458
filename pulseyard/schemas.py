"""Record types and the field rules of a heartbeat."""

from dataclasses import dataclass

# Limits of the instance and server records.
MAX_SERVERS = 64
DEFAULT_GAMETYPE = "Unknown"
DEFAULT_SERVER_VERSION = "Unknown"

MISSING = "Missing data for required field."
NULL = "Field may not be null."
NOT_INTEGER = "Not a valid integer."
NOT_STRING = "Not a valid string."
NOT_OBJECT = "Invalid input type."
UNKNOWN_FIELD = "Unknown field."
BAD_SERVER_COUNT = "invalid server count"


@dataclass(frozen=True)
class Rule:
    """Type and limits of one field; ``low`` and ``high`` bound the number or the text length."""

    name: str
    kind: str
    low: int | None = None
    high: int | None = None
    message: str | None = None
    required: bool = True
    nullable: bool = False
    spark_type: str = "string"


# Field rules.
INSTANCE_RULES = (
    Rule("id", "text"),
    Rule("version", "any"),
    Rule("uptime", "integer", 0, 2147483647, "invalid uptime", spark_type="int"),
    Rule("last_heartbeat", "integer", required=False, spark_type="bigint"),
    Rule("webfront_url", "text", required=False, nullable=True),
)
# Accepted as keys but not read: the sender address always replaces ip_address.
INSTANCE_KEYS = tuple(rule.name for rule in INSTANCE_RULES) + ("servers", "ip_address")

SERVER_RULES = (
    Rule("id", "integer", -25525525525565535, 25525525525565535, "invalid id", spark_type="bigint"),
    Rule("ip", "text"),
    Rule("port", "integer", 1, 65535, "invalid port", spark_type="int"),
    Rule("version", "text", 0, 128, "invalid server version", required=False),
    Rule("game", "text", 0, 8, "invalid game name"),
    Rule("hostname", "text", 1, 256, "invalid hostname"),
    Rule("clientnum", "integer", 0, 128, "invalid clientnum", spark_type="int"),
    Rule("maxclientnum", "integer", 0, 128, "invalid maxclientnum", spark_type="int"),
    Rule("map", "text", 0, 128, "invalid map name"),
    Rule("gametype", "text", 1, 16, "invalid gametype", required=False),
)
SERVER_KEYS = tuple(rule.name for rule in SERVER_RULES)

ERROR_TYPE = "array<struct<path:string,message:string>>"

HISTORY_SCHEMA = "metric string, time timestamp, count bigint"
HISTORY_METRICS = ("client", "instance", "server")
