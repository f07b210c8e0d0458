"""Registration of the scalars for use in SQL text."""

from pyspark.sql import SparkSession

from ..schemas import MAX_SERVERS
from .clock import AGE_UNITS
from .crypto import NONCE_BYTES
from .network import _GROUPS, _IPV4, IPV4_NON_PUBLIC, IPV6_NON_PUBLIC, URL_PATTERN, _cidr_bounds
from .text import COLOR_CODE_PATTERN, CONTENT_KINDS

_KINDS = " ".join(f"WHEN endswith(lower(name), '{suffix}') THEN {kind}" for suffix, kind in CONTENT_KINDS.items())

_V4_RANGES = " OR ".join(f"n BETWEEN {low}L AND {high}L" for low, high in map(_cidr_bounds, IPV4_NON_PUBLIC))
_V6_RANGES = " OR ".join(f"first BETWEEN {low}L AND {high}L" for low, high in IPV6_NON_PUBLIC)


def _age_text() -> str:
    """The ladder of ``time_ago`` as one expression over the age in seconds, ``amount``."""
    text, value = "CASE WHEN amount < 10 THEN 'just now'", "amount"
    for unit, per_next in AGE_UNITS:
        whole = f"CAST(floor({value}) AS BIGINT)"
        shown = f"concat({whole}, CASE WHEN {whole} = 1 THEN ' {unit} ago' ELSE ' {unit}s ago' END)"
        if per_next is None:
            return f"{text} ELSE {shown} END"
        text += f" WHEN {value} < {per_next!r}D THEN {shown}"
        value = f"({value} / {per_next!r}D)"
    raise ValueError("the last unit has none above it")


# name: (parameters, result type, expression). ``{p}`` is the prefix of functions they use. A one-element array
# names a value that is needed more than once. Each stays visible to the optimizer.
SQL_FUNCTIONS = {
    "strip_color_codes": ("s STRING", "STRING", f"regexp_replace(s, r'{COLOR_CODE_PATTERN}', '')"),
    "regex_replace": ("s STRING, find STRING, put STRING", "STRING", r"regexp_replace(s, find, regexp_replace(replace(put, '$', r'\$'), r'\\([0-9]+)', r'\$$1'))"),
    "occupancy_label": ("used INT, capacity INT", "STRING", "concat(used, '/', capacity)"),
    "connect_string": ("ip STRING, port INT", "STRING", "concat('connect ', ip, ':', port)"),
    "cents_to_text": ("cents BIGINT", "STRING", "format_string('%.2f', cents / 100.0D)"),
    "price_label": (
        "price STRING, unit STRING",
        "STRING",
        "CASE WHEN price = '0.00' THEN 'Free' ELSE concat('$', price, ' per ', unit) END",
    ),
    "count_or_zero": ("n BIGINT", "BIGINT", "coalesce(n, 0L)"),
    "content_type": (
        "name STRING",
        "INT",
        f"CASE {_KINDS} END",
    ),
    "percent_half_even": (
        "part BIGINT, total BIGINT",
        "BIGINT",
        "CAST(rint(CAST(part AS DOUBLE) / greatest(total, 1L) * 100) AS BIGINT)",
    ),
    "ceil_div": ("a BIGINT, b BIGINT", "BIGINT", "a div b + CASE WHEN a % b <> 0 AND (a > 0) = (b > 0) THEN 1 ELSE 0 END"),
    "mask16": ("n BIGINT", "BIGINT", "n & 65535L"),
    "uptime_clock": (
        "s BIGINT",
        "STRING",
        "format_string('%02d:%02d:%02d', pmod(s, 86400) div 3600, pmod(s, 3600) div 60, pmod(s, 60))",
    ),
    "format_duration": (
        "s BIGINT",
        "STRING",
        """concat(
             CASE WHEN floor(s / 86400) = 0 THEN ''
                  WHEN abs(floor(s / 86400)) = 1 THEN concat(floor(s / 86400), ' day, ')
                  ELSE concat(floor(s / 86400), ' days, ') END,
             format_string('%d:%02d:%02d',
               pmod(s, 86400) div 3600, pmod(s, 3600) div 60, pmod(s, 60)))""",
    ),
    "ipv4_number": (
        "ip STRING",
        "BIGINT",
        rf"CASE WHEN ip RLIKE r'\A{_IPV4}\z' THEN aggregate(split(ip, r'\.'), 0L, (a, o) -> a * 256L + CAST(o AS BIGINT)) END",
    ),
    "ipv6_text": (
        "ip STRING",
        "STRING",
        rf"""CASE WHEN contains(ip, ':') THEN
               transform(array({{p}}ipv4_number(regexp_extract(ip, r':({_IPV4})\z', 1))), tail -> CASE WHEN tail IS NULL THEN lower(ip)
                 ELSE concat(regexp_replace(lower(ip), r'{_IPV4}\z', ''), format_string('%x:%x', tail div 65536L, tail % 65536L)) END)[0] END""",
    ),
    "is_non_public_6": (
        "ip STRING",
        "BOOLEAN",
        rf"""transform(array({{p}}ipv6_text(ip)), x -> CASE
               WHEN (x RLIKE r'\A{_GROUPS}\z' AND size(filter(split(x, ':'), g -> g <> '')) = 8)
                 OR (x RLIKE r'\A(?:{_GROUPS})?::(?:{_GROUPS})?\z' AND size(filter(split(x, ':'), g -> g <> '')) <= 7)
               THEN x RLIKE r'\A[0:]*:0{{0,3}}1\z' OR coalesce(
                 transform(array(try_cast(conv(regexp_extract(x, r'\A([0-9a-f]+)', 1), 16, 10) AS BIGINT)), first -> {_V6_RANGES})[0], false) END)[0]""",
    ),
    "is_non_public": (
        "ip STRING",
        "BOOLEAN",
        f"transform(array({{p}}ipv4_number(ip)), n -> CASE WHEN n IS NOT NULL THEN {_V4_RANGES} ELSE {{p}}is_non_public_6(ip) END)[0]",
    ),
    "url_parts": (
        "url STRING",
        "STRUCT<origin STRING, host STRING, rest STRING>",
        f"""CASE WHEN url RLIKE r'{URL_PATTERN}' THEN named_struct('origin', regexp_extract(url, r'{URL_PATTERN}', 1),
              'host', regexp_extract(url, r'{URL_PATTERN}', 2), 'rest', regexp_extract(url, r'{URL_PATTERN}', 3)) END""",
    ),
    "time_ago": (
        "epoch BIGINT, now BIGINT",
        "STRING",
        f"transform(array(CAST(greatest(now - epoch, 0L) AS DOUBLE)), amount -> {_age_text()})[0]",
    ),
    "epoch_truncate": ("ts TIMESTAMP", "BIGINT", "unix_seconds(ts)"),
    "base64_encode": ("b BINARY", "STRING", r"translate(base64(b), '\r\n', '')"),
    "seal_content": (
        "payload BINARY, key BINARY",
        "BINARY",
        f"transform(array(aes_encrypt(payload, key, 'GCM')), s -> concat(substring(s, {NONCE_BYTES + 1}), substring(s, 1, {NONCE_BYTES})))[0]",
    ),
    "json_nested_field": ("body STRING, path STRING", "STRING", "get_json_object(body, path)"),
    "array_length_check": ("n INT", "BOOLEAN", f"n BETWEEN 0 AND {MAX_SERVERS}"),
}


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the temporary functions and return their names."""
    names = []
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) "
            f"RETURNS {result} RETURN {body.replace('{p}', prefix)}"
        )
        names.append(f"{prefix}{name}")
    return names
