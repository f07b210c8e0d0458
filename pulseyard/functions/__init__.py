"""Scalar functions, Column in and Column out."""

from .arithmetic import ceil_div, mask16, percent_half_even
from .clock import epoch_seconds, format_duration, time_ago, uptime_clock
from .crypto import derive_key, seal_content
from .network import ip_version, ipv4_number, is_non_public, normalize_webfront, url_parts
from .sql import register_sql_functions
from .text import (
    base64_encode,
    cents_to_text,
    connect_string,
    content_type,
    count_or_zero,
    occupancy_label,
    price_label,
    regex_replace,
    strip_color_codes,
)

__all__ = [
    "base64_encode",
    "ceil_div",
    "cents_to_text",
    "connect_string",
    "content_type",
    "count_or_zero",
    "derive_key",
    "epoch_seconds",
    "format_duration",
    "ip_version",
    "ipv4_number",
    "is_non_public",
    "mask16",
    "normalize_webfront",
    "occupancy_label",
    "percent_half_even",
    "price_label",
    "regex_replace",
    "register_sql_functions",
    "seal_content",
    "strip_color_codes",
    "time_ago",
    "uptime_clock",
    "url_parts",
]
