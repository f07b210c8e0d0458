"""Labels and text clean-up."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# In-game colour codes, content kinds by file suffix.
COLOR_CODE_PATTERN = r"\^([0-9]+|:)"
CONTENT_KINDS = {".dll": 0, ".js": 1}


def regex_replace(value: Column, pattern: str, replacement: str) -> Column:
    """Replace every match; group references in ``replacement`` are written ``\\1``."""
    java_text = re.sub(r"\\(\d+)", r"${\1}", replacement.replace("$", r"\$"))
    java_text = re.sub(r"\$\{(\d+)\}", r"$\1", java_text)
    return F.regexp_replace(value, pattern, java_text)


def strip_color_codes(value: Column) -> Column:
    return F.regexp_replace(value, COLOR_CODE_PATTERN, "")


def occupancy_label(used: Column, capacity: Column) -> Column:
    return F.concat(used.cast("string"), F.lit("/"), capacity.cast("string"))


def connect_string(ip: Column, port: Column) -> Column:
    return F.concat(F.lit("connect "), ip, F.lit(":"), port.cast("string"))


def cents_to_text(cents: Column) -> Column:
    """Two-decimal text of an amount in cents."""
    return F.format_string("%.2f", cents / F.lit(100.0))


def price_label(price_text: Column, period_unit: Column) -> Column:
    paid = F.concat(F.lit("$"), price_text, F.lit(" per "), period_unit)
    return F.when(price_text == "0.00", F.lit("Free")).otherwise(paid)


def count_or_zero(count: Column) -> Column:
    return F.coalesce(count, F.lit(0).cast("bigint"))


def content_type(name: Column) -> Column:
    """Kind of a content file from its suffix in any case, null when unknown."""
    lowered = F.lower(name)
    kind = F.lit(None).cast("int")
    for suffix, code in CONTENT_KINDS.items():
        kind = F.when(lowered.endswith(suffix), F.lit(code)).otherwise(kind)
    return kind


def base64_encode(value: Column) -> Column:
    """Base64 on one line; the built-in breaks lines after 76 characters."""
    return F.translate(F.base64(value), "\r\n", "")
