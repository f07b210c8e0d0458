"""Heartbeat bodies to typed rows: parse, repair, validate, split.

Every step is a row-wise projection, so ingestion never shuffles. JSON is held as variant because
an absent key, a null and a wrong type lead to different results. A body's shape is told once, from the
schema of its variant: bodies of a known good shape are cast to typed rows as a whole, and only limits are
left to test; the others are read field by field.
"""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import mask16
from ..functions.clock import epoch_seconds
from ..functions.network import is_non_public, normalize_webfront
from ..schemas import (
    BAD_SERVER_COUNT,
    DEFAULT_GAMETYPE,
    DEFAULT_SERVER_VERSION,
    ERROR_TYPE,
    INSTANCE_KEYS,
    INSTANCE_RULES,
    MAX_SERVERS,
    MISSING,
    NOT_INTEGER,
    NOT_OBJECT,
    NOT_STRING,
    NULL,
    SERVER_KEYS,
    SERVER_RULES,
    UNKNOWN_FIELD,
    Rule,
)

DOCUMENT = "map<string,variant>"
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
PORT = next(rule for rule in SERVER_RULES if rule.name == "port")

# Schema texts of a JSON scalar that is not null.
_SCALAR = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\(\d+,\d+\))"


def _object_shape(rules: tuple[Rule, ...], **others: str) -> str:
    """Pattern of the schema text of an object whose fields have the types of their rules.

    ``others`` are patterns of further fields; one that ends with ``?`` may be absent. Schema texts list
    fields by name. The first field by name must be a required one.
    """
    fields = {name: (pattern.removesuffix("?"), not pattern.endswith("?")) for name, pattern in others.items()}
    for rule in rules:
        kind = {"integer": "BIGINT", "text": "STRING", "any": _SCALAR}[rule.kind]
        fields[rule.name] = (f"(?:{kind}|VOID)" if rule.nullable else kind, rule.required and rule.name != "ip")
    parts = []
    for name, (pattern, required) in sorted(fields.items()):
        part = f"{', ' if parts else ''}{name}: {pattern}"
        parts.append(part if required else f"(?:{part})?")
    if parts[0].startswith("(?:"):
        raise ValueError("the first field by name must be required")
    return f"OBJECT<{''.join(parts)}>"


# A missing address of a server is repaired, so its shape may lack one.
SERVER_SHAPE = _object_shape(SERVER_RULES)
BODY_SHAPE = rf"\A{_object_shape(INSTANCE_RULES, servers=rf'ARRAY<(?:VOID|{SERVER_SHAPE})>', ip_address=rf'(?:{_SCALAR}|VOID)?')}\z"
MAY_BE_ABSENT = tuple(rule.name for rule in SERVER_RULES if not rule.required) + ("ip",)


def _typed_schema(rules: tuple[Rule, ...]) -> str:
    kinds = {"integer": "bigint", "text": "string"}
    return ",".join(f"{rule.name}:{kinds[rule.kind]}" for rule in rules if rule.kind in kinds)


TYPED_BODY = f"struct<{_typed_schema(INSTANCE_RULES)},servers:array<struct<{_typed_schema(SERVER_RULES)}>>>"


def variant_kind(value: Column) -> Column:
    """First word of the JSON type: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (a JSON null),
    OBJECT or ARRAY; null when absent."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def read_cell(value: Column, rule: Rule) -> Column:
    """Struct ``(kind, text, number)`` of one JSON value, with the part that its rule needs.

    ``number`` is a whole number, a truncated decimal or a numeric text. A boolean also has a number
    here, and the rules below refuse it by its kind.
    """
    text = F.try_variant_get(value, "$", "string")
    number = F.lit(None)
    if rule.kind == "integer":
        is_text = F.schema_of_variant(value) == "STRING"
        number = F.when(is_text, text.try_cast("bigint")).otherwise(F.try_variant_get(value, "$", "bigint"))
        text = F.lit(None)
    return F.struct(
        variant_kind(value).alias("kind"),
        text.cast("string").alias("text"),
        number.cast("bigint").alias("number"),
    )


def _computed(rows: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """``rows`` with ``columns`` computed once per row.

    ``inline`` of one struct keeps the optimizer from copying the expressions into every place that
    uses them; a filter on ``errors`` would otherwise parse the body again for each field.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*kept, F.inline(F.array(row)))


def read_cells(document: Column, rules: tuple[Rule, ...]) -> Column:
    cells = [read_cell(F.try_element_at(document, F.lit(r.name)), r).alias(r.name) for r in rules]
    return F.struct(*cells)


def _cell(kind: str, text: Column, number: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        text.cast("string").alias("text"),
        number.cast("bigint").alias("number"),
    )


def fix_server_ip(ip: Column, remote_ip: Column) -> Column:
    """Sender address in place of one that is missing, unreadable, private or loopback.

    ``ip`` is a cell. A JSON number stays as it is, for validation to reject.
    """
    unusable = F.coalesce(is_non_public(ip["text"]), F.lit(True))
    replace = ip["kind"].isNull() | (~ip["kind"].isin(*NUMBERS) & unusable)
    return F.when(replace, _cell("STRING", remote_ip, F.lit(None))).otherwise(ip)


def fix_server_version(version: Column) -> Column:
    """Default when the key is absent; an explicit null stays and fails validation."""
    default = _cell("STRING", F.lit(DEFAULT_SERVER_VERSION), F.lit(None))
    return F.when(version["kind"].isNull(), default).otherwise(version)


def fix_port(port: Column) -> Column:
    """Lowest 16 bits of a whole number or boolean; any other type keeps no number."""
    masked = _cell("BIGINT", F.lit(None), mask16(port["number"]))
    bare = F.struct(
        port["kind"].alias("kind"), port["text"].alias("text"), F.lit(None).cast("bigint").alias("number")
    )
    return F.when(port["kind"].isin("BIGINT", "BOOLEAN"), masked).otherwise(bare)


def _message(cell: Column, rule: Rule) -> Column:
    """Message of the rule that the cell breaks, or null."""
    kind = cell["kind"]
    message = F.when(kind.isNull(), F.lit(MISSING if rule.required else None).cast("string"))
    message = message.when(kind == "VOID", F.lit(None if rule.nullable else NULL).cast("string"))
    if rule.kind == "integer":
        number = cell["number"]
        too_large = kind.isin(*NUMBERS) & number.isNull() & (rule.name != PORT.name)
        message = message.when(too_large, rule.message or NOT_INTEGER)
        message = message.when(number.isNull() | (kind == "BOOLEAN"), NOT_INTEGER)
        if rule.low is not None:
            message = message.when(~number.between(rule.low, rule.high), rule.message)
    elif rule.kind == "text":
        message = message.when(kind != "STRING", NOT_STRING)
        if rule.low is not None:
            message = message.when(~F.length(cell["text"]).between(rule.low, rule.high), rule.message)
    return message


def _error(path: Column, message: Column) -> Column:
    return F.struct(path.alias("path"), message.alias("message"))


def _plainly_good(cell: Column, rule: Rule) -> Column:
    """True for the common case of a good value; false leaves the decision to ``_message``."""
    good = cell["kind"] == ("BIGINT" if rule.kind == "integer" else "STRING")
    if rule.low is not None:
        size = cell["number"] if rule.kind == "integer" else F.length(cell["text"])
        good = good & (size >= rule.low) & (size <= rule.high)
    return F.coalesce(good, F.lit(not rule.required))


def _rule_errors(cells: Column, rules: tuple[Rule, ...]) -> Column:
    """(field, message) of the broken rules."""
    found = [_error(F.lit(r.name), _message(cells[r.name], r)) for r in rules]
    broken = F.filter(F.array(*found), lambda e: e["message"].isNotNull())
    all_good = reduce(and_, (_plainly_good(cells[r.name], r) for r in rules))
    return F.when(all_good, F.array().cast(ERROR_TYPE)).otherwise(broken)


def _unknown_keys(keys: Column, known: tuple[str, ...]) -> Column:
    extra = F.array_except(keys, F.array(*map(F.lit, known)))
    return F.transform(extra, lambda key: _error(key, F.lit(UNKNOWN_FIELD)))


def _typed(cell: Column, rule: Rule) -> Column:
    if rule.kind == "integer":
        return F.when(cell["kind"] != "BOOLEAN", cell["number"]).try_cast(rule.spark_type)
    return F.when(cell["kind"] == "STRING", cell["text"])


def version_class(kind: Column) -> Column:
    """Type class that keeps the version 1 apart from "1" and together with 1.0."""
    return F.when(kind.isin(*NUMBERS), "number").when(kind == "STRING", "text").otherwise(F.lower(kind))


def _read_documents(rows: DataFrame) -> DataFrame:
    """Add ``cells`` and ``servers`` of the column ``doc``."""
    servers = F.try_variant_get(F.try_element_at("doc", F.lit("servers")), "$", "array<variant>")
    documents = F.transform(servers, lambda s: F.try_variant_get(s, "$", DOCUMENT))
    return _computed(
        rows,
        rows.columns,
        cells=F.when(F.col("doc").isNotNull(), read_cells(F.col("doc"), INSTANCE_RULES)),
        servers=F.transform(
            documents,
            lambda d: F.struct(F.map_keys(d).alias("keys"), read_cells(d, SERVER_RULES).alias("cells")),
        ),
    )


def parse_heartbeats(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add ``doc`` (fields of the JSON object), ``cells`` of its scalar fields and ``servers``
    (null when not an array), each with its keys and the cells of its fields."""
    return _read_documents(_computed(raw, raw.columns, doc=F.try_variant_get(F.try_parse_json(body), "$", DOCUMENT)))


def _parse_by_shape(raw: DataFrame) -> DataFrame:
    """Add ``typed``, the whole body read at once, where its shape is good, and ``doc`` for all others.

    ``version`` may have any type and is taken from the variant. The schema of a list merges those of its elements, so it does not show a null beside a value: where
    the body has a null somewhere, every server must have all fields that may be absent.
    """
    parsed = _computed(raw, raw.columns, _json=F.try_parse_json("body"))
    shaped = F.coalesce(F.schema_of_variant("_json").rlike(BODY_SHAPE), F.lit(False))
    cast = _computed(parsed, parsed.columns, typed=F.when(shaped, F.from_json("body", TYPED_BODY)))
    whole = F.forall("typed.servers", lambda s: reduce(and_, (s[name].isNotNull() for name in MAY_BE_ABSENT)))
    known = F.col("typed").isNotNull() & (~F.contains("body", F.lit("null")) | F.coalesce(whole, F.lit(False)))
    kept = [c for c in cast.columns if c not in ("_json", "typed", "version")]
    return _computed(
        cast,
        kept,
        typed=F.when(known, F.col("typed")),
        version=F.try_variant_get("_json", "$.version", "variant"),
        doc=F.when(~known, F.try_variant_get("_json", "$", DOCUMENT)),
    )


def _beyond(row: Column, rule: Rule) -> Column:
    """True where the value breaks its limits; null where there is none."""
    value = row[rule.name]
    if rule.name == PORT.name:
        return mask16(value) < rule.low  # 16 bits are never too many
    if rule.kind != "text":
        return (value < rule.low) | (value > rule.high)
    too_long = F.length(value) > rule.high
    return too_long if rule.low == 0 else (F.length(value) < rule.low) | too_long


def _any_beyond(row: Column, rules: tuple[Rule, ...]) -> Column:
    return F.coalesce(reduce(or_, (_beyond(row, rule) for rule in rules if rule.low is not None)), F.lit(False))


def _limit_errors(row: Column, rules: tuple[Rule, ...], prefix: Column | None = None) -> Column:
    """(field, message) of the limits that a typed row breaks; the types are right already."""
    found = []
    for rule in (r for r in rules if r.low is not None):
        path = F.lit(rule.name) if prefix is None else F.concat(prefix, F.lit(f".{rule.name}"))
        found.append(F.when(_beyond(row, rule), _error(path, F.lit(rule.message))))
    return F.when(_any_beyond(row, rules), F.array_compact(F.array(*found))).otherwise(F.array().cast(ERROR_TYPE))


def _typed_body_errors(typed: Column) -> Column:
    servers = typed["servers"]
    count = F.when(F.size(servers) > MAX_SERVERS, F.array(_error(F.lit("servers"), F.lit(BAD_SERVER_COUNT))))
    each = F.transform(servers, lambda s, i: _limit_errors(s, SERVER_RULES, F.concat(F.lit("servers."), i.cast("string"))))
    each = F.when(F.exists(servers, lambda s: _any_beyond(s, SERVER_RULES)), F.flatten(each)).otherwise(F.array().cast(ERROR_TYPE))
    return F.concat(_limit_errors(typed, INSTANCE_RULES), F.coalesce(count, F.array().cast(ERROR_TYPE)), each)


def _typed_body_server(server: Column, remote_ip: Column) -> Column:
    """A typed server after the repairs of ``repair_servers`` and with its defaults."""
    values = {rule.name: server[rule.name] for rule in SERVER_RULES}
    usable = F.coalesce(~is_non_public(values["ip"]), F.lit(False))
    values["ip"] = F.when(usable, values["ip"]).otherwise(remote_ip)
    values["version"] = F.coalesce(values["version"], F.lit(DEFAULT_SERVER_VERSION))
    values["gametype"] = F.coalesce(values["gametype"], F.lit(DEFAULT_GAMETYPE))
    values[PORT.name] = mask16(values[PORT.name])
    return F.struct(*[values[rule.name].try_cast(rule.spark_type).alias(rule.name) for rule in SERVER_RULES])


def repair_servers(parsed: DataFrame, remote_ip: str = "remote_ip") -> DataFrame:
    """Repair address, version and port of every server cell."""

    def repair(server: Column) -> Column:
        cells = server["cells"]
        repaired = {
            "ip": fix_server_ip(cells["ip"], F.col(remote_ip)),
            "version": fix_server_version(cells["version"]),
            "port": fix_port(cells["port"]),
        }
        fields = [repaired.get(r.name, cells[r.name]).alias(r.name) for r in SERVER_RULES]
        return F.struct(server["keys"].alias("keys"), F.struct(*fields).alias("cells"))

    kept = [c for c in parsed.columns if c != "servers"]
    return _computed(parsed, kept, servers=F.transform("servers", repair))


def _server_errors(server: Column, position: Column) -> Column:
    path = F.concat(F.lit("servers."), position.cast("string"))
    errors = F.concat(
        _rule_errors(server["cells"], SERVER_RULES), _unknown_keys(server["keys"], SERVER_KEYS)
    )
    placed = F.transform(errors, lambda e: _error(F.concat(path, F.lit("."), e["path"]), e["message"]))
    return F.when(server["keys"].isNull(), F.array(_error(path, F.lit(NOT_OBJECT)))).otherwise(placed)


def apply_default(cell: Column, typed: Column, default: Column) -> Column:
    """``default`` when the key is absent."""
    return F.when(cell["kind"].isNull(), default).otherwise(typed)


def _typed_server(server: Column) -> Column:
    cells = server["cells"]
    typed = {rule.name: _typed(cells[rule.name], rule) for rule in SERVER_RULES}
    typed["gametype"] = apply_default(cells["gametype"], typed["gametype"], F.lit(DEFAULT_GAMETYPE))
    return F.struct(*[value.alias(name) for name, value in typed.items()])


def validate_heartbeats(
    raw: DataFrame, remote_ip: str = "remote_ip", received_at: str = "received_at"
) -> DataFrame:
    """Typed heartbeats with an ``errors`` array; a row is accepted when it is empty.

    Input columns are ``body``, the sender address and the receive time; any others are kept. The
    receive time always wins over a client time, and the sender over a client address.
    """
    kept = [c for c in raw.columns if c not in ("body", remote_ip, received_at)]
    repaired = repair_servers(_read_documents(_parse_by_shape(raw)), remote_ip)

    servers = F.try_element_at("doc", F.lit("servers"))
    server_count = (
        F.when(servers.isNull(), MISSING)
        .when(F.is_variant_null(servers), NULL)
        .when(F.col("servers").isNull(), NOT_OBJECT)
        .when(F.size("servers") > MAX_SERVERS, BAD_SERVER_COUNT)
    )
    errors = F.concat(
        _rule_errors(F.col("cells"), INSTANCE_RULES),
        F.filter(F.array(_error(F.lit("servers"), server_count)), lambda e: e["message"].isNotNull()),
        _unknown_keys(F.map_keys("doc"), INSTANCE_KEYS),
        F.coalesce(F.flatten(F.transform("servers", _server_errors)), F.array().cast(ERROR_TYPE)),
    )
    not_object = F.array(_error(F.lit("_schema"), F.lit(NOT_OBJECT)))

    cells, typed, known = F.col("cells"), F.col("typed"), F.col("typed").isNotNull()
    read = {rule.name: _typed(cells[rule.name], rule) for rule in INSTANCE_RULES}

    def either(of_shape: Column, of_fields: Column) -> Column:
        return F.when(known, of_shape).otherwise(of_fields)

    judged = _computed(
        repaired,
        repaired.columns,
        errors=F.when(known, _typed_body_errors(typed)).when(F.col("doc").isNull(), not_object).otherwise(errors),
    )
    version = F.col("version")
    sender = F.col(remote_ip)
    # Plain columns above the errors: those not asked for, and all of rows that a filter on the errors drops, are not computed.
    return judged.select(
        *kept,
        received_at,
        either(typed["id"], read["id"]).alias("id"),
        either(F.try_variant_get(version, "$", "string"), cells["version"]["text"]).alias("version"),
        version_class(either(variant_kind(version), cells["version"]["kind"])).alias("version_kind"),
        either(typed["uptime"].try_cast("int"), read["uptime"]).alias("uptime"),
        either(F.transform(typed["servers"], lambda s: _typed_body_server(s, sender)), F.transform("servers", _typed_server)).alias("servers"),
        sender.alias("ip_address"),
        normalize_webfront(either(typed["webfront_url"], read["webfront_url"]), sender).alias("webfront_url"),
        epoch_seconds(F.col(received_at)).alias("last_heartbeat"),
        "errors",
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)


def reject_quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their original body and messages)."""
    validated = validate_heartbeats(raw.withColumn("raw_body", F.col("body")))
    bad = rejected(validated).select(
        *[c for c in raw.columns if c not in ("body", "remote_ip")],
        F.col("raw_body").alias("body"),
        F.col("ip_address").alias("remote_ip"),
        "errors",
    )
    return accepted(validated).drop("raw_body"), bad
