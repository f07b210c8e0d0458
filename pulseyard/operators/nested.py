"""Server lists nested in instances."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import connect_string, occupancy_label, strip_color_codes


def flatten_nested(
    instances: DataFrame, nested: str = "servers", parents: Sequence[str] = ("instance_seq",)
) -> DataFrame:
    """One row per nested element with its position and the named parent columns."""
    return instances.select(*parents, F.posexplode(nested).alias("pos", "_item")).select(
        *parents, "pos", "_item.*"
    )


def server_place(seq: Column, pos: Column) -> Column:
    """One number that orders servers by instance, then by position, for any position.

    A single number keeps aggregates over it in hash form, where a struct would force a sort.
    """
    return seq.cast("decimal(28,0)") * F.lit(2**31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")


def attach_parent(
    instances: DataFrame, nested: str = "servers", prefix: str = "instance_", key: str = "instance_seq"
) -> DataFrame:
    """Every nested row beside its parent's columns; no join is needed."""
    parents = [c for c in instances.columns if c not in (nested, key) and f"{prefix}{c}" != key]
    renamed = instances.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in parents], nested)
    return flatten_nested(renamed, nested, [key, *[f"{prefix}{c}" for c in parents]])


def fleet_totals(instances: DataFrame, nested: str = "servers", measure: str = "clientnum") -> DataFrame:
    """Clients, instances and servers of the fleet, summed inside each row before aggregation."""
    clients = F.aggregate(
        nested, F.lit(0).cast("bigint"), lambda total, s: total + s[measure].cast("bigint")
    )
    return instances.agg(
        F.coalesce(F.sum(clients), F.lit(0)).alias("clients"),
        F.count(F.lit(1)).alias("instances"),
        F.coalesce(F.sum(F.size(nested)), F.lit(0)).alias("servers"),
    )


def sort_by_game(servers: DataFrame) -> DataFrame:
    return servers.orderBy("game", "instance_seq", "pos")


def sort_by_players(servers: DataFrame) -> DataFrame:
    """By game, then most players; equal counts keep their order."""
    return servers.orderBy("game", F.desc("clientnum"), "instance_seq", "pos")


#: Positions of servers that stand in one cell of ``row_before``.
PLACES_PER_CELL = 1 << 20


def row_before(
    servers: DataFrame, value: str = "id", name: str = "follows", group: str = "game", falling: str | None = None, place: str = "place"
) -> DataFrame:
    """``name``: the ``value`` of the row before in the group, by ``falling`` (largest first) and then ``place``.

    A group is cut into cells, each a function of the row: the value of ``falling`` and a range of places. A
    window holds one cell; the first row of a cell takes the last row of the cell before, from one edge row per
    cell. No window holds a group, however many rows it has.
    """
    cells = ["_part", *([falling] if falling else [])]
    placed = servers.withColumn("_part", F.floor(F.col(place) / PLACES_PER_CELL))
    edges = placed.groupBy(group, *cells).agg(F.max_by(value, place).alias("_edge"))
    along = [*([F.desc(falling)] if falling else []), "_part"]
    edges = edges.withColumn("_before", F.lag("_edge").over(Window.partitionBy(group).orderBy(*along)))
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in (group, *cells)], "_before")
    inside = F.lag(value).over(Window.partitionBy(group, *cells).orderBy(place))
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in (group, *cells)]
    joined = placed.withColumn("_inside", inside).join(edges, same)
    return joined.select(*servers.columns, F.coalesce("_inside", "_before").alias(name))


def group_servers(servers: DataFrame) -> DataFrame:
    """Servers by game. Groups stay as sorted rows: one game may hold a third of all servers, and
    range partitioning on the whole sort key splits it over tasks."""
    return sort_by_game(servers)


def game_summary(servers: DataFrame) -> DataFrame:
    """Players and servers per game."""
    return servers.groupBy("game").agg(
        F.sum("clientnum").alias("players"), F.count(F.lit(1)).alias("servers")
    )


def webfront_link(servers: DataFrame, url: str = "instance_webfront_url") -> DataFrame:
    """``webfront`` holds the address only when it is not empty."""
    return servers.withColumn("webfront", F.when(F.length(url) > 0, F.col(url)))


def describe_servers(servers: DataFrame) -> DataFrame:
    """Columns of the server list: clean name, occupancy, connect text, link."""
    return webfront_link(servers).select(
        "game",
        "instance_seq",
        "pos",
        strip_color_codes(F.col("hostname")).alias("hostname"),
        "map",
        "gametype",
        "clientnum",
        occupancy_label(F.col("clientnum"), F.col("maxclientnum")).alias("occupancy"),
        connect_string(F.col("ip"), F.col("port")).alias("connect"),
        "webfront",
    )
