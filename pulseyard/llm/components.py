"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored


#: Parts into which the edges of a node are dealt by their other end.
SALTS = 64


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them: the larger ones, or the smaller ones.

    The edges of a node are dealt by (node, salt of the other end), so that the centre of a large star is
    ``SALTS`` groups. Each finds its least end, these meet per node, and the least comes back per (node, salt).
    """
    sides = edges
    if both_ways:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = sides.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = sides.groupBy("a", "salt").agg(F.min("b").alias("low"))
    least = parts.groupBy("a").agg(F.min("low").alias("low")).select("a", F.least("a", "low").alias("least"))
    joined = sides.join(parts.select("a", "salt").join(least, "a"), ["a", "salt"])
    if both_ways:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b); ``root`` is the least node of its component.

    Kiveris et al. (2014), "Connected Components in MapReduce and Beyond": the number of rounds grows
    with the logarithm of the table, every round is a grouping and a join of edges, and no list of
    neighbours is ever put together. Each round is written to the shared folder. Edges from a node to
    itself are ignored; an empty table gives none.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    state = stored(ordered)
    before = None
    while True:
        sign = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before or not sign[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = sign
        state = stored(_star(_star(state, both_ways=True), both_ways=False))
