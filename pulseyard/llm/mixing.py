"""Mixing sources to target weights by pivotal dependent rounding."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseyard.session import stored

from .shared import bit_words, may_contain, membership_bits, row_hash, spare_names, text_or_empty, uniform, without

OUTPUT = ("size", "source_size", "target", "copies")

#: Rows that meet in one node of the reduction tree, on average.
FAN_IN = 64


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _running(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Exact running sums over all rows by ``order``, up to and with the row.

    Rows are range partitioned, summed inside each part, and the parts are chained through one row each,
    so that no task ever holds all rows.
    """
    parts = stored(df.repartitionByRange(F.col(order).asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy("__part").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"__i_{k}": F.sum(v).over(inside) for k, v in sums.items()}).join(offsets, "__part")
    out = {k: F.col(f"__i_{k}") + F.col(f"__o_{k}") for k in sums}
    return summed.withColumns(out).select(*df.columns, *sums)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``rows``, ``source_size``, ``target`` from rows of (source, size).

    Sources by code point, null last, take the weights in turn. Their targets share ``share`` of all
    sizes by weight, none above ``most`` times its source; the excess goes to the others by weight until
    none is above. That end point is found directly: with sources sorted by ``cap / weight``, those
    before some place stand at their caps and the rest share what is left. ``share`` must not be above
    ``most``. A source without words has target 0.
    """
    if share > most:
        raise ValueError("the share asked for is above what all sources may give")
    rows = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    ranked = _rank(rows)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    weighed = weighed.withColumn("level", F.col("cap") / F.col("weight"))
    summed = stored(_running(weighed, "level", {"caps": "cap", "weights": "weight"}))
    whole = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    total = whole.select(share * F.col("size")).scalar()
    all_weights = whole.select("weight").scalar()
    # A source is capped when the level at which it fills up is not above what the others would get.
    rest = total - (F.col("caps") - F.col("cap"))
    open_weight = all_weights - (F.col("weights") - F.col("weight"))
    capped = F.col("level") * open_weight <= rest
    marked = stored(summed.withColumn("capped", capped))
    taken = marked.agg(
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)).alias("caps"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weights"),
    )
    water = (total - taken.select("caps").scalar()) / taken.select("weights").scalar()
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), water * F.col("weight")))
    return marked.select("source", "rows", "source_size", target.cast("double").alias("target"))


def _rank(rows: DataFrame) -> DataFrame:
    """``rank`` from 0 by code point of the source, null last."""
    counted = _running(rows.withColumn("__one", F.lit(1).cast("long")), "source", {"rank": "__one"})
    return counted.drop("__one").withColumn("rank", F.col("rank") - 1)


_UNIT = "struct<luck:bigint,id:{id},source:string,mark:bigint,size:bigint,n:bigint,whole:bigint,part:double>"


def _pair_up(units: Column, seed: int, id_type: str) -> Column:
    """Fold the units of one node; gives the settled units and the one that is still fractional.

    Two units with ``size * part`` words of fractional mass each meet. Either mass flows to the first
    until it is whole or the second is empty, or the other way round; the chances are such that no
    unit's expected copies change. The words of the pair stay the same, and one of the two is settled.
    """
    unit = _UNIT.format(id=id_type)
    begin = F.struct(F.lit(None).cast(unit).alias("rest"), F.array().cast(f"array<{unit}>").alias("settled"))

    def with_part(u: Column, whole: Column, part: Column) -> Column:
        return F.struct(u["luck"].alias("luck"), u["id"].alias("id"), u["source"].alias("source"), u["mark"].alias("mark"), u["size"].alias("size"), u["n"].alias("n"), whole.alias("whole"), part.alias("part"))

    def step(state: Column, b: Column) -> Column:
        a = state["rest"]
        zero, one = F.lit(0.0), F.lit(1.0)
        to_a = F.least(a["size"] * (one - a["part"]), b["size"] * b["part"])
        to_b = F.least(a["size"] * a["part"], b["size"] * (one - b["part"]))
        forward = uniform(F.lit(seed), a["luck"], b["luck"]) * (to_a + to_b) < to_b
        a_full = forward & (a["size"] * (one - a["part"]) <= b["size"] * b["part"])
        a_empty = ~forward & (a["size"] * a["part"] <= b["size"] * (one - b["part"]))
        a_part = a["part"] + F.when(forward, to_a).otherwise(-to_b) / a["size"]
        b_part = b["part"] - F.when(forward, to_a).otherwise(-to_b) / b["size"]
        inside = lambda x: F.least(F.greatest(x, zero), one)
        a_done = with_part(a, a["whole"] + F.when(a_full, 1).otherwise(0), zero)
        b_done = with_part(b, b["whole"] + F.when(forward, 0).otherwise(1), zero)
        a_left, b_left = with_part(a, a["whole"], inside(a_part)), with_part(b, b["whole"], inside(b_part))
        settles_a = a_full | a_empty
        met = F.struct(
            F.when(settles_a, b_left).otherwise(a_left).alias("rest"),
            F.concat(state["settled"], F.array(F.when(settles_a, a_done).otherwise(b_done))).alias("settled"),
        )
        return F.when(a.isNull(), F.struct(b.alias("rest"), state["settled"].alias("settled"))).otherwise(met)

    return F.aggregate(F.array_sort(units), begin, step)


def pivotal_rounding(units: DataFrame, seed: int, id_type: str) -> DataFrame:
    """Settle every fractional unit through a reduction tree per source.

    ``units``: luck, id, source, mark, size, n, whole, part and ``nodes`` (leaves of the source's tree). Hashed
    leaves of about ``FAN_IN`` units fold first; each hands one fractional unit on, and ``FAN_IN`` leaves
    meet in a node above, until each source has one unit left, which a last draw settles. A source with a
    third of all rows is thus as many groups as it needs, and each level moves 1/64 of the one below.
    """
    level = stored(units.withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "luck"), F.col("nodes"))))
    columns = ["luck", "id", "source", "mark", "size", "n", "whole", "part"]
    done = []
    depth = 0
    while True:
        depth += 1
        unit = F.struct(*[F.col(c).alias(c) for c in columns])
        folded = level.groupBy("source", "node").agg(F.collect_list(unit).alias("units"), F.first("nodes").alias("nodes"))
        folded = stored(folded.select("source", "node", "nodes", _pair_up(F.col("units"), seed + depth, id_type).alias("x")))
        done.append(folded.select(F.explode("x.settled").alias("u")).select("u.*"))
        rest = folded.select("x.rest.*", "node", "nodes")
        if rest.filter("nodes > 1").isEmpty():
            break
        level = rest.withColumns({"node": F.expr(f"node div {FAN_IN}"), "nodes": F.ceil(F.col("nodes") / FAN_IN)})
    last = uniform(F.lit(seed), F.col("luck"), F.col("source")) < F.col("part")
    out = rest.withColumns({"whole": F.col("whole") + F.when(last, 1).otherwise(0), "part": F.lit(0.0)}).select(*columns)
    for settled in done:
        out = out.unionByName(settled.select(*columns))
    return out


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    A row's expected copies are ``target / source_size`` of its source. Whole parts are certain, the
    fractions are rounded by the pivotal method weighted with sizes, so that a source's words differ from
    its target by less than one row's size, whatever the draw. Draws are hashes of ids, sizes and the
    seed: reruns agree. Null and empty texts have size 0; they weigh nothing and are rounded one by one.
    Equal rows (same id, source and text) are one unit with their number: they share its copies evenly,
    the first ones (in an arbitrary but fixed order) taking what is left over. Null is a source. Input
    columns named like an output are replaced. An empty table gives none.

    Everything is settled on narrow rows (id, source, a hash of the text, size); words are counted once.
    One merge join, whatever the sizes, then brings each row of ``docs`` its copies, and moves it once.
    """
    docs = without(docs, OUTPUT)
    ordinal, n_rows, tie, mark, whole = spare_names(docs, "row_ordinal", "n_equal_rows", "row_tie", "text_mark", "whole_copies")
    s_id, s_source, s_mark = spare_names(docs, "settled_id", "settled_source", "settled_mark")
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("mark"), word_count(text).alias("size"))
    rows = stored(narrow)
    id_type = rows.schema["id"].dataType.simpleString()
    targets = stored(source_targets(rows.select("source", "size"), weights, share, most))

    units = rows.groupBy("id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("n")).alias("u")
    units = units.join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
    mass = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.select(
        F.xxhash64(F.lit(seed), "u.id", "u.source", "size").alias("luck"),
        "u.id",
        "u.source",
        "u.mark",
        "size",
        "n",
        F.floor(mass).alias("whole"),
        (mass - F.floor(mass)).alias("part"),
        F.ceil(F.col("rows") / FAN_IN).alias("nodes"),
    )
    units = stored(units)
    open_units = units.filter("part > 0 and size > 0")
    alone = units.filter("part = 0 or size = 0")
    luck = uniform(F.lit(seed + 1), F.col("luck")) < F.col("part")
    alone = alone.withColumn("whole", F.col("whole") + F.when(luck, 1).otherwise(0))
    unit_columns = ["id", "source", "mark", "size", "n", "whole"]
    settled = alone.select(*unit_columns).unionByName(pivotal_rounding(open_units, seed, id_type).select(*unit_columns))
    settled = settled.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    names = {"s.id": s_id, "s.source": s_source, "s.mark": s_mark, "s.n": n_rows, "s.whole": whole}
    settled = stored(settled.select(*[F.col(c).alias(name) for c, name in names.items()], "size", "source_size", "target"))

    marked = docs.withColumn(mark, F.xxhash64(text))
    source = F.col(source_col).cast("string")
    same = F.col(id_col).eqNullSafe(F.col(s_id)) & source.eqNullSafe(F.col(s_source)) & (F.col(mark) == F.col(s_mark))
    twins = stored(settled.filter(F.col(n_rows) > 1).select(s_id, s_source, s_mark))
    n_twins = twins.count()
    columns = [*[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target"]
    if not n_twins:
        return marked.join(settled.hint("merge"), same).select(*columns, F.col(whole).cast("long").alias("copies"))
    # Rows are numbered only where equal rows exist (or the filter takes them for such).
    maybe_equal = may_contain(membership_bits(twins, bit_words(n_twins)), F.col(id_col), source, F.col(mark))
    single = marked.filter(~maybe_equal).join(settled.hint("merge"), same).withColumn("copies", F.col(whole))
    order = Window.partitionBy(s_id, s_source, s_mark).orderBy(tie)
    equal = marked.withColumn(tie, row_hash(docs)).filter(maybe_equal).join(settled.hint("merge"), same)
    equal = equal.withColumn(ordinal, F.row_number().over(order))
    shared = F.expr(f"`{whole}` div `{n_rows}`") + F.when(F.col(ordinal) <= F.col(whole) % F.col(n_rows), 1).otherwise(0)
    equal = equal.withColumn("copies", shared)
    columns = [*columns, F.col("copies").cast("long").alias("copies")]
    return single.select(*columns).unionByName(equal.select(*columns))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies, without the columns of the operator."""
    columns = [c for c in mixed.columns if c not in OUTPUT]
    (number,) = spare_names(mixed, "copy_number")
    copied = mixed.filter("copies > 0").withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copied.select(*columns)
