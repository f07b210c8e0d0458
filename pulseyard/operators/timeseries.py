"""Fleet history: census, gap filling, retention, downsampling.

A history is a long table ``(metric, time, count)``. Samples that agree in all three columns are
interchangeable, so positions are computed on runs of equal samples and not on rows. A run is one
row of a grouped aggregate with a map-side part; that keeps a burst of equal samples small. Above the
runs stands a tree of counts, by hour and by day: it tells which hours hold a wanted position, and only
the runs of these hours are put in order.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import ceil_div, floor_to
from ..functions.clock import DAY, HOUR, epoch_seconds, time_ago
from ..schemas import HISTORY_METRICS
from .registry import EXPIRY_SECONDS, SWEEP_SECONDS, purge_time

# Seconds between samples, samples kept per series (a week), chart resolution, zoom.
SAMPLE_SECONDS = 30
MAX_SAMPLES = 20_160
CHART_POINTS = 500
ZOOM_FACTOR = 2


def _ticks(first: Column, last: Column, step: int) -> Column:
    """Rows for every ``step`` between two epoch seconds."""
    return F.explode(F.sequence(first, last, F.lit(step).cast("bigint")))


def _spine(
    bounds: DataFrame, first: str, last: str, step: int, name: str, keep: Sequence[str] = (), until: Column | None = None
) -> DataFrame:
    """Ticks ``first, first + step, ... <= last`` of every row of ``bounds``, in short arrays."""
    block = step * 4096
    if until is not None:
        bounds = bounds.withColumn(last, until)
    starts = bounds.filter(F.col(first) <= F.col(last)).select(
        *keep, F.col(last).alias("_last"), _ticks(F.col(first), F.col(last), block).alias("_start")
    )
    stop = F.least(F.col("_last"), F.col("_start") + (block - step))
    return starts.select(*keep, _ticks(F.col("_start"), stop, step).alias(name))


def census_at_ticks(
    heartbeats: DataFrame,
    key: str = "id",
    time: str = "received_at",
    seq: str = "seq",
    nested: str = "servers",
    measure: str = "clientnum",
    tick: int = SAMPLE_SECONDS,
    expiry: int = EXPIRY_SECONDS,
    sweep: int = SWEEP_SECONDS,
    dense: bool = False,
) -> DataFrame:
    """Registered clients, instances and servers at every tick, as ``(tick, clients, ...)``.

    A tick sees the newest heartbeat of each key at or before it, unless it was purged. Lists are
    reduced to two numbers per row before anything is shuffled. Only the last heartbeat of a key
    before a tick can matter, so a key shrinks to one row per tick on the map side; the window that
    finds the next heartbeat then holds at most one row per tick, however hot the key.

    A sweep line does the rest: a heartbeat counts up at its slot and down where it is replaced or purged,
    changes are added up per tick, and their running sum is the census. What is shuffled does not depend
    on how many ticks a heartbeat lives. With ``dense``, ticks without instances are listed with zeros.
    """
    clients = F.aggregate(
        nested, F.lit(0).cast("bigint"), lambda total, s: total + s[measure].cast("bigint")
    )
    at = epoch_seconds(F.col(time))
    # First tick that no longer sees the row; a row may be purged before its own slot.
    gone = ceil_div(purge_time(at, expiry, sweep), F.lit(tick)) * tick
    narrow = heartbeats.select(
        F.col(key).alias("_key"),
        (ceil_div(at, F.lit(tick)) * tick).alias("slot"),
        F.struct(time, seq).alias("_order"),
        F.struct(
            gone.alias("gone"), F.size(nested).cast("bigint").alias("servers"), clients.alias("clients")
        ).alias("hb"),
    )
    slots = narrow.groupBy("_key", "slot").agg(F.max_by("hb", "_order").alias("hb"))
    following = F.lead("slot").over(Window.partitionBy("_key").orderBy("slot"))
    alive = slots.withColumn("_end", F.least(following, F.col("hb.gone"))).filter(F.col("_end") > F.col("slot"))
    one = F.lit(1).cast("bigint")
    up = F.struct(F.col("slot").alias("tick"), F.col("hb.clients").alias("clients"), one.alias("instances"), F.col("hb.servers").alias("servers"))
    down = F.struct(F.col("_end").alias("tick"), (-F.col("hb.clients")).alias("clients"), (-one).alias("instances"), (-F.col("hb.servers")).alias("servers"))
    changes = alive.select(F.inline(F.array(up, down))).groupBy("tick").agg(*[F.sum(c).alias(c) for c in _CENSUS])
    levels = _running_levels(changes, tick * TICKS_PER_CELL)
    if not dense:
        levels = levels.filter("instances > 0")
    return _spine(levels, "tick", "_last", tick, "tick", _CENSUS, until=F.col("_next") - tick).select("tick", *_CENSUS)


_CENSUS = ("clients", "instances", "servers")

# Ticks that are summed in one group; a cell's sum stands for them in the level above.
TICKS_PER_CELL = 4096


def _running_levels(changes: DataFrame, cell: int) -> DataFrame:
    """Sums of all changes up to each tick, and ``_next``, the tick of the following change.

    Prefix sums go by cells of time first and then over one row per cell, so that no task holds all ticks.
    The last change, after which nothing is left, is dropped.
    """
    placed = changes.withColumn("_cell", floor_to(F.col("tick"), cell))
    in_cell = Window.partitionBy("_cell").orderBy("tick")
    upper = placed.groupBy("_cell").agg(F.min("tick").alias("_begin"), *[F.sum(c).alias(f"_s_{c}") for c in _CENSUS])
    by_cell = Window.orderBy("_cell")  # one row per TICKS_PER_CELL ticks of the time range
    earlier = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    upper = upper.select(
        "_cell",
        F.lead("_begin").over(by_cell).alias("_following"),
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), zero).alias(f"_o_{c}") for c in _CENSUS],
    )
    up_to = in_cell.rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.sum(c).over(up_to) for c in _CENSUS}
    inside = placed.select("tick", "_cell", F.lead("tick").over(in_cell).alias("_then"), *[v.alias(c) for c, v in sums.items()])
    return inside.join(upper, "_cell").select(
        "tick",
        F.coalesce("_then", "_following").alias("_next"),
        *[(F.col(c) + F.col(f"_o_{c}")).alias(c) for c in _CENSUS],
    ).filter("_next is not null")


def census_to_history(census: DataFrame) -> DataFrame:
    """Wide census to the long history table."""
    series = F.array(
        F.struct(F.lit("client").alias("metric"), F.col("clients").alias("count")),
        F.struct(F.lit("instance").alias("metric"), F.col("instances").alias("count")),
        F.struct(F.lit("server").alias("metric"), F.col("servers").alias("count")),
    )
    return census.select(F.timestamp_seconds("tick").alias("time"), F.explode(series).alias("s")).select(
        "s.metric", "time", "s.count"
    )


def append_sample(history: DataFrame, samples: DataFrame, metric: str, override_time: int | None = None) -> DataFrame:
    """History with ``samples`` ``(time, count)`` added to one series, times cut to whole seconds."""
    time = F.lit(override_time) if override_time is not None else epoch_seconds(F.col("time"))
    added = samples.select(
        F.lit(metric).alias("metric"),
        F.timestamp_seconds(time).alias("time"),
        F.col("count").cast("bigint").alias("count"),
    )
    return history.select("metric", "time", "count").unionByName(added)


def _count_runs(history: DataFrame) -> DataFrame:
    return history.groupBy("metric", epoch_seconds(F.col("time")).alias("t"), "count").agg(
        F.count(F.lit(1)).alias("n")
    )


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))


def sample_cells(runs: DataFrame, cell: int = HOUR, group: int = DAY) -> DataFrame:
    """Tree of counts over runs: ``(metric, cell, samples, start, length)``.

    ``samples`` of the ``length`` samples of a series lie in the cell, after ``start`` earlier ones. Cells
    are summed inside a group of cells, groups inside a series: windows hold the cells of one group and the
    groups of one series, a number that the time range bounds and not the rows.
    """
    cells = runs.groupBy("metric", floor_to(F.col("t"), cell).alias("cell")).agg(F.sum("n").alias("samples"))
    cells = cells.withColumn("_group", floor_to(F.col("cell"), group))
    by_metric = Window.partitionBy("metric")
    groups = cells.groupBy("metric", "_group").agg(F.sum("samples").alias("_n"))
    groups = groups.select("metric", "_group", _before("_n", by_metric.orderBy("_group")).alias("_offset"), F.sum("_n").over(by_metric).alias("length"))
    within = _before("samples", Window.partitionBy("metric", "_group").orderBy("cell"))
    placed = cells.withColumn("_within", within).join(groups, ["metric", "_group"])
    return placed.select("metric", "cell", "samples", (F.col("_offset") + F.col("_within")).alias("start"), "length")


def _ordered_runs(runs: DataFrame, touched: DataFrame, cell: int, *keep: str) -> DataFrame:
    """Runs of the touched cells with ``before``, the number of samples of their series before them."""
    held = runs.withColumn("cell", floor_to(F.col("t"), cell)).join(touched.select("metric", "cell", "start", *keep), ["metric", "cell"])
    in_cell = Window.partitionBy("metric", "cell").orderBy("t", "count")
    return held.withColumn("before", F.col("start") + _before("n", in_cell))


def sample_runs(history: DataFrame, cell: int = HOUR) -> DataFrame:
    """Runs of equal samples: ``(metric, t, count, n, before, length)``.

    ``n`` samples follow ``before`` earlier ones of the ``length`` samples of their series, ordered
    by time, then count.
    """
    runs = _count_runs(history)
    return _ordered_runs(runs, sample_cells(runs, cell), cell, "length").select("metric", "t", "count", "n", "before", "length")


def retain_last_n(history: DataFrame, n: int = MAX_SAMPLES, cell: int = HOUR) -> DataFrame:
    """The newest ``n`` samples of every series.

    The tree of counts drops the cells that lie before the kept range as a whole and keeps those inside it
    as they are. One cell per series may lie across the border; its runs alone are put in order.
    """
    runs = _count_runs(history)
    cells = sample_cells(runs, cell).withColumn("_skip", F.col("length") - n - F.col("start"))
    whole = runs.withColumn("cell", floor_to(F.col("t"), cell)).join(cells.filter("_skip <= 0").select("metric", "cell"), ["metric", "cell"])
    border = _ordered_runs(runs, cells.filter("_skip > 0 and _skip < samples"), cell, "_skip")
    left = F.least(F.col("n"), F.col("before") + F.col("n") - F.col("start") - F.col("_skip"))
    kept = whole.select("metric", "t", "count", "n").unionByName(border.withColumn("n", left).filter("n > 0").select("metric", "t", "count", "n"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_copy")
    return kept.select("metric", F.timestamp_seconds("t").alias("time"), "count", copies).drop("_copy")


def fill_after_stop(
    history: DataFrame, now: int, step: int = SAMPLE_SECONDS, stamp: str = "slot", length_metric: str = "instance"
) -> DataFrame:
    """History with the zeros of the time since the last sample, for every series.

    One zero per ``step`` from the last sample until ``now``; none when there is no sample.
    ``stamp="slot"`` dates each zero at its own slot, ``"now"`` all of them at ``now``.
    """
    last = history.filter(F.col("metric") == length_metric).agg(
        F.max(epoch_seconds(F.col("time"))).alias("_last")
    )
    bounds = last.select((F.col("_last") + step).alias("_first"), F.lit(now + step - 1).cast("bigint").alias("_until"))
    time = F.col("slot") if stamp == "slot" else F.lit(now)
    zeros = _spine(bounds, "_first", "_until", step, "slot").select(
        F.explode(F.array(*map(F.lit, HISTORY_METRICS))).alias("metric"),
        F.timestamp_seconds(time).alias("time"),
        F.lit(0).cast("bigint").alias("count"),
    )
    return history.select("metric", "time", "count").unionByName(zeros)


def fill_gaps(history: DataFrame, step: int = SAMPLE_SECONDS) -> DataFrame:
    """Zeros for every missing slot between the first and the last sample of each series.

    Slots are counted from the first sample of the series; samples off the grid are kept as well.
    """
    at = epoch_seconds(F.col("time"))
    samples = history.select("metric", at.alias("slot"), "count")
    bounds = history.groupBy("metric").agg(F.min(at).alias("_first"), F.max(at).alias("_until"))
    slots = _spine(bounds, "_first", "_until", step, "slot", ("metric",))
    zeros = slots.join(samples, ["metric", "slot"], "left_anti").withColumn("count", F.lit(0).cast("bigint"))
    return samples.unionByName(zeros).select("metric", F.timestamp_seconds("slot").alias("time"), "count")


def _length(history: DataFrame, metric: str) -> Column:
    """Length of one series as a scalar subquery.

    It is summed over the runs of all series, so it shares the shuffle of the runs; a filter
    on the series would be pushed below that shuffle and read the history again.
    """
    of_metric = F.when(F.col("metric") == metric, F.col("n"))
    return _count_runs(history).agg(F.coalesce(F.sum(of_metric), F.lit(0)).alias("n")).scalar()


def kept_length(history: DataFrame, keep: int | None, length_metric: str = "instance") -> Column:
    """Samples of one series that are left when the newest ``keep`` are kept, as a scalar subquery."""
    length = _length(history, length_metric)
    return length if keep is None else F.least(length, F.lit(keep).cast("bigint"))


def slice_stride(
    history: DataFrame,
    start: int = 0,
    points: int = CHART_POINTS,
    length_metric: str = "instance",
    cell: int = HOUR,
    keep: int | None = None,
) -> DataFrame:
    """About ``points`` samples per series from index ``start``, as ``(metric, idx, time, count)``.

    The stride is taken from the length of one series and used for all. The tree of counts tells which
    cells hold a picked index; only their runs are put in order. With ``keep``, indexes count in the newest
    ``keep`` samples of each series, as if the others had been dropped before.
    """
    remaining = kept_length(history, keep, length_metric) - start
    stride = F.greatest(ceil_div(remaining, F.lit(points)), F.lit(1).cast("bigint"))

    def first_pick(before: str) -> Column:
        """First picked index that is not before this place."""
        skipped = F.greatest(ceil_div(F.col(before) - start, F.col("_stride")), F.lit(0).cast("bigint"))
        return start + skipped * F.col("_stride")

    runs = _count_runs(history)
    cells = sample_cells(runs, cell).withColumn("_stride", stride)
    if keep is not None:
        cells = cells.withColumn("start", F.col("start") - F.greatest(F.col("length") - keep, F.lit(0).cast("bigint")))
    touched = cells.filter(first_pick("start") < F.col("start") + F.col("samples"))
    ordered = _ordered_runs(runs, touched, cell, "_stride").withColumn("_first", first_pick("before"))
    last = F.col("before") + F.col("n") - 1
    return ordered.filter(F.col("_first") <= last).select(
        "metric",
        F.explode(F.sequence(F.col("_first"), last, F.col("_stride"))).alias("idx"),
        F.timestamp_seconds("t").alias("time"),
        "count",
    )


def next_zoom(total: Column, start: int) -> Column:
    """Start index that shows the newer half of what is shown from ``start``."""
    return ceil_div(total - start, F.lit(ZOOM_FACTOR)) + start


def previous_zoom(total: Column, start: int) -> Column:
    """Start index that shows twice as much, 0 when nothing is shown."""
    zero = F.lit(0).cast("bigint")
    return F.when(total == start, zero).otherwise(F.greatest(zero, start - (total - start)))


def zoom_points(
    history: DataFrame, start: int = 0, points: int = CHART_POINTS, length_metric: str = "instance"
) -> DataFrame:
    """One row: total samples, stride, and the start indexes of the next and previous zoom."""
    total = F.col("total")
    one_row = history.filter(F.col("metric") == length_metric).agg(F.count(F.lit(1)).alias("total"))
    return one_row.select(
        "total",
        F.greatest(ceil_div(total - start, F.lit(points)), F.lit(1).cast("bigint")).alias("stride"),
        next_zoom(total, start).alias("next_zoom_point"),
        previous_zoom(total, start).alias("previous_zoom_point"),
    )


def history_series(sliced: DataFrame, now: int, metrics: Sequence[str] = ("client", "instance")) -> DataFrame:
    """Plotted rows with their age label. The server series is kept out of the plot."""
    label = time_ago(epoch_seconds(F.col("time")), F.lit(now))
    rest = [c for c in sliced.columns if c not in ("metric", "idx", "time", "count")]
    return sliced.filter(F.col("metric").isin(*metrics)).select(
        "metric", "idx", "time", F.col("count").alias("value"), label.alias("label"), *rest
    )


def first_label(series: DataFrame, metric: str = "instance") -> DataFrame:
    """Label of the oldest plotted sample."""
    return series.filter(F.col("metric") == metric).agg(F.min_by("label", "idx").alias("label"))


def _latest(metric: str, place: str, over=None) -> Column:
    newest = F.max_by("count", F.when(F.col("metric") == metric, F.col(place)))
    return F.coalesce(newest if over is None else newest.over(over), F.lit(0).cast("bigint")).alias(f"{metric}_count")


def last_value(sliced: DataFrame) -> DataFrame:
    """Latest value of each series, 0 where it is empty, as one row.

    Over sliced samples this is the shown value, which may be older than the newest sample; pass the
    whole history for the newest.
    """
    place = "idx" if "idx" in sliced.columns else "time"
    return sliced.agg(*[_latest(metric, place) for metric in HISTORY_METRICS])


def beside_last_values(sliced: DataFrame) -> DataFrame:
    """Sliced samples with the latest value of each series on every row.

    One window over all of them: a slice has about as many samples as the chart has points, whatever the history.
    """
    everything = Window.partitionBy()
    return sliced.select("*", *[_latest(metric, "idx", everything) for metric in HISTORY_METRICS])
