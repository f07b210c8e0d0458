"""Ordered rows in balanced blocks, for folds that depend on order."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def ordered_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``block``, numbered so that the blocks of a key follow its order.

    Range partitioning samples the keys and cuts a hot key into as many blocks as its share of the
    rows asks for. Its bounds may differ between two runs of the same plan, so the result is cut
    from its lineage in the shared folder before it is used more than once.
    """
    placed = rows.repartitionByRange(*keys, *order).withColumn("block", F.spark_partition_id())
    return cut_lineage(placed)
