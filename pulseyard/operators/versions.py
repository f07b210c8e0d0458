"""Version table and its updates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION_FIELDS = ("current_version_stable", "current_version_prerelease")

# Version of the table that updates go to, and the one read by default.
UPDATED_API_VERSION = 1
DEFAULT_API_VERSION = 0


def versions_for(config: DataFrame, api_version: int = DEFAULT_API_VERSION) -> DataFrame:
    return config.filter(F.col("api_version") == api_version).select(*VERSION_FIELDS)


def apply_version_updates(config: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Config after all authorised updates, in order; absent fields keep their value.

    The last value per field is an aggregate, so any number of updates leaves one row, which is read
    as a scalar subquery.
    """

    def last_given(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.col(order))).alias(field)

    last = updates.filter("authorised").agg(F.struct(*map(last_given, VERSION_FIELDS)).alias("last")).scalar()
    updated = F.col("api_version") == UPDATED_API_VERSION
    return config.select(
        "api_version",
        *[F.coalesce(F.when(updated, last[field]), F.col(field)).alias(field) for field in VERSION_FIELDS],
    )
