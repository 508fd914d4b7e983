"""References to parent rows that are missing, deleted before, or arrive later.

References and parents are co-partitioned and sorted on the key and merged in one linear pass (a sort-merge
left join), against the parent's validity interval [cached_at, removed_at). Parents are one row per key
before the merge, so a hot key only makes its reference side large, which adaptive execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.operators.row_parse import strip_blanks


@dataclass(frozen=True)
class Reference:
    """child.ref points at parent.key; row_key names the child's row in the result."""

    child: str
    row_key: str
    ref: str
    parent: str
    key: str


def _moment(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(T.TimestampNTZType())


def parent_intervals(parents: DataFrame, key: str) -> DataFrame:
    """(_id, _from, _to): one validity interval per parent key, outer blanks removed.

    Repeated parents are joined: valid from the earliest cached_at, and until the latest removed_at unless
    one of them was never removed. A NULL cached_at counts as valid from the beginning.
    """
    own = parents.select(
        strip_blanks(F.col(key).cast("string")).alias("_id"), _moment(parents, "cached_at").alias("_from"), _moment(parents, "removed_at").alias("_to")
    ).where((F.col("_id").isNotNull()) & (F.col("_id") != ""))
    open_, early = F.max(F.col("_to").isNull()), F.max(F.col("_from").isNull())
    return own.groupBy("_id").agg(
        F.when(~early, F.min("_from")).alias("_from"), F.when(~open_, F.max("_to")).alias("_to"), F.lit(True).alias("_there")
    )


def orphans(children: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """table_name, row_key, reason, period: one row for each distinct child row whose reference is an orphan.

    missing: no such parent; late: the parent's cached_at is after the child's; deleted: its removed_at is
    not after the child's cached_at. NULL, empty and blank references are no references. A child without
    cached_at can only be missing; its period is NULL. Repeated child rows count once.
    """
    own = children.distinct().select(
        F.col(ref.row_key).cast("string").alias("row_key"), strip_blanks(F.col(ref.ref).cast("string")).alias("_id"), _moment(children, "cached_at").alias("_at")
    )
    own = own.where(F.col("_id").isNotNull() & (F.col("_id") != ""))
    joined = own.join(parent_intervals(parents, ref.key).hint("merge"), "_id", "left")
    reason = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_from") > F.col("_at"), "late").when(F.col("_to") <= F.col("_at"), "deleted")
    )
    return joined.select(F.lit(ref.child).alias("table_name"), "row_key", reason.alias("reason"), F.date_format("_at", "yyyy-MM").alias("period")).where(
        F.col("reason").isNotNull()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, reason and month."""
    return found.groupBy("table_name", "reason", "period").agg(F.count("*").alias("orphans"))
