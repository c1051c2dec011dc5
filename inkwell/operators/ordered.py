"""Running sums over an order of any length, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import settle


def running(rows: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with inclusive running sums in a stated order, for each value of ``within`` by itself.

    Rows are range-partitioned by the order and settled, so that each knows its slice; a slice's sums are added
    up, the sums of the slices before it (as many as partitions, at most) are its offset, and a window inside the
    slice does the rest. The order should have no key that many rows share.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settle(rows.repartitionByRange(parts, *within, *order).withColumn("_slice", F.spark_partition_id()))
    totals = cut.groupBy(*within, "_slice").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(w).alias(f"_in_{w}") for w in within], F.col("_slice").alias("_at"), *[F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums])
    same = F.col("_slice") == F.col("_at")
    for w in within:
        same = same & F.col(w).eqNullSafe(F.col(f"_in_{w}"))
    inside = Window.partitionBy("_slice", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.join(before, same).select(*rows.columns, *[(F.col(f"_before_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])
    return placed


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place in the order, from 1."""
    return running(rows, order, {name: F.lit(1).cast("long")}, within)
