"""Column helpers shared by the operators: undefined values, rounding for reports, one-pass scalars, scalable ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattix.session import cut


def finite(c: Column) -> Column:
    """NULL for NaN and infinities: every operator's results are numbers or undefined."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def scalars(df: DataFrame, **aggs: Column) -> dict:
    """Whole-table aggregates as driver-side numbers: one row, so no window over the whole table is needed."""
    return df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()


def literal(x: float | None) -> Column:
    return F.lit(x).cast("double")


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's place (from 1) in a total order of the whole table.

    Rows are range-partitioned and numbered within partitions; only one count a
    partition reaches the driver, so no task sorts the whole table.  The
    order must be total for a repeatable result.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy("__p").count().collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    start = F.create_map(*[F.lit(x) for p, n in offsets.items() for x in (p, n)])[F.col("__p")] if offsets else F.lit(0)
    w = Window.partitionBy("__p").orderBy(*order)
    return ranged.withColumn(name, (F.row_number().over(w) + start).cast("long")).drop("__p")
