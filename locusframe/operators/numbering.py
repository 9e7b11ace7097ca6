"""Consecutive numbers in an order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _range_key(rows: DataFrame, column: str) -> Column:
    """A number that never falls where column rises: the value, or for text its first seven bytes."""
    if dict(rows.dtypes)[column] in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(column).cast("double")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """rows with `name`: 1, 2, 3 ... within by, in the order of the columns `order`, which tell the rows of a group apart.

    Rows are cut into ranges at approximate quantiles of the first column of order; each is numbered on its own and shifted by
    the sizes of those before it. Rows with a null there come first.
    """
    key = _range_key(rows, order[0])
    cuts = rows.agg(F.percentile_approx(key, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 1000).alias("__cuts"))  # one row
    placed = rows.join(F.broadcast(cuts), F.lit(True)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < key)), F.lit(0))).drop("__cuts")
    groups = [F.col(c).alias(f"__{c}") for c in by]
    sizes = placed.groupBy(*groups, F.col("__range").alias("__at")).agg(F.count("*").alias("__n"))  # a row for each group and range
    before = F.sum("__n").over(W.partitionBy(*(f"__{c}" for c in by)).orderBy("__at")) - F.col("__n")
    shift = sizes.withColumn("__before", before).drop("__n")
    same = F.col("__range") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order))
    return placed.withColumn(name, own).join(shift, same).withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)
