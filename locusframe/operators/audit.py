"""Audit tables: contingency, chi-square, grouped medians and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_p


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.groupBy(row, col).agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """(n, dof, chi2, min_expected, share_expected_5, cramers_v) of independence; Yates' correction at one degree of freedom, not in V.

    With one row or one column there are no degrees of freedom: chi2 is 0 and V null. Any names of columns may be given.
    """
    cells = df.groupBy(F.col(row).alias("__row"), F.col(col).alias("__col")).agg(F.count("*").alias("__o"))
    rows, cols = cells.groupBy("__row").agg(F.sum("__o").alias("__rn")), cells.groupBy("__col").agg(F.sum("__o").alias("__cn"))
    # Every combination, also unseen ones: the list of column totals is as long as there are columns.
    listed = cols.agg(F.collect_list(F.struct("__col", "__cn")).alias("__cols"), F.count("*").alias("__c"), F.sum("__cn").alias("n"))
    grid = rows.join(F.broadcast(listed), F.lit(True)).withColumn("__r", F.count("*").over(W.partitionBy())).select("__row", "__rn", "__r", "__c", "n", F.inline("__cols"))  # a row for each row of the table
    same = grid["__row"].eqNullSafe(cells["__row"]) & grid["__col"].eqNullSafe(cells["__col"])
    seen = grid.join(cells, same, "left").select("n", "__r", "__c", F.coalesce("__o", F.lit(0)).alias("__o"), (F.col("__rn") * F.col("__cn") / F.col("n")).alias("__e"))
    dof = (F.col("__r") - 1) * (F.col("__c") - 1)
    gap = F.abs(F.col("__o") - F.col("__e"))
    yates = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = seen.withColumn("dof", dof).groupBy("n", "dof", "__r", "__c").agg(
        F.sum(F.pow(yates, 2.0) / F.col("__e")).alias("chi2"), F.sum(F.pow(gap, 2.0) / F.col("__e")).alias("__plain"), F.min("__e").alias("min_expected"), F.avg((F.col("__e") >= 5).cast("double")).alias("share_expected_5")
    )
    v = F.sqrt(F.try_divide(F.col("__plain") / F.col("n"), F.least(F.col("__r") - 1, F.col("__c") - 1)))
    return out.select("n", "dof", "chi2", "min_expected", "share_expected_5", v.alias("cramers_v"))


def chi_square_p(df: DataFrame, row: str, col: str) -> DataFrame:
    return chi_square(df, row, col).withColumn("p", chi2_p("chi2", "dof"))


def grouped_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def group_summaries(df: DataFrame, value: str) -> DataFrame:
    """(batch, diagnosis, n, mean): over everything, by batch and by diagnosis; `all` where a column is summed over."""
    sets = df.groupingSets([[], ["batch"], ["diagnosis"]], "batch", "diagnosis")
    return sets.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.coalesce("batch", F.lit("all")).alias("batch"), F.coalesce("diagnosis", F.lit("all")).alias("diagnosis"), "n", "mean")


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(user_id, session, n, total): runs of a user's events no further apart than the gap."""
    order = W.partitionBy("user_id").orderBy("ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    starts = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.withColumn("s", starts).withColumn("session", F.sum("s").over(order.rangeBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
