"""Shared helpers: tables in the shared folder, single evaluation of an expression, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
_open: ContextVar[list[str] | None] = ContextVar("tables of the scratch() around", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to a table in the shared folder and read again: its lineage ends there. Also the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _open.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of stored() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Tables that stored() writes inside are deleted at the end, but those whose paths are put into the set given; a scratch() around takes these over."""
    kept: set[str] = set()
    outer, own = _open.get(), []
    token = _open.set(own)
    try:
        yield kept
        for path in set(own) - kept:
            remove(spark, path)
        if outer is not None:
            outer.extend(kept.intersection(own))
    finally:
        _open.reset(token)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys for a grouped function: few bytes may be much work, so partitions are not merged by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a whole text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), longs; root is the component's smallest node.

    Alternating large-star and small-star rounds: each node's links move to its smallest neighbour until every component
    is a star. A round is joins and counts on the edges alone; a busy node is split by the skew join, and minima are
    combined before the shuffle. Each round ends in a stored table. Null ends and loops are no edges.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, path = stored(links)
    state = None
    while True:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        remove(spark, path)
        links, path = after, new
        if seen == state:
            break
        state = seen
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
