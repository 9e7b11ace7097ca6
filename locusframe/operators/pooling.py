"""Softmax pooling of rows within groups, in one step and from mergeable parts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _shifted(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with their group's largest score m and e = exp(score - m). Maxima are joined, so a busy group is no single task."""
    top = rows.groupBy(*by).agg(F.max("score").alias("m"))
    return rows.join(top, by).withColumn("e", F.exp(F.col("score") - F.col("m")))


def _summary(*metrics: str, weight: str | None = None) -> Column:
    """Spark ML's summary of vec, combined before the shuffle: vectors are neither taken apart nor sent."""
    x = array_to_vector(F.col("vec").cast("array<double>"))
    kind = Summarizer.metrics(*metrics)
    return kind.summary(x, F.col(weight)) if weight else kind.summary(x)


def softmax_pool(rows: DataFrame, group: str) -> DataFrame:
    """(group, dim, pooled): sum of softmax(score) times each component of vec within a group. Rows without group or vec are left out."""
    each = _shifted(rows.where("vec is not null"), [group]).groupBy(group).agg(_summary("mean", weight="e").alias("s"))
    return each.select(group, F.posexplode(vector_to_array("s.mean")).alias("dim", "pooled"))


def pool_weights(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `weight`: the softmax of score within by, so that a group's weights add up to one. With a head in by, each head has its own."""
    shifted = _shifted(rows, by).drop("m")
    whole = shifted.groupBy(*by).agg(F.sum("e").alias("__whole"))
    return shifted.join(whole, by).withColumn("weight", F.col("e") / F.col("__whole")).select(*rows.columns, "weight")


def pool_parts(rows: DataFrame, group: str, part: str) -> DataFrame:
    """(group, part, dim, m, s, v): each part's largest score, sum of exp(score - m), and the same sum times the component."""
    each = _shifted(rows.where("vec is not null"), [group, part]).groupBy(group, part, "m").agg(F.sum("e").alias("s"), _summary("mean", weight="e").alias("mean"))
    apart = each.select(group, part, "m", "s", F.posexplode(vector_to_array("mean.mean")).alias("dim", "x"))
    return apart.select(group, part, "dim", "m", "s", (F.col("x") * F.col("s")).alias("v"))


def merge_parts(parts: DataFrame, group: str) -> DataFrame:
    """Pooled values from parts of any division; equal to softmax_pool."""
    top = F.max("m").over(W.partitionBy(group, "dim"))
    scaled = parts.withColumn("f", F.exp(F.col("m") - top))
    return scaled.groupBy(group, "dim").agg((F.sum(F.col("v") * F.col("f")) / F.sum(F.col("s") * F.col("f"))).alias("pooled"))


def mean_max_pool(rows: DataFrame, group: str) -> DataFrame:
    """(group, dim, mean, max) of each component within a group; rows without vec are left out."""
    each = rows.where("vec is not null").groupBy(group).agg(_summary("mean", "max").alias("s"))
    both = F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.max").alias("max"))
    return each.select(group, F.posexplode(both).alias("dim", "z")).select(group, "dim", "z.mean", "z.max")


def head_scores(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows (id, grp, vec) with `scores`: what score makes of a block of vectors, one column a head. A vector is sent once, whatever the heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            x = np.asarray(vec.flatten(), float).reshape(len(vec), -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(score(x)), pa.list_(pa.float64()))], names=["id", "grp", "vec", "scores"])

    return rows.where("vec is not null").select("id", "grp", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "id long, grp long, vec array<double>, scores array<double>")


def gated_scores(rows: DataFrame, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> DataFrame:
    """head_scores of gated attention: w times tanh(v x) * sigmoid(u x), a head for each row of w."""
    return head_scores(rows, lambda x: (np.tanh(x @ v.T) / (1 + np.exp(-(x @ u.T)))) @ w.T)


def query_scores(rows: DataFrame, k: np.ndarray, q: np.ndarray) -> DataFrame:
    """head_scores of learned queries: scaled products of k x with each row of q."""
    return head_scores(rows, lambda x: x @ k.T @ q.T / math.sqrt(q.shape[1]))


def pool_heads(rows: DataFrame, heads: int) -> DataFrame:
    """(grp, head, dim, pooled) of rows (grp, scores, vec): softmax_pool for each of `heads` scores; each head weighs the vectors anew in one aggregate."""
    top = rows.groupBy("grp").agg(F.array(*(F.max(F.get("scores", F.lit(h))) for h in range(heads))).alias("m"))
    weighed = rows.join(top, "grp").select("grp", "vec", *(F.exp(F.get("scores", F.lit(h)) - F.get("m", F.lit(h))).alias(f"e{h}") for h in range(heads)))
    each = weighed.groupBy("grp").agg(F.array(*(vector_to_array(_summary("mean", weight=f"e{h}")["mean"]) for h in range(heads))).alias("heads"))
    return each.select("grp", F.posexplode("heads").alias("head", "mean")).select("grp", "head", F.posexplode("mean").alias("dim", "pooled"))
