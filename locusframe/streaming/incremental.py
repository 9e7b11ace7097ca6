"""Structured Streaming forms whose state is sums: running region values, mergeable pooling, and event sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_regions(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample_id, region_id, weighted, coverage) of a stream of counts (sample_id, locus_key, c_count, ct_count); write in update or complete mode."""
    seen = counts.where("ct_count > 0").join(regions, "locus_key")
    return seen.groupBy("sample_id", "region_id").agg(F.sum("c_count").alias("weighted"), F.sum("ct_count").alias("coverage"))


def running_pool(rows: DataFrame, group: str, shift: float) -> DataFrame:
    """(group, dim, s, v) of a stream of (group, score, vec): sums of exp(score - shift) and of the same times each component.

    shift is a bound of the scores known beforehand, which keeps the sums mergeable; v / s is the pooled value.
    """
    each = rows.select(group, F.exp(F.col("score") - shift).alias("e"), F.posexplode("vec").alias("dim", "x"))
    return each.groupBy(group, "dim").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("x")).alias("v"))


def running_summary(counts: DataFrame) -> DataFrame:
    """(sample_id, n_observed, mean_beta, var_beta, mean_coverage) of a stream of counts; medians are no sums and are left to the batch form."""
    seen = counts.where("ct_count > 0").select("sample_id", (F.col("c_count") / F.col("ct_count")).alias("beta"), F.least("ct_count", F.lit(65535)).alias("coverage"))
    return seen.groupBy("sample_id").agg(F.count("*").alias("n_observed"), F.avg("beta").alias("mean_beta"), F.var_pop("beta").alias("var_beta"), F.avg("coverage").alias("mean_coverage"))


def running_softmax(rows: DataFrame, group: str) -> DataFrame:
    """(group, m, s, v) of a stream of (group, score, vec): largest score, sum of exp(score - m), and the same sum times each component; write in update mode.

    Batches of a group are merged into a state of that size, whatever their scores; v / s is the pooled value.
    """
    kind = dict(rows.dtypes)[group]

    def merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, s, v = state.get if state.exists else (-np.inf, 0.0, None)
        v = None if v is None else np.array(v)
        for part in parts:
            score = part.score.to_numpy(float)
            top = max(m, score.max())
            e = np.exp(score - top)
            own = e @ np.stack(part.vec.to_numpy()).astype(float)
            v = own if v is None else v * np.exp(m - top) + own
            m, s = top, s * np.exp(m - top) + e.sum()
        state.update((float(m), float(s), v.tolist()))
        yield pd.DataFrame({group: [key[0]], "m": [m], "s": [s], "v": [v.tolist()]})

    out = f"`{group}` {kind}, m double, s double, v array<double>"
    return rows.select(group, F.col("score").cast("double").alias("score"), "vec").groupBy(group).applyInPandasWithState(merge, out, "m double, s double, v array<double>", "update", GroupStateTimeout.NoTimeout)


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, total): sessions of a stream of events, closed once the watermark passes."""
    windowed = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windowed.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
