"""Quality-control tables, draws with replacement and consistency checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import draw
from ..functions.stats import fisher_p
from .numbering import numbered


def fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, n, print, total): an order-free fingerprint of each group's rows.

    print is the XOR of one half of each row's 64-bit hash and total the sum of the other, so repeated rows do not cancel.
    """
    text = F.md5(F.concat_ws("|", F.lit(""), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)))
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(half(1)).alias("print"), F.sum(half(9)).alias("total"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b): how many keys the two tables do not share."""
    left, right = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return left.join(right, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def open_cells(done: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Cells of a small grid of runs that `done` lacks. The grid is as long as its axes' lists multiply to."""
    grid = done.sparkSession.range(1).select(*(F.array(*map(F.lit, v)).alias(k) for k, v in axes.items()))
    for k in axes:
        grid = grid.withColumn(k, F.explode(k))
    return grid.join(done.select(*axes), list(axes), "left_anti")


def regression(stored: DataFrame, again: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, equal, different) of recomputed rows against stored ones; nulls equal nulls."""
    both = stored.select(key, *(F.col(c).alias(f"{c}_old") for c in columns)).join(again.select(key, *columns), key)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).eqNullSafe(F.col(f"{c}_old")).alias("ok")) for c in columns))
    return both.select(F.inline(pairs)).groupBy("column").agg(F.count_if("ok").alias("equal"), F.count_if(~F.col("ok")).alias("different"))


def extrapolated_bytes(per_sample: DataFrame) -> DataFrame:
    """(batch, n, ratio, expected): median bytes per pair of a batch's measured samples, or of all, times its pairs. per_sample: batch, pairs, bytes (null: not measured)."""
    ratio = F.col("bytes") / F.col("pairs")
    overall = per_sample.agg(F.median(ratio).alias("overall"))
    own = per_sample.groupBy("batch").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"), F.median(ratio).alias("own"))
    used = F.coalesce("own", "overall")
    return own.join(F.broadcast(overall), F.lit(True)).select("batch", "n", used.alias("ratio"), (F.col("pairs") * used).alias("expected"))


def sample_thresholds(calls: DataFrame, most: int = 5) -> DataFrame:
    """For each sample and threshold from 1 to most: fragments with so many calls, their calls, shares of the sample's, mean size, states and stored bytes."""
    each = calls.groupBy("sample_id", "fragment_id").agg(F.count("*").alias("n"), F.sum("state").alias("up"))
    counted = each.groupBy("sample_id", "n", "up").agg(F.count("*").alias("f"))
    by = counted.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most)).cast("int"))).alias("threshold"))
    total = by.groupBy("sample_id", "threshold").agg(
        F.sum("f").alias("fragments"),
        F.sum(F.col("f") * F.col("n")).alias("calls"),
        F.sum(F.col("f") * F.col("up")).alias("up"),
        F.sum(F.when(F.col("up") == F.col("n"), F.col("f")).otherwise(0)).alias("full_up"),
        F.sum(F.when(F.col("up") == 0, F.col("f")).otherwise(0)).alias("full_down"),
    )
    own = W.partitionBy("sample_id")  # a row for each threshold
    return total.select(
        "sample_id", "threshold", "fragments", "calls",
        (F.col("fragments") / F.max("fragments").over(own)).alias("fragment_share"), (F.col("calls") / F.max("calls").over(own)).alias("call_share"),
        (F.col("calls") / F.col("fragments")).alias("mean_cpgs"), (100 * F.col("up") / F.col("calls")).alias("pct_up"),
        (F.col("full_up") / F.col("fragments")).alias("fully_up"), (F.col("full_down") / F.col("fragments")).alias("fully_down"), (5 * F.col("calls") + 8 * (F.col("fragments") + 1)).alias("bytes"),
    )


def storage_forecast(pilot: DataFrame, samples: DataFrame) -> DataFrame:
    """(threshold, n_pilot, n_target, ratio_median, total_median, total_min, total_max, total_batch_median): bytes of all samples (batch, pairs).

    pilot: measured samples by threshold (threshold, batch, pairs, bytes). Its bytes a pair, at their median, least and most,
    are carried to all pairs; for the last column each batch takes its own median, or that of all if the pilot has none of it.
    """
    ratio = F.col("bytes") / F.col("pairs")
    every = pilot.groupBy("threshold").agg(F.count("*").alias("n_pilot"), F.median(ratio).alias("ratio_median"), F.min(ratio).alias("low"), F.max(ratio).alias("high"))
    own = pilot.groupBy("threshold", "batch").agg(F.median(ratio).alias("own"))
    sizes = samples.groupBy("batch").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"))  # a row for each batch
    each = every.join(F.broadcast(sizes), F.lit(True)).join(own, ["threshold", "batch"], "left")
    whole = each.groupBy("threshold", "n_pilot", "ratio_median", "low", "high").agg(F.sum("n").alias("n_target"), F.sum("pairs").alias("pairs"), F.sum(F.col("pairs") * F.coalesce("own", "ratio_median")).alias("total_batch_median"))
    total = lambda c: F.col("pairs") * F.col(c)
    return whole.select("threshold", "n_pilot", "n_target", "ratio_median", total("ratio_median").alias("total_median"), total("low").alias("total_min"), total("high").alias("total_max"), "total_batch_median")


SHARES = ("fragment_share", "call_share", "mean_cpgs", "pct_up", "fully_up", "fully_down")


def threshold_summary(pilot: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_thresholds of the pilot summed up by threshold, with storage_forecast's columns."""
    rolled = pilot.groupBy("threshold").agg(
        F.avg("fragment_share").alias("fragment_share_mean"), F.min("fragment_share").alias("fragment_share_min"), F.max("fragment_share").alias("fragment_share_max"), F.avg("call_share").alias("call_share_mean"),
        F.sum("fragments").alias("fragments"), F.sum("calls").alias("calls"), *(F.avg(c).alias(c) for c in SHARES[2:]), F.sum("bytes").alias("pilot_bytes"),
    )
    return rolled.join(storage_forecast(pilot, samples), "threshold")


def threshold_groups(pilot: DataFrame) -> DataFrame:
    """Means of sample_thresholds by threshold, batch and diagnosis."""
    return pilot.groupBy("threshold", "batch", "diagnosis").agg(F.count("*").alias("samples"), *(F.avg(c).alias(c) for c in SHARES))


def end_distances(calls: DataFrame, most: int) -> DataFrame:
    """(end, read, dist, n, up): calls by distance from each end of their fragment, under `most`."""
    own = W.partitionBy("sample_id", "fragment_id")
    df = calls.withColumn("first", F.min("locus_key").over(own)).withColumn("last", F.max("locus_key").over(own))
    ends = F.array(F.struct(F.lit(5).alias("end"), (F.col("locus_key") - F.col("first")).alias("dist")), F.struct(F.lit(3).alias("end"), (F.col("last") - F.col("locus_key")).alias("dist")))
    return df.select("mate", "state", F.inline(ends)).where(F.col("dist") < most).groupBy("end", F.col("mate").alias("read"), "dist").agg(F.count("*").alias("n"), F.sum("state").alias("up"))


def end_excess(profile: DataFrame, near: int, low: int, high: int) -> DataFrame:
    """(end, read, excess): percentage near an end minus percentage at distances low to high."""
    close, far = F.col("dist") < near, F.col("dist").between(low, high)
    pct = lambda c: 100 * F.try_divide(F.sum(F.when(c, F.col("up"))), F.sum(F.when(c, F.col("n"))))
    return profile.groupBy("end", "read").agg((pct(close) - pct(far)).alias("excess"))


def clip_grid(calls: DataFrame, clips: list[tuple[int, int]]) -> DataFrame:
    """(clip_1, clip_2, calls, up, conflicts) after dropping the first positions of either read; calls have mate and read_pos. One scan for all pairs of a short list."""
    grid = F.array(*(F.struct(F.lit(a).alias("clip_1"), F.lit(b).alias("clip_2")) for a, b in clips))
    each = calls.select("*", F.inline(grid)).where(F.col("read_pos") >= F.when(F.col("mate") == 1, F.col("clip_1")).otherwise(F.col("clip_2")))
    merged = each.groupBy("clip_1", "clip_2", "sample_id", "fragment_id", "locus_key").agg(F.min("state").alias("lo"), F.max("state").alias("hi"))
    same = F.col("lo") == F.col("hi")
    return merged.groupBy("clip_1", "clip_2").agg(F.count_if(same).alias("calls"), F.sum(F.when(same, F.col("lo")).otherwise(0)).alias("up"), F.count_if(~same).alias("conflicts"))


def fisher_by_class(df: DataFrame, label: str, flag: str) -> DataFrame:
    """(label, a, b, c, d, odds, p) of each class against the rest by a 0/1 column."""
    own = df.groupBy(label).agg(F.sum(flag).alias("a"), F.sum(1 - F.col(flag)).alias("b"))
    every = W.partitionBy()
    t = own.withColumn("c", F.sum("a").over(every) - F.col("a")).withColumn("d", F.sum("b").over(every) - F.col("b"))
    return t.withColumn("odds", F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))).withColumn("p", fisher_p("a", "b", "c", "d"))


def arm_spread(runs: DataFrame) -> DataFrame:
    """(arm, seeds, mean, sd) of per-seed values; one seed has no sd."""
    each = runs.groupBy("arm", "seed").agg(F.avg("value").alias("v"))
    return each.groupBy("arm").agg(F.count("*").alias("seeds"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def random_bag(items: DataFrame, group: str, item: str, k: int, seed: int) -> DataFrame:
    """(group, slot, item): k items of each group by seeded hash; smaller groups are drawn from with replacement. Rows without group take no part.

    Spark cuts a group to its first k rows before it shuffles them (for k up to spark.sql.optimizer.windowGroupLimitThreshold), so
    that a large group is no large task.
    """
    order = W.partitionBy(group).orderBy(draw(seed, F.col(group), F.col(item)), item)
    sizes = items.groupBy(group).agg(F.count("*").alias("n"))
    leading = items.select(group, item).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    placed = leading.join(sizes, group).withColumn("at", F.col("at") - 1)
    first = placed.where(F.col("n") >= k).select(group, F.col("at").alias("slot"), item)
    small = placed.where(F.col("n") < k)
    slots = small.where("at = 0").select(group, "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    drawn = slots.withColumn("at", F.pmod(draw(f"{seed}-slot", F.col(group), F.col("slot")), F.col("n")).cast("int"))
    return first.union(drawn.join(small.select(group, "at", item), [group, "at"]).select(group, "slot", item))


def balanced_schedule(samples: DataFrame, draws: int, seed: int) -> DataFrame:
    """(slot, label, sample_id): draws with replacement, each class as likely as any other."""
    placed = numbered(samples.select("label", "sample_id"), ["label"], ["sample_id"], "at").withColumn("at", F.col("at") - 1)
    classes = samples.groupBy("label").agg(F.count("*").alias("n")).withColumn("cls", F.row_number().over(W.orderBy("label")) - 1)  # a row for each class
    k = classes.count()
    slots = samples.sparkSession.range(draws).select(F.col("id").alias("slot"), F.pmod(draw(f"{seed}-class", F.col("id")), F.lit(k)).cast("int").alias("cls"))
    picked = slots.join(F.broadcast(classes), "cls").withColumn("at", F.pmod(draw(f"{seed}-sample", F.col("slot")), F.col("n")).cast("int"))
    return picked.join(placed, ["label", "at"]).select("slot", "label", "sample_id")


def completeness(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(missing, unexpected, repeated): test ids without a prediction, predictions of others, and ids predicted more than once."""
    own = predicted.groupBy("sample_id").agg(F.count("*").alias("k"))
    both = own.join(expected.select("sample_id").distinct().withColumn("due", F.lit(True)), "sample_id", "full_outer")
    return both.agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("due").isNull()).alias("unexpected"), F.count_if(F.col("k") > 1).alias("repeated"))


def finite_metrics(values: DataFrame, run: list[str]) -> DataFrame:
    """(run, not_finite, which, complete) of metrics (run, metric, value): a run is complete if all of them are finite numbers."""
    wrong = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    each = values.groupBy(*run).agg(F.count_if(wrong).alias("not_finite"), F.array_join(F.sort_array(F.collect_list(F.when(wrong, F.col("metric")))), ",").alias("which"))
    return each.withColumn("complete", F.col("not_finite") == 0)


def simplest_within(scores: DataFrame, tie: float) -> DataFrame:
    """(candidate, mean): the first candidate by `place` whose mean value is within tie of the best."""
    means = scores.groupBy("candidate", "place").agg(F.avg("value").alias("mean"))
    near = means.withColumn("best", F.max("mean").over(W.partitionBy())).where(F.col("mean") >= F.col("best") - tie)
    return near.agg(F.min_by("candidate", "place").alias("candidate"), F.min_by("mean", "place").alias("mean"))


def recheck(recomputed: DataFrame, stored: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, recomputed, stored) of values that are not within tolerance of what is stored."""
    both = recomputed.select(key, F.col("value").alias("recomputed")).join(stored.select(key, F.col("value").alias("stored")), key)
    return both.where(F.abs(F.col("recomputed") - F.col("stored")) > tolerance)


def noncpg_excess(profile: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(context, read, excess): mean percentage of the first k positions minus the median over positions low to high."""
    level = profile.where(F.col("pos").between(low, high)).groupBy("context", "read").agg(F.median("pct").alias("level"))
    order = W.partitionBy("context", "read").orderBy("pos")
    head = profile.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).groupBy("context", "read").agg(F.avg("pct").alias("head"))
    return head.join(level, ["context", "read"]).select("context", "read", (F.col("head") - F.col("level")).alias("excess"))


def profile_check(own: DataFrame, report: DataFrame, min_coverage: int) -> DataFrame:
    """(read, positions, largest_gap, coverage_ratio) of two M-bias profiles (read, pos, n, pct) where both have min_coverage calls."""
    other = report.select("read", "pos", F.col("n").alias("n2"), F.col("pct").alias("pct2"))
    both = own.join(other, ["read", "pos"]).where((F.col("n") >= min_coverage) & (F.col("n2") >= min_coverage))
    return both.groupBy("read").agg(F.count("*").alias("positions"), F.max(F.abs(F.col("pct") - F.col("pct2"))).alias("largest_gap"), (F.sum("n") / F.sum("n2")).alias("coverage_ratio"))


def tail_deviation(profile: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """(read, signed_dev): mean signed distance of the last k positions from the plateau."""
    order = W.partitionBy("read").orderBy(F.desc("pos"))
    tail = profile.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).join(level, "read")
    return tail.groupBy("read").agg(F.avg(F.col("pct") - F.col("plateau")).alias("signed_dev"))


def threshold_rollup(per_sample: DataFrame) -> DataFrame:
    """(threshold, batch, diagnosis, samples, mean, low, high) of a share by sample (threshold, batch, diagnosis, share)."""
    return per_sample.groupBy("threshold", "batch", "diagnosis").agg(F.count("*").alias("samples"), F.avg("share").alias("mean"), F.min("share").alias("low"), F.max("share").alias("high"))


def run_rollup(placed: DataFrame, reads: DataFrame) -> DataFrame:
    """(split, label, patients, fragments, valid) of a fold: placed has sample_id, patient_id, split, label; reads are per-sample counts."""
    return placed.join(reads, "sample_id", "left").groupBy("split", "label").agg(F.countDistinct("patient_id").alias("patients"), F.sum("n_fragments").alias("fragments"), F.sum("n_valid").alias("valid"))


def run_totals(placed: DataFrame, reads: DataFrame, obs: DataFrame) -> DataFrame:
    """One row (patients, fragments, valid, loci) of a run: run_rollup over all splits, and the loci that its observations cover."""
    whole = placed.join(reads, "sample_id", "left").agg(F.countDistinct("patient_id").alias("patients"), F.sum("n_fragments").alias("fragments"), F.sum("n_valid").alias("valid"))
    return whole.join(obs.select("locus_key").distinct().agg(F.count("*").alias("loci")), F.lit(True))


def loading_mass(loadings: DataFrame) -> DataFrame:
    """(pc, group, mass): share of a component's squared loadings (pc, group, w) that falls on each group of features."""
    each = loadings.groupBy("pc", "group").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    return each.select("pc", "group", (F.col("s") / F.sum("s").over(W.partitionBy("pc"))).alias("mass"))
