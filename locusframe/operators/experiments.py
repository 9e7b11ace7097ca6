"""Tables that sum up an experiment: which arms are complete, their metrics by seed and by batch, and their means and ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import class_metrics, macro_auroc, predicted, seed_ensemble

NAMES = ("accuracy", "balanced_accuracy", "macro_f1", "macro_auroc")


def arm_cells(runs: DataFrame, seeds: Sequence[int], folds: Sequence[int]) -> DataFrame:
    """(arm, complete, missing) of runs (arm, seed, fold): the cells of the grid that an arm lacks as seed:fold, joined by commas.

    The grid is as long as its lists multiply to; an arm has a row for each of its cells at most.
    """
    grid = F.array(*(F.struct(F.lit(int(s)).cast("long").alias("seed"), F.lit(int(f)).cast("long").alias("fold")) for s in sorted(seeds) for f in sorted(folds)))
    done = runs.groupBy("arm").agg(F.collect_set(F.struct(F.col("seed").cast("long").alias("seed"), F.col("fold").cast("long").alias("fold"))).alias("done"))
    lacking = F.filter(grid, lambda c: ~F.array_contains(F.col("done"), c))
    missing = F.array_join(F.transform(lacking, lambda c: F.concat_ws(":", c["seed"].cast("string"), c["fold"].cast("string"))), ",")
    return done.select("arm", (F.size(lacking) == 0).alias("complete"), missing.alias("missing"))


def wide_metrics(pred: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """(by, n, present, accuracy, balanced_accuracy, macro_f1) of predictions (by, sample_id, y, cls, prob); present counts the classes with a sample."""
    per = class_metrics(predicted(pred, by), classes, by)
    return per.groupBy(*by).agg(
        F.max("total").alias("n"), F.count_if(F.col("support") > 0).alias("present"), (F.sum("hits") / F.max("total")).alias("accuracy"), F.avg("sensitivity").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1")
    )


def metric_rows(pred: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """(by, n, metric, value) of the primary metrics."""
    both = wide_metrics(pred, classes, by).join(macro_auroc(pred, by), by)
    return both.select(*by, "n", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in NAMES))))


def batch_metrics(pred: DataFrame, classes: int) -> DataFrame:
    """(arm, seed, batch, n, present, accuracy, balanced_accuracy): recall is averaged over the classes that a batch has."""
    return wide_metrics(pred, classes, ["arm", "seed", "batch"]).drop("macro_f1")


def arm_table(runs: DataFrame, classes: int, seeds: Sequence[int], folds: Sequence[int]) -> DataFrame:
    """(arm, complete, metric, seeds, mean, sd, seed_ensemble) of runs (arm, seed, fold, sample_id, y, cls, prob).

    mean and sd are over the arm's seeds, sd null with one seed. The ensemble averages the probabilities of all seeds; an arm
    that lacks a cell of the grid is listed as incomplete and has none.
    """
    state = arm_cells(runs, seeds, folds).select("arm", "complete")
    each = metric_rows(runs, classes, ["arm", "seed"]).groupBy("arm", "metric").agg(F.count("*").alias("seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    whole = runs.join(F.broadcast(state.where("complete").select("arm")), "arm", "left_semi")  # a row for each arm
    ensemble = metric_rows(seed_ensemble(whole), classes, ["arm"]).select("arm", "metric", F.col("value").alias("seed_ensemble"))
    return each.join(F.broadcast(state), "arm").join(ensemble, ["arm", "metric"], "left").select("arm", "complete", "metric", "seeds", "mean", "sd", "seed_ensemble")
