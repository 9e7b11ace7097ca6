"""Classification metrics over long predictions (sample_id, y, cls, prob), grouped by any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_p, normal_p, t_p


def softmax(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores with prob: softmax of `score` within by, shifted by the largest."""
    own = W.partitionBy(*by)
    df = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(own)))
    return df.withColumn("prob", F.col("e") / F.sum("e").over(own)).drop("e")


def predicted(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, sample_id, y, label, conf, second): the most likely class, its probability and the runner-up; ties take the lowest class."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("neg"), "cls")))
    top = pred.groupBy(*by, "sample_id", "y").agg(order.alias("o"))  # as many entries as classes
    return top.select(*by, "sample_id", "y", F.get("o", F.lit(0))["cls"].alias("label"), (-F.get("o", F.lit(0))["neg"]).alias("conf"), F.get("o", F.lit(1))["cls"].alias("second"))


def confusion(top: DataFrame, by: list[str]) -> DataFrame:
    return top.groupBy(*by, "y", "label").agg(F.count("*").alias("n"))


def class_metrics(top: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """Per class: support, predicted, hits, sensitivity (null without support), specificity and F1 (0 where undefined)."""
    each = confusion(top, by).select(*by, "y", "label", "n", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls"))
    tally = each.groupBy(*by, "cls").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("y") == F.col("cls"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("label") == F.col("cls"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("y") == F.col("cls")) & (F.col("label") == F.col("cls")), F.col("n")).otherwise(0)).alias("hits"),
    )
    quiet = F.col("total") - F.col("support") - F.col("predicted") + F.col("hits")
    return tally.select(
        *by, "cls", "total", "support", "predicted", "hits",
        F.try_divide("hits", "support").alias("sensitivity"),
        F.try_divide(quiet, F.col("total") - F.col("support")).alias("specificity"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"),
    )


def summary_metrics(pred: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """accuracy, top-2 accuracy, balanced accuracy over present classes, macro and weighted F1 over all classes, log loss."""
    top = predicted(pred, by)
    per = class_metrics(top, classes, by)
    scores = per.groupBy(*by).agg((F.sum("hits") / F.max("total")).alias("accuracy"), F.avg("sensitivity").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    second = top.groupBy(*by).agg(F.avg(((F.col("label") == F.col("y")) | (F.col("second") == F.col("y"))).cast("int")).alias("top2_accuracy"))
    clipped = F.least(F.greatest("prob", F.lit(1e-12)), F.lit(1.0))
    loss = pred.where("cls = y").groupBy(*by).agg((-F.avg(F.log(clipped))).alias("log_loss"))
    if not by:
        return scores.join(second, F.lit(True)).join(loss, F.lit(True))
    return scores.join(second, by).join(loss, by)


def calibration_error(top: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """ECE over equal bins (lo, hi] of confidence, against explicit edges; a confidence of zero lies in none."""
    edges = F.array(*(F.struct(F.lit(i / bins).alias("lo"), F.lit((i + 1) / bins).alias("hi")) for i in range(bins)))
    placed = top.withColumn("bin", F.get(F.filter(edges, lambda e: (F.col("conf") > e["lo"]) & (F.col("conf") <= e["hi"])), F.lit(0))["hi"])
    each = placed.where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg((F.col("y") == F.col("label")).cast("double")).alias("a"))
    total = top.groupBy(*by).agg(F.count("*").alias("total"))
    joined = each.join(total, by) if by else each.join(F.broadcast(total), F.lit(True))
    return joined.groupBy(*by).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("a") - F.col("c"))).alias("ece"))


def average_rank(df: DataFrame, by: list[str], value: str, ranges: int = 64) -> DataFrame:
    """(by, value, n, rank): average rank of each distinct value within by. Equal values are counted first, so windows run over distinct ones.

    Without by, values are ranked in ranges cut at approximate quantiles and shifted by the ranges before, so no task ranks all.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    if by:
        before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return counted.withColumn("rank", before + (F.col("n") + 1) / 2)
    cuts = counted.agg(F.percentile_approx(value, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 1000).alias("cuts"))  # one row
    placed = counted.join(F.broadcast(cuts), F.lit(True)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    shift = placed.groupBy("range").agg(F.sum("n").alias("held"))  # a row for each range
    shift = shift.select("range", F.coalesce(F.sum("held").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("before", before).join(F.broadcast(shift), "range").select(value, "n", (F.col("shift") + F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def auroc(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, cls, auc): one-against-rest Mann-Whitney AUROC with ties halved; null if a class has no member or only members."""
    keys = [*by, "cls"]
    counted = pred.groupBy(*keys, "prob").agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("cls")).alias("pos"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("prob").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("rank", before + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"))


def macro_auroc(pred: DataFrame, by: list[str]) -> DataFrame:
    return auroc(pred, by).groupBy(*by).agg(F.avg("auc").alias("macro_auroc"))


def probability_violations(pred: DataFrame, by: list[str], classes: int) -> DataFrame:
    """One row: samples with a wrong number of classes, and the largest distance of a probability sum from one."""
    sums = pred.groupBy(*by, "sample_id").agg(F.sum("prob").alias("s"), F.count("*").alias("k"))
    return sums.agg(F.count_if(F.col("k") != classes).alias("wrong_shape"), F.max(F.abs(F.col("s") - 1)).alias("largest_gap"))


def seed_ensemble(pred: DataFrame) -> DataFrame:
    """(arm, sample_id, y, cls, prob, seeds): mean probability over seeds; an arm whose samples have different numbers of seeds fails."""
    each = pred.groupBy("arm", "sample_id", "y", "cls").agg(F.avg("prob").alias("prob"), F.countDistinct("seed").alias("seeds"))
    spans = each.groupBy("arm").agg(F.min("seeds").alias("low"), F.max("seeds").alias("high"))  # a row for each arm
    even = F.when(F.col("low") == F.col("high"), F.col("seeds")).otherwise(F.raise_error(F.lit("samples have predictions from different numbers of seeds")).cast("long"))
    return each.join(F.broadcast(spans), "arm").select("arm", "sample_id", "y", "cls", "prob", even.alias("seeds"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): Spearman's correlation by average ranks."""
    rx = average_rank(df, by, x).select(*by, x, F.col("rank").alias("rx"))
    ry = average_rank(df, by, y).select(*by, y, F.col("rank").alias("ry"))
    return df.join(rx, [*by, x]).join(ry, [*by, y]).groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def spearman_p(correlations: DataFrame) -> DataFrame:
    """spearman's rows with the two-sided p of Student's t with n - 2 degrees of freedom; 0 at a correlation of one."""
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    full = F.abs(F.col("rho")) >= 1 - 1e-12
    return correlations.withColumn("__t", t).withColumn("__df", (F.col("n") - 2).cast("double")).withColumn("p", F.when(full, 0.0).otherwise(t_p("__t", "__df"))).drop("__t", "__df")


def rank_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """(k, n, h, tie): Kruskal-Wallis statistic over groups, corrected for ties, on one row; h is null if all values are equal."""
    ranks = average_rank(df, [], value)
    per = df.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    ties = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("ties"))
    each = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pow("r", 2.0) / F.col("n")).alias("s"))
    both = each.join(F.broadcast(ties), F.lit(True))
    n = F.col("n").cast("double")
    tie = 1 - F.try_divide("ties", F.pow(n, 3.0) - n)
    return both.select("k", "n", F.try_divide(F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1), tie).alias("h"), tie.alias("tie"))


def mann_whitney(df: DataFrame, group: str, value: str, first: str) -> DataFrame:
    """(n1, n2, u, z): U of the first group against all others, and its normal deviate with tie and continuity corrections; z is null if all values are equal or a group is empty."""
    ranks = average_rank(df, [], value)
    marked = df.join(ranks.select(value, "rank"), value).agg(F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) != first).alias("n2"), F.sum(F.when(F.col(group) == first, F.col("rank"))).alias("r"))
    ties = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("ties"))
    df2 = marked.join(F.broadcast(ties), F.lit(True)).withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = (F.col("n1") + F.col("n2")).cast("double")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide("ties", n * (n - 1))))
    off = F.col("u") - F.col("n1") * F.col("n2") / 2.0
    return df2.select("n1", "n2", "u", F.try_divide(F.sign(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), spread).alias("z"))


def with_normal_p(tests: DataFrame) -> DataFrame:
    """Rows with the two-sided normal p of their deviate z."""
    return tests.withColumn("p", normal_p("z"))


def with_chi2_p(tests: DataFrame) -> DataFrame:
    """rank_tests' rows with the p of h on k - 1 degrees of freedom."""
    return tests.withColumn("__df", (F.col("k") - 1).cast("double")).withColumn("p", chi2_p("h", "__df")).drop("__df")


def grouped_mann_whitney(df: DataFrame, by: list[str], group: str, value: str, first: str) -> DataFrame:
    """(by, n1, n2, mean1, mean2, u, z): mann_whitney within each stratum of by, with the two groups' means; z is null where a group is empty or all values are equal."""
    ranks = average_rank(df, by, value)
    mine = F.col(group) == first
    marked = df.join(ranks.select(*by, value, "rank"), [*by, value]).groupBy(*by).agg(
        F.count_if(mine).alias("n1"), F.count_if(~mine).alias("n2"), F.avg(F.when(mine, F.col(value))).alias("mean1"), F.avg(F.when(~mine, F.col(value))).alias("mean2"), F.sum(F.when(mine, F.col("rank"))).alias("r")
    )
    ties = ranks.groupBy(*by).agg(F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("ties"))
    both = marked.join(ties, by).withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = (F.col("n1") + F.col("n2")).cast("double")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    off = F.col("u") - F.col("n1") * F.col("n2") / 2.0
    return both.select(*by, "n1", "n2", "mean1", "mean2", "u", F.try_divide(F.sign(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), spread).alias("z"))


def win_rates(runs: DataFrame, ref: str) -> DataFrame:
    """(arm, cells, wins, mean_delta): how often and by how much ref beats each other arm over (seed, fold) cells."""
    base = runs.where(F.col("arm") == ref).select("seed", "fold", F.col("value").alias("ref_value"))
    other = runs.where(F.col("arm") != ref).join(base, ["seed", "fold"])
    return other.groupBy("arm").agg(F.count("*").alias("cells"), F.count_if(F.col("ref_value") > F.col("value")).alias("wins"), F.avg(F.col("ref_value") - F.col("value")).alias("mean_delta"))
