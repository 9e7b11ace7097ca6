"""Observed methylation: projections, sample summaries, regions, region values and one-against-rest selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import key_code, key_position, make_key
from ..functions.stats import t_p

COVERAGE_LIMIT = 65535


def scan_reason(context: Column, code: Column, coverage: Column, min_coverage: int, last_code: int = 22) -> Column:
    """The first filter a row fails, or kept."""
    return F.when(context != "CG", "non_cg").when(code.isNull() | ~code.between(1, last_code), "other_contig").when(coverage < min_coverage, "low_coverage").otherwise("kept")


def scan_stats(rows: DataFrame, min_coverage: int = 4) -> DataFrame:
    """(reason, n) of the scan's filters over rows (context, code, ct_count)."""
    return rows.groupBy(scan_reason(F.col("context"), F.col("code"), F.col("ct_count"), min_coverage).alias("reason")).agg(F.count("*").alias("n"))


def scan_kept(rows: DataFrame, min_coverage: int = 4) -> DataFrame:
    """(sample_id, locus_key, c_count, ct_count) of the rows that pass; fails on a minus strand, more C than coverage or a repeated locus."""
    kept = rows.where(scan_reason(F.col("context"), F.col("code"), F.col("ct_count"), min_coverage) == "kept").withColumn("locus_key", make_key(F.col("code"), F.col("pos")))
    wrong = F.when(F.col("strand") != "+", "strand").when(F.col("c_count") > F.col("ct_count"), "count").when(F.count("*").over(W.partitionBy("sample_id", "locus_key")) > 1, "repeat")
    checked = kept.withColumn("wrong", wrong)
    key = F.when(F.col("wrong").isNull(), F.col("locus_key")).otherwise(F.raise_error(F.concat(F.lit("bad methratio row: "), F.col("wrong"))).cast("long"))
    return checked.select("sample_id", key.alias("locus_key"), "c_count", "ct_count")


def observe(counts: DataFrame) -> DataFrame:
    """(sample_id, locus_key, beta, coverage) of covered loci; coverage is clipped to 16 bits."""
    seen = counts.where("ct_count > 0")
    return seen.select("sample_id", "locus_key", (F.col("c_count") / F.col("ct_count")).alias("beta"), F.least(F.col("ct_count"), F.lit(COVERAGE_LIMIT)).alias("coverage"))


def clipped(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count_if(F.col("ct_count") > COVERAGE_LIMIT).alias("n_clipped"), F.count("*").alias("n"))


def token_features(obs: DataFrame) -> DataFrame:
    """obs with centred beta and scaled log coverage."""
    return obs.withColumn("beta_c", F.col("beta") - 0.5).withColumn("log_cov", F.log1p("coverage") / 5)


def sample_summary(obs: DataFrame, n_loci: int | None = None) -> DataFrame:
    """Per sample: observed loci, missing share of n_loci (of all loci observed, if not given), mean and population variance of beta, mean and median coverage."""
    if n_loci is None:
        loci = obs.select("locus_key").distinct().agg(F.count("*").alias("n_loci"))  # one row
        return sample_summary(obs, 1).drop("missing_fraction").join(F.broadcast(loci), F.lit(True)).select(
            "sample_id", "n_observed", (1 - F.col("n_observed") / F.col("n_loci")).alias("missing_fraction"), "mean_beta", "var_beta", "mean_coverage", "median_coverage"
        )
    return obs.groupBy("sample_id").agg(
        F.count("*").alias("n_observed"),
        (1 - F.count("*") / F.lit(n_loci)).alias("missing_fraction"),
        F.avg("beta").alias("mean_beta"),
        F.var_pop("beta").alias("var_beta"),
        F.avg("coverage").alias("mean_coverage"),
        F.median("coverage").alias("median_coverage"),
    )


def summary_features(summary: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """(place, sample_id, columns) in the order of samples' place; samples without a summary have nulls."""
    return samples.select("place", "sample_id").join(summary.select("sample_id", *columns), "sample_id", "left").select("place", "sample_id", *columns)


def candidate_regions(loci: DataFrame, max_gap: int) -> DataFrame:
    """(locus_key, region_id): runs of loci of a contig no further apart than max_gap, numbered from 0 in key order."""
    own = loci.select("locus_key").distinct().withColumn("code", key_code(F.col("locus_key")))
    order = W.partitionBy("code").orderBy("locus_key")
    gap = F.col("locus_key") - F.lag("locus_key").over(order)
    local = own.withColumn("starts", F.when(gap.isNull() | (gap > max_gap), 1).otherwise(0)).withColumn("local", F.sum("starts").over(order))
    sizes = local.groupBy("code").agg(F.max("local").alias("n"))
    shift = sizes.select("code", F.coalesce(F.sum("n").over(W.orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))  # one row a contig
    return local.join(F.broadcast(shift), "code").select("locus_key", (F.col("local") - 1 + F.col("shift")).alias("region_id"))


def region_beta(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample_id, region_id, region_beta, n_loci): coverage-weighted mean of the observed loci."""
    joined = obs.join(regions, "locus_key")
    return joined.groupBy("sample_id", "region_id").agg((F.sum(F.col("beta") * F.col("coverage")) / F.sum("coverage")).alias("region_beta"), F.count("*").alias("n_loci"))


def region_sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region_id").agg(F.count("*").alias("size"), F.min(key_position(F.col("locus_key"))).alias("first_pos"), F.max(key_position(F.col("locus_key"))).alias("last_pos"))


def observed_regions(values: DataFrame, n_samples: int, min_fraction: float) -> DataFrame:
    """(region_id, observed) of regions seen in at least min_fraction of the samples."""
    return values.groupBy("region_id").agg((F.countDistinct("sample_id") / F.lit(n_samples)).alias("observed")).where(F.col("observed") >= min_fraction)


def one_vs_rest(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, region_id, n, n_rest, delta, t, df): Welch's statistics of each class against the others in each region.

    The rest's moments come from the classes' own means and central sums, so no difference of large squares is taken. Classes
    with fewer than two observed samples on either side are left out. A standard error under 1e-6 counts as none: t and df are null.
    """
    return class_tests(values.join(labels.select("sample_id", "label"), "sample_id"))


def class_tests(labelled: DataFrame) -> DataFrame:
    """one_vs_rest of values that have their samples' labels (label, region_id, region_beta); n + n_rest are all samples seen in a region."""
    own = labelled.groupBy("region_id", "label").agg(F.count("*").alias("n"), F.avg("region_beta").alias("m"), F.var_pop("region_beta").alias("v"))
    own = own.withColumn("s", F.col("v") * F.col("n"))
    whole = W.partitionBy("region_id")
    total_n, total_mean = F.sum("n").over(whole), F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    df = own.withColumn("all_n", total_n).withColumn("all_m", total_mean)
    df = df.withColumn("all_s", F.sum(F.col("s") + F.col("n") * F.pow(F.col("m") - F.col("all_m"), 2.0)).over(whole))
    df = df.withColumn("n_rest", F.col("all_n") - F.col("n")).where("n >= 2 AND n_rest >= 2")
    df = df.withColumn("m_rest", (F.col("all_n") * F.col("all_m") - F.col("n") * F.col("m")) / F.col("n_rest"))
    across = F.col("n") * F.col("n_rest") / F.col("all_n") * F.pow(F.col("m") - F.col("m_rest"), 2.0)
    df = df.withColumn("s_rest", F.greatest(F.col("all_s") - F.col("s") - across, F.lit(0.0)))
    df = df.withColumn("a", F.col("s") / (F.col("n") - 1) / F.col("n")).withColumn("b", F.col("s_rest") / (F.col("n_rest") - 1) / F.col("n_rest"))
    spread = F.col("a") + F.col("b") > 1e-12
    df = df.withColumn("delta", F.col("m") - F.col("m_rest")).withColumn("t", F.when(spread, F.col("delta") / F.sqrt(F.col("a") + F.col("b"))))
    freedom = F.try_divide(F.pow(F.col("a") + F.col("b"), 2.0), F.pow(F.col("a"), 2.0) / (F.col("n") - 1) + F.pow(F.col("b"), 2.0) / (F.col("n_rest") - 1))
    return df.select("label", "region_id", "n", "n_rest", "delta", "t", F.when(spread, freedom).alias("df"))


def select_regions(tests: DataFrame, n_per_class: int, min_delta: float = 0.0) -> DataFrame:
    """(label, region_id, p, rank): each class's regions of smallest p, ties by region_id, among those with |delta| >= min_delta."""
    tested = tests.withColumn("p", t_p("t", "df")).where(F.col("p").isNotNull() & (F.abs("delta") >= min_delta))
    order = W.partitionBy("label").orderBy("p", "region_id")
    return tested.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_per_class).select("label", "region_id", "p", "rank")


def top_contributions(obs: DataFrame, means: DataFrame, k: int) -> DataFrame:
    """(sample_id, locus_key, contribution, rank): each sample's k loci furthest above their mean, ties by locus."""
    centred = obs.join(means, "locus_key").withColumn("contribution", F.col("beta") - F.col("mean_beta"))
    order = W.partitionBy("sample_id").orderBy(F.desc("contribution"), "locus_key")
    return centred.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("sample_id", "locus_key", "contribution", "rank")


def recurrent_loci(top: DataFrame, samples: DataFrame, k: int = 10) -> DataFrame:
    """(label, locus_key, samples, rank): the k loci that most samples of a class have among their top ones, ties by locus."""
    counted = top.join(samples.select("sample_id", "label"), "sample_id").groupBy("label", "locus_key").agg(F.count("*").alias("samples"))
    order = W.partitionBy("label").orderBy(F.desc("samples"), "locus_key")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def impute_medians(values: DataFrame, fit: DataFrame, samples: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample_id, region_id, region_beta) for every sample and every selected region; unobserved ones take the median of the fit rows.

    regions is a selection, so the grid is samples times a bounded list, built by exploding that list.
    """
    medians = values.join(fit.select("sample_id"), "sample_id").groupBy("region_id").agg(F.median("region_beta").alias("fill"))
    listed = regions.select("region_id").distinct().join(medians, "region_id", "left").agg(F.collect_list(F.struct("region_id", "fill")).alias("grid"))
    grid = samples.select("sample_id").join(F.broadcast(listed), F.lit(True)).select("sample_id", F.inline("grid"))
    return grid.join(values.select("sample_id", "region_id", "region_beta"), ["sample_id", "region_id"], "left").select("sample_id", "region_id", F.coalesce("region_beta", "fill").alias("region_beta"))


def by_sample(values: DataFrame) -> DataFrame:
    """(sample_id, held): a sample's regions and their values as one map, so that what goes by sample needs no further shuffle."""
    return values.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("region_id", "region_beta"))).alias("held"))


def medians(values: DataFrame, regions: list[int]) -> dict[int, float]:
    """The median of each of a short list of regions, as F.median gives it, without a group of all values of a region.

    Sketches of a fixed size give two values that the middle ranks lie between. Values below are counted, and those between are
    counted by value and put in order. A region whose middle lies outside all the same is left to F.median.
    """
    rows = values.where(F.col("region_id").isin(regions) & F.col("region_beta").isNotNull()).select("region_id", "region_beta")
    around = F.percentile_approx("region_beta", [0.499, 0.501], 10000)
    bounds = rows.groupBy("region_id").agg(F.count("*").alias("n"), around.alias("b")).select("region_id", "n", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    near = rows.join(F.broadcast(bounds), "region_id").where("region_beta <= high")  # as many rows as regions are listed
    counted = near.groupBy("region_id", "n", F.when(F.col("region_beta") >= F.col("low"), F.col("region_beta")).alias("x")).agg(F.count("*").alias("k"))
    placed = counted.withColumn("upto", F.sum("k").over(W.partitionBy("region_id").orderBy(F.asc_nulls_first("x"))))
    at = lambda rank: F.min(F.when(F.col("upto") > F.expr(rank), F.struct("upto", "x")))["x"]  # noqa: E731  null if it lies below or beyond
    found = placed.groupBy("region_id").agg(at("(n - 1) div 2").alias("a"), at("n div 2").alias("b")).collect()
    sure = {r.region_id: r.a if r.a == r.b else 0.5 * r.a + 0.5 * r.b for r in found if r.a is not None and r.b is not None}
    if missed := [r.region_id for r in found if r.region_id not in sure]:
        sure |= dict(rows.where(F.col("region_id").isin(missed)).groupBy("region_id").agg(F.median("region_beta")).collect())
    return sure


def chosen_regions(fit: DataFrame, least: float, per_class: int) -> dict[int, float]:
    """Regions observed in `least` of the fit samples (sample_id, label, held) and selected by class, with the fit samples' medians.

    Their number is per_class for each class at most, so they may come to the driver.
    """
    rows = fit.select("label", F.explode("held").alias("region_id", "region_beta"))
    often = (F.col("n") + F.col("n_rest")) / F.lit(fit.count()) >= least
    listed = select_regions(class_tests(rows).where(often), per_class).select("region_id").distinct().collect()
    return medians(rows, sorted(r.region_id for r in listed)) if listed else {}


def filled(samples: DataFrame, regions: dict[int, float]) -> DataFrame:
    """(sample_id, values): each sample's values in the order of the regions, their fills where it has none. Without regions no rows."""
    each = [F.coalesce(F.try_element_at("held", F.lit(r).cast("long")), F.lit(fill)) for r, fill in sorted(regions.items())]
    return samples.where(F.lit(bool(each))).select("sample_id", F.array(*each).cast("array<double>").alias("values"))
