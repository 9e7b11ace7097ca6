"""Patient-level splits: folds, validation carve-outs, official and cross-batch schemes, leakage checks and label control."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import draw
from .qc import fingerprint


def apply_labels(samples: DataFrame, scheme: dict[str, str | None], classes: list[str]) -> DataFrame:
    """samples with label and label_idx by diagnosis; null in the scheme leaves a sample out; an unknown diagnosis or class fails."""
    if wrong := set(filter(None, scheme.values())) - set(classes):
        raise ValueError(f"classes not declared: {sorted(wrong)}")
    rows = [(k, v, classes.index(v) if v else None) for k, v in scheme.items()]
    table = samples.sparkSession.createDataFrame(rows, "diagnosis string, label string, label_idx int").withColumn("known", F.lit(True))
    joined = samples.join(F.broadcast(table), "diagnosis", "left")  # as many rows as diagnoses are declared
    checked = F.when(F.col("known"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("diagnosis without a class: "), F.coalesce("diagnosis", F.lit("null")))))
    return joined.withColumn("label", checked).where("label is not null").drop("known")


def sample_violations(samples: DataFrame) -> DataFrame:
    """(violation, n): null ids, repeated sample ids, patients with several diagnoses."""
    nulls = samples.agg(F.lit("null_id").alias("violation"), F.count_if(F.col("sample_id").isNull() | F.col("patient_id").isNull()).alias("n"))
    repeated = samples.groupBy("sample_id").count().agg(F.lit("repeated_sample").alias("violation"), F.count_if(F.col("count") > 1).alias("n"))
    mixed = samples.groupBy("patient_id").agg(F.countDistinct("diagnosis").alias("k")).agg(F.lit("mixed_patient").alias("violation"), F.count_if(F.col("k") > 1).alias("n"))
    return nulls.union(repeated).union(mixed)


def failing(wrong: Column, value: Column, said: str, kind: str = "string") -> Column:
    """value, or an error that says what is wrong."""
    return F.when(wrong, F.raise_error(F.lit(said)).cast(kind)).otherwise(value)


def patients(samples: DataFrame, strata: list[str]) -> DataFrame:
    """(patient_id, label, stratum, n_labels): each patient by its first sample. A patient with several labels fails."""
    joined = F.concat_ws("|", *strata)
    each = samples.groupBy("patient_id").agg(F.min_by("label", "sample_id").alias("label"), F.min_by(joined, "sample_id").alias("stratum"), F.countDistinct("label").alias("n_labels"))
    return each.withColumn("label", failing(F.col("n_labels") > 1, F.col("label"), "a patient has samples with different labels"))


def fold_of(people: DataFrame, k: int, seed: int) -> DataFrame:
    """people with `fold`: within a stratum, patients take turns in hash order, and strata follow on from each other.

    Strata with fewer than k patients are dealt by label instead; a label with fewer than k patients fails.
    """
    few = F.count("*").over(W.partitionBy("label")) < k
    people = people.withColumn("label", failing(few, F.col("label"), f"a class has fewer than {k} patients"))
    size = F.count("*").over(W.partitionBy("stratum"))
    df = people.withColumn("stratum", F.when(size < k, F.concat(F.lit("label:"), F.col("label"))).otherwise(F.col("stratum")))
    sizes = df.groupBy("stratum").agg(F.count("*").alias("n"))
    shift = sizes.select("stratum", F.coalesce(F.sum("n").over(W.orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    at = F.row_number().over(W.partitionBy("stratum").orderBy(draw(seed, F.col("patient_id")), "patient_id"))
    return df.withColumn("at", at).join(shift, "stratum").withColumn("fold", F.pmod(F.col("shift") + F.col("at") - 1, F.lit(k)).cast("int")).drop("at", "shift")


def carve_validation(train: DataFrame, percent: int, seed: int, strata: tuple[str, ...] = ("stratum", "label")) -> DataFrame:
    """train (fold, patient_id, strata and others) with split val or train, and `level`: percent of each fold, rounded up.

    A fold is carved by the first column of strata, by largest remainders, whose groups all have two patients or more and
    are no more than the validation's and the training's patients; level names it. If none will do, patients are drawn from
    the whole fold and level is `none`.
    """
    sizes = train.groupBy("fold").agg(F.count("*").alias("all_n")).withColumn("want", F.expr(f"(all_n * {percent} + 99) div 100"))
    level, part = F.lit("none"), F.lit("")
    for column in reversed(strata):
        groups = train.groupBy("fold", column).agg(F.count("*").alias("n")).groupBy("fold").agg(F.min("n").alias("least"), F.count("*").alias("groups"))
        sizes = sizes.join(groups, "fold").withColumn(f"__{column}", F.expr("least >= 2 and groups <= least(want, all_n - want)")).drop("least", "groups")
        level = F.when(F.col(f"__{column}"), column).otherwise(level)
        part = F.when(F.col(f"__{column}"), F.col(column)).otherwise(part)
    sizes = sizes.select("fold", "all_n", "want", level.alias("level"), *(f"__{c}" for c in strata))
    placed = train.join(F.broadcast(sizes), "fold").withColumn("part", part)  # a row for each fold
    fold = W.partitionBy("fold")
    quota = placed.groupBy("fold", "part", "all_n", "want").agg(F.count("*").alias("n"))
    quota = quota.withColumn("base", F.expr("n * want div all_n")).withColumn("rest", F.expr("n * want % all_n"))
    quota = quota.withColumn("short", F.col("want") - F.sum("base").over(fold)).withColumn("place", F.row_number().over(fold.orderBy(F.desc("rest"), "part")))
    quota = quota.select("fold", "part", (F.col("base") + F.when(F.col("place") <= F.col("short"), 1).otherwise(0)).alias("quota"))
    order = W.partitionBy("fold", "part").orderBy(draw(seed, F.col("fold"), F.col("patient_id")), "patient_id")
    out = placed.withColumn("at", F.row_number().over(order)).join(quota, ["fold", "part"])
    return out.select(*train.columns, "level", F.when(F.col("at") <= F.col("quota"), "val").otherwise("train").alias("split"))


def kfold_splits(people: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """(fold, patient_id, label, split): each patient is test in one fold, and train or val in the others."""
    dealt = fold_of(people.withColumn("fine", F.col("stratum")), k, seed).select("patient_id", "label", F.col("fine").alias("stratum"), F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    test = dealt.where("fold = own").select("fold", "patient_id", "label", F.lit("test").alias("split"))
    rest = carve_validation(dealt.where("fold <> own").select("fold", "patient_id", "label", "stratum"), percent, seed)
    return test.unionByName(rest.select("fold", "patient_id", "label", "split"))


def official_splits(samples: DataFrame, percent: int, seed: int) -> DataFrame:
    """One fold by the official column; validation comes out of its training part. A patient in both parts, or another part than train and test, fails."""
    known = F.coalesce(F.col("official_split").isin("train", "test"), F.lit(False))
    samples = samples.withColumn("official_split", failing(~known, F.col("official_split"), "official_split must be train or test"))
    people = samples.groupBy("patient_id").agg(F.min_by("label", "sample_id").alias("label"), F.min("official_split").alias("low"), F.max("official_split").alias("high"))
    part = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("a patient is in both official splits")))
    people = people.select(F.lit(0).alias("fold"), "patient_id", "label", part.alias("split"))
    rest = carve_validation(people.where("split = 'train'").drop("split"), percent, seed, ("label",))
    return people.where("split = 'test'").unionByName(rest.drop("level"))


def cross_batch_splits(samples: DataFrame, percent: int, seed: int) -> DataFrame:
    """Fold k tests on the k-th batch by name and trains on the others. A class that a batch lacks, or a patient in two batches, fails."""
    cells = samples.groupBy("batch", "label").count().collect()  # a handful of batches and classes
    batches, labels = sorted({r.batch for r in cells}), {r.label for r in cells}
    if missing := sorted({(b, c) for b in batches for c in labels} - {(r.batch, r.label) for r in cells}):
        raise ValueError(f"every class must be in every batch; missing: {missing}")
    people = samples.groupBy("patient_id").agg(F.min_by("label", "sample_id").alias("label"), F.min("batch").alias("batch"), F.max("batch").alias("last"))
    people = people.withColumn("batch", failing(F.col("batch") != F.col("last"), F.col("batch"), "a patient has samples in several batches")).drop("last")
    folds = F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(b).alias("tested")) for i, b in enumerate(batches)))
    each = people.select("patient_id", "label", "batch", F.inline(folds))
    rest = carve_validation(each.where("batch <> tested").select("fold", "patient_id", "label"), percent, seed, ("label",))
    return each.where("batch = tested").select("fold", "patient_id", "label", F.lit("test").alias("split")).unionByName(rest.select("fold", "patient_id", "label", "split"))


def leakage(splits: DataFrame) -> DataFrame:
    """(fold, repeated, spanning, missing_splits) of a split table."""
    per = splits.groupBy("fold", "patient_id").agg(F.count("*").alias("n"), F.countDistinct("split").alias("k"))
    out = per.groupBy("fold").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("k") > 1).alias("spanning"))
    return out.join(splits.groupBy("fold").agg((3 - F.countDistinct("split")).alias("missing_splits")), "fold")


def manifest(splits: DataFrame) -> DataFrame:
    """(fold, split, label, n, print, total): counts, and an order-free fingerprint of who is where."""
    return fingerprint(splits, ["fold", "patient_id", "split"], ["fold", "split", "label"])


def keep_splits(splits: DataFrame, path: str) -> DataFrame:
    """splits, written to path with their manifest; if path holds an assignment already, that one, unless it is another: then it fails."""
    spark = splits.sparkSession
    own = manifest(splits)
    try:
        held = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:  # nothing there yet
        splits.write.parquet(f"{path}/assignment")
        own.coalesce(1).write.parquet(f"{path}/manifest")
        return spark.read.parquet(f"{path}/assignment")
    if own.exceptAll(held).head(1) or held.exceptAll(own).head(1):
        raise ValueError(f"{path} holds a different assignment; delete it if the change is meant")
    return spark.read.parquet(f"{path}/assignment")


def task_samples(samples: DataFrame, excluded: tuple[str, ...] = (), least: int = 0, by_batch: bool = False) -> DataFrame:
    """samples of a protocol, with label_idx in the order of the labels left.

    Excluded classes go; with least, so do classes with fewer patients than that in some batch; with by_batch, the label is
    the batch and tissue_label keeps the class.
    """
    df = samples.where(~F.col("label").isin(*excluded)) if excluded else samples
    if least:
        df = df.join(robust_classes(df, least).select("label"), "label", "left_semi")
    if by_batch:
        df = df.withColumn("tissue_label", F.col("label")).withColumn("label", F.col("batch"))
    order = df.select("label").distinct().agg(F.array_sort(F.collect_list("label")).alias("labels"))  # as long as there are classes
    return df.drop("label_idx").join(F.broadcast(order), F.lit(True)).withColumn("label_idx", (F.array_position("labels", F.col("label")) - 1).cast("int")).drop("labels")


def guarded(samples: DataFrame, labels: list[str], revealed: bool = False) -> DataFrame:
    """samples with the label columns of the test split hidden until they are revealed."""
    if revealed:
        return samples
    return samples.withColumns({c: F.when(F.col("split") != "test", F.col(c)) for c in labels})


def content_twins(calls: DataFrame, splits: DataFrame) -> DataFrame:
    """(fold, twin, sample_id, split): samples with the same calls as one in another split; twin is the smallest sample of the group.

    Groups are found by an order-free fingerprint and listed member by member, never as pairs.
    """
    mark = F.xxhash64("locus_key", "state")
    prints = calls.groupBy("sample_id").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 30))).alias("s"))
    placed = prints.join(splits.select("fold", "split", F.col("patient_id").alias("sample_id")), "sample_id")
    same = ["fold", "n", "x", "s"]
    groups = placed.groupBy(*same).agg(F.min("sample_id").alias("twin"), F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high")
    return placed.join(groups, same).select("fold", "twin", "sample_id", "split")


def robust_classes(samples: DataFrame, least: int) -> DataFrame:
    """(label, fewest): classes with at least `least` patients in every batch."""
    batches = samples.agg(F.countDistinct("batch").alias("batches"))
    each = samples.groupBy("label", "batch").agg(F.countDistinct("patient_id").alias("n"))
    seen = each.groupBy("label").agg(F.min("n").alias("fewest"), F.count("*").alias("in_batches"))
    return seen.join(F.broadcast(batches), F.col("in_batches") == F.col("batches")).where(F.col("fewest") >= least).select("label", "fewest")


def confounded_classes(samples: DataFrame) -> DataFrame:
    """(label, batch): classes seen in one batch only."""
    return samples.groupBy("label").agg(F.countDistinct("batch").alias("k"), F.min("batch").alias("batch")).where("k = 1").drop("k")


