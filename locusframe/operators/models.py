"""Feature models on selected regions or summaries, fitted with Spark ML inside a fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import kept, new_path


FITTED = 1 << 15  # samples worth a task of their own in each step of a fit, up to the cores
HELD = 1 << 19  # samples that a task holds at most


def tasks_for(n: int, cores: int) -> int:
    """Tasks to fit n samples in: one for FITTED samples up to the cores, since a boosted model takes thousands of short steps."""
    return max(min(cores, n // FITTED + 1), n // HELD + 1)


def balanced_weights(samples: DataFrame) -> DataFrame:
    """samples with weight n / (classes * class size)."""
    sizes = samples.groupBy("label_idx").agg(F.count("*").alias("k"))
    every = W.partitionBy()
    weights = sizes.select("label_idx", (F.sum("k").over(every) / (F.count("*").over(every) * F.col("k"))).alias("weight"))
    return samples.join(F.broadcast(weights), "label_idx")  # a row for each class


def assemble(values: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, features): a sample's values in the order of their names, as one vector."""
    return values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(name, value))).alias("v")).select(key, array_to_vector(F.transform("v", lambda x: x[value].cast("double"))).alias("features"))


def vectors(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, features) of arrays of doubles that are in order already."""
    return values.select(key, array_to_vector(value).alias("features"))


def fold_loop(features: Callable[[DataFrame, DataFrame], DataFrame], samples: DataFrame, splits: DataFrame, **settings) -> DataFrame:
    """(fold, sample_id, y, cls, prob) of every fold's test samples, each fold's model fitted on its train and validation part alone.

    features(fit samples, all samples) gives (key, features); it sees the labels of the fit samples only. samples: sample_id,
    patient_id, label_idx and others; splits: fold, patient_id, split. A short loop on the driver starts the folds' jobs.

    Samples meet their places in all folds by one join, which is written once, so a fold only picks its own.
    """
    places = splits.groupBy("patient_id").agg(F.collect_list(F.struct("fold", "split")).alias("places"))
    rows, out = kept(samples.join(places, "patient_id")), None
    for fold in sorted(r[0] for r in splits.select("fold").distinct().collect()):  # a handful
        placed = rows.select(*samples.columns, F.inline("places")).where(F.col("fold") == fold).drop("fold")
        fit = placed.where("split <> 'test'")
        found = fit_predict(features(fit, placed.drop("label", "label_idx")), placed.select("sample_id", "label_idx", "split"), **settings)
        found = found.select(F.lit(fold).alias("fold"), "*")
        out = found if out is None else out.union(found)
    return out


def fit_predict(features: DataFrame, samples: DataFrame, c: float = 1.0, trees: int = 0, boosts: int = 0, rate: float = 0.05) -> DataFrame:
    """(sample_id, y, cls, prob) of the test split; fitted on the rest (sample_id, label_idx, split) with balanced weights.

    Multinomial logistic regression with an L2 penalty of 1 / (c * total weight); with trees, a random forest of that size; with
    boosts, for each class against the rest that many trees of depth 3, each fitted to the gradient of the logistic loss on
    four fifths of the rows and added at `rate`, and the classes' probabilities divided by their sum.

    features and samples, a row for each sample, are written to the shared folder, in as many files as there are tasks to fit
    in: fitting reads them many times, and a file of one row group is one task, whatever the cores. If no fit
    sample has features, as when no region was selected, the fit samples' classes are equally likely; without fit samples
    there are no predictions.
    """
    path, tasks = new_path(features.sparkSession), tasks_for(samples.count(), features.sparkSession.sparkContext.defaultParallelism)
    if tasks > 1:
        features, samples = (rows.repartition(tasks, "sample_id") for rows in (features, samples))
    features.join(samples, "sample_id").write.parquet(path)
    rows = features.sparkSession.read.parquet(path)
    train = balanced_weights(rows.where("split <> 'test'"))
    test = rows.where("split = 'test'")
    if not train.head(1):
        fit = samples.where("split <> 'test'").agg(F.array_sort(F.collect_set("label_idx")).alias("seen"))  # one row
        whole = F.sequence(F.lit(0), F.array_max("seen").cast("int"))
        chance = F.transform(whole, lambda x: F.when(F.array_contains("seen", x), 1 / F.size("seen")).otherwise(0.0))
        scored = samples.where("split = 'test'").join(F.broadcast(fit), F.lit(True))
    elif boosts:
        classes = samples.agg(F.max("label_idx")).first()[0] + 1
        one = GBTClassifier(maxIter=boosts, maxDepth=3, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=7)
        model = OneVsRest(classifier=one, labelCol="label_idx", weightCol="weight", parallelism=classes).fit(train)
        # A class's raw value is half the log odds.
        odds = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        scored = model.transform(test).withColumn("odds", odds)
        chance = F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda a, b: a + b))
    elif trees:
        scored = RandomForestClassifier(labelCol="label_idx", weightCol="weight", numTrees=trees, maxDepth=3, seed=7).fit(train).transform(test)
        chance = vector_to_array("probability")
    else:
        total = train.agg(F.sum("weight")).first()[0]
        scored = LogisticRegression(labelCol="label_idx", weightCol="weight", family="multinomial", regParam=1 / (c * total), maxIter=50).fit(train).transform(test)
        chance = vector_to_array("probability")
    return scored.select("sample_id", F.col("label_idx").cast("int").alias("y"), F.posexplode(chance).alias("cls", "prob"))
