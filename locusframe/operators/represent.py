"""Representations of loci: generated vectors, gathering, standardisation, projection and controls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import draw, key_code, key_position
from .intervals import require_covered
from .qc import fingerprint

# The increment and the two multipliers of the SplitMix64 mixer.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    a, b, c = (np.uint64(v) for v in SPLITMIX)
    with np.errstate(over="ignore"):
        x = x + a
        x = (x ^ (x >> np.uint64(30))) * b
        x = (x ^ (x >> np.uint64(27))) * c
    return x ^ (x >> np.uint64(31))


def unit_uniform(x: np.ndarray) -> np.ndarray:
    return ((mix64(x) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def locus_uniform(loci: DataFrame, seed: int) -> DataFrame:
    """(locus_key, u): a number in (0, 1) from a 64-bit mix of key and seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mixed = mix64(b.locus_key.to_numpy().astype(np.uint64) ^ mix64(np.array([seed], np.uint64)))
            yield pd.DataFrame({"locus_key": b.locus_key, "u": ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53})

    return loci.select("locus_key").mapInPandas(run, "locus_key long, u double")


def random_vectors(loci: DataFrame, dim: int, seed: int) -> DataFrame:
    """(locus_key, vec): normal deviates by Box-Muller from hashes of seed, key and component; each depends on its key alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with np.errstate(over="ignore"):
                base = mix64(b.locus_key.to_numpy().astype(np.uint64) ^ mix64(np.array([seed], np.uint64)))
                slot = base[:, None] + np.arange(2 * dim, dtype=np.uint64)[None, :]
            u = unit_uniform(slot)
            vec = np.sqrt(-2 * np.log(u[:, :dim])) * np.cos(2 * math.pi * u[:, dim:])
            yield pd.DataFrame({"locus_key": b.locus_key, "vec": list(vec.astype(np.float32))})

    return loci.select("locus_key").mapInPandas(run, "locus_key long, vec array<float>")


def position_vector(key: Column, dim: int) -> Column:
    """One-hot contig (24) and sines and cosines of the position at periods from 16 to 2.7e8 in geometric steps."""
    n = (dim - 24) // 2
    if dim <= 24 or (dim - 24) % 2:
        raise ValueError("dim must exceed 24 by an even number")
    steps = [16.0 * (2.7e8 / 16.0) ** (i / max(1, n - 1)) for i in range(n)]
    one_hot = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.when(i == key_code(key), 1.0).otherwise(0.0))
    angles = F.transform(F.array(*map(F.lit, steps)), lambda p: key_position(key) * (2 * math.pi) / p)
    return F.concat(one_hot, F.transform(angles, F.sin), F.transform(angles, F.cos))


def empty_vectors(loci: DataFrame) -> DataFrame:
    """(locus_key, vec) with vectors of no components, for arms without a representation."""
    return loci.select("locus_key", F.array().cast("array<float>").alias("vec"))


def unpack_bits(packed: Column, n: int) -> Column:
    """The first n bits of a binary value, the highest of each byte first, as an array of 0 and 1."""
    nibbles = F.transform(F.split(F.hex(packed), ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    return F.transform(F.slice(F.split(F.array_join(nibbles, ""), ""), 1, n), lambda b: b.cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def gather(loci: DataFrame, store: DataFrame) -> DataFrame:
    """loci with their vec; fails on a repeated key of the store or a locus that it lacks."""
    unique = store.groupBy("locus_key").agg(F.count("*").alias("k"), F.first("vec").alias("vec"))
    joined = loci.join(unique, "locus_key", "left")
    bad = F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "repeated")
    vec = F.when(bad.isNull(), F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("store: "), bad, F.lit(" key "), F.col("locus_key"))).cast(dict(store.dtypes)["vec"]))
    return joined.select("locus_key", vec.alias("vec"))


def moments(store: DataFrame) -> DataFrame:
    """(dim, mean, std): population moments of each component; a standard deviation under 1e-6 counts as one. Null vectors are left out."""
    x = array_to_vector(F.col("vec").cast("array<double>"))
    found = store.where("vec is not null").agg(Summarizer.metrics("mean", "variance", "count").summary(x).alias("m"))
    each = found.select(F.col("m.count").alias("n"), F.arrays_zip(vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("variance")).alias("z"))
    std = F.sqrt(F.col("z.variance") * (F.col("n") - 1) / F.col("n"))  # the summarizer's variance is that of a sample
    return each.select("n", F.posexplode("z").alias("dim", "z")).select("dim", F.col("z.mean").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def standardised(store: DataFrame) -> DataFrame:
    """store with vec standardised. The moments are one broadcast row, and no vector is taken apart."""
    listed = moments(store).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("moments"))
    scaled = F.zip_with(F.col("vec").cast("array<double>"), F.col("moments"), lambda x, m: (x - m["mean"]) / m["std"])
    return store.join(F.broadcast(listed), F.lit(True)).withColumn("vec", scaled).drop("moments")


def standardise(store: DataFrame, key: str = "locus_key") -> DataFrame:
    """(key, dim, z) of every component."""
    return standardised(store).select(key, F.posexplode("vec").alias("dim", "z"))


def hash_sample(store: DataFrame, n: int, seed: int, key: str = "locus_key") -> DataFrame:
    return store.orderBy(draw(seed, F.col(key)), key).limit(n)


def shuffled_control(store: DataFrame, seed: int, key: str = "locus_key") -> DataFrame:
    """(key, source): a seeded permutation of the keys. Places are hash ranges, ranked one range at a time, so no task ranks all keys."""

    def placed(order: list[Column], name: str) -> DataFrame:
        block = store.select(F.col(key).alias(name), F.shiftright(order[0], 22).alias("block"), order[0].alias("o"))
        sizes = block.groupBy("block").agg(F.count("*").alias("n"))  # at most 1024 rows
        shift = sizes.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
        at = F.row_number().over(W.partitionBy("block").orderBy("o", name))
        return block.withColumn("at", at).join(F.broadcast(shift), "block").select(name, (F.col("at") + F.col("shift")).alias("at"))

    k = F.col(key)
    return placed([draw(seed, k)], key).join(placed([draw(f"{seed}-source", k)], "source"), "at").drop("at")


def by_matrix(store: DataFrame, matrix: np.ndarray, centre: np.ndarray | None = None, key: str = "locus_key") -> DataFrame:
    """(key, vec): (vec - centre) times matrix, a block of rows at a time. The matrix is broadcast: width times rank numbers."""
    spread = store.sparkSession.sparkContext.broadcast((matrix, centre))
    kind = dict(store.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, centre = spread.value
        for b in batches:
            x = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
            y = (x if centre is None else x - centre) @ matrix
            vec = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), vec], names=[key, "vec"])

    return store.where("vec is not null").select(key, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"`{key}` {kind}, vec array<double>")


def signed(axes: np.ndarray) -> np.ndarray:
    """Axes, one a column, turned so that the component of the largest size is positive."""
    top = np.abs(axes).argmax(axis=0)
    return axes * np.sign(axes[top, np.arange(axes.shape[1])])


def principal_axes(store: DataFrame, rank: int, sample: int, seed: int, key: str = "locus_key") -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(mean, axes times the common scale, explained shares) of a hash sample of store; width times width numbers are gathered, as PCA does."""
    fit = hash_sample(store, sample, seed, key).select(array_to_vector(F.col("vec").cast("array<double>")).alias("x"))
    found = fit.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")).select("s.mean", "s.variance", "s.count").first()
    model = PCA(k=rank, inputCol="x", outputCol="y").fit(fit)  # its covariance is centred
    shares = model.explainedVariance.toArray()
    # Mean square of the projected sample: the axes' share of the population variances.
    spread = found["variance"].toArray().sum() * (found["count"] - 1) / found["count"] * shares.sum()
    return found["mean"].toArray(), signed(model.pc.toArray()) / math.sqrt(spread / rank), list(shares)


def project(store: DataFrame, rank: int, sample: int, seed: int, key: str = "locus_key") -> tuple[DataFrame, list[float]]:
    """(key, vec) on `rank` principal axes fitted to a hash sample, centred by its mean, all scaled by one factor; and the explained shares.

    Of each axis the largest component is positive. The plan does not grow with the store's width or the rank.
    """
    mean, axes, shares = principal_axes(store, rank, sample, seed, key)
    return by_matrix(store, axes, mean, key).withColumn("vec", F.col("vec").cast("array<float>")), shares


def block_svd(store: DataFrame, rank: int, sample: int, seed: int) -> tuple[DataFrame, list[float]]:
    """(locus_key, vec): loci of store (locus_key, bits, vec) on the `rank` leading right singular vectors of [scaled bits | standardised vec]; and the singular values.

    Fitted, uncentred, on a hash sample that takes from each contig its share of `sample`, with the sample's own moments. Bits
    share one scale, that of a mean square of one. Contigs are sampled apart; the product matrix is summed up in the JVM. Of
    each axis the largest component is positive.
    """
    sizes = store.groupBy(key_code(F.col("locus_key")).alias("code")).agg(F.count("*").alias("n"))
    quota = sizes.select("code", F.round(F.col("n") * sample / F.sum("n").over(W.partitionBy())).alias("quota"))  # a row for each contig
    order = W.partitionBy("code").orderBy(draw(seed, F.col("locus_key")), "locus_key")
    picked = store.select("locus_key", key_code(F.col("locus_key")).alias("code")).withColumn("at", F.row_number().over(order))
    picked = picked.join(F.broadcast(quota), "code").where("at <= quota").select("locus_key")
    fit = store.join(picked, "locus_key")
    square = fit.select(F.avg(F.aggregate("bits", F.lit(0), lambda a, b: a + b * b) / F.size("bits"))).first()[0]
    scale = 1 / max(math.sqrt(square or 0), 1e-8)
    listed = moments(fit).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("moments"))

    def combined(df: DataFrame) -> DataFrame:
        dense = F.zip_with(F.col("vec").cast("array<double>"), F.col("moments"), lambda x, m: (x - m["mean"]) / m["std"])
        return df.join(F.broadcast(listed), F.lit(True)).select("locus_key", F.concat(F.transform("bits", lambda b: b * scale), dense).alias("vec"))

    rows = MLUtils.convertVectorColumnsFromML(combined(fit).select(array_to_vector("vec").alias("x")), "x")
    svd = RowMatrix(rows).computeSVD(rank)  # the decomposition takes vectors of the older class
    return by_matrix(combined(store), signed(svd.V.toArray())), svd.s.toArray().tolist()


def materialise(store: DataFrame, loci: DataFrame, path: str, shuffle_seed: int | None = None, projection: tuple[int, int, int] | None = None) -> DataFrame:
    """The manifest (n_loci, print, total, dim, shuffle_seed) of loci's vectors, written to path/vectors with it beside them.

    A locus outside the store fails before anything is written. projection: rank, sample and seed of project, fitted on the
    whole store. With shuffle_seed the vectors change places among the loci.
    """
    keys = require_covered(loci.select("locus_key").distinct(), store)
    source = store if projection is None else project(store, *projection)[0]
    table = gather(keys, source)
    if shuffle_seed is not None:
        places = shuffled_control(keys, shuffle_seed)
        table = places.join(table.withColumnRenamed("locus_key", "source"), "source").select("locus_key", "vec")
    table.write.parquet(f"{path}/vectors")
    dim = F.lit(None if projection is None else projection[0]).cast("int")
    size = store.select(F.size("vec").alias("dim")).limit(1)
    own = dataset_print(keys).join(F.broadcast(size), F.lit(True)).withColumn("dim", F.coalesce(dim, F.col("dim"))).withColumn("shuffle_seed", F.lit(shuffle_seed).cast("long"))
    own.coalesce(1).write.parquet(f"{path}/manifest")
    return loci.sparkSession.read.parquet(f"{path}/manifest")


def dataset_print(loci: DataFrame) -> DataFrame:
    """One row (n_loci, print, total) that tells the set of loci from any other."""
    return fingerprint(loci.select("locus_key").distinct(), ["locus_key"], []).withColumnRenamed("n", "n_loci")


def load_materialised(loci: DataFrame, path: str) -> DataFrame:
    """The vectors in path; fails if they were written for other loci."""
    spark = loci.sparkSession
    held = spark.read.parquet(f"{path}/manifest").select("n_loci", "print", "total").first()
    if held != dataset_print(loci).first():
        raise ValueError(f"{path} was written for another set of loci")
    return spark.read.parquet(f"{path}/vectors")


def as_features(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(column))
