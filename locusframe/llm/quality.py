"""Quality rules: hard limits on repetition and length, then a log-likelihood ratio of hashed word n-grams.

Two multinomials over hashed one- and two-word n-grams are counted: a trusted target (a bounded set of labelled documents)
and the raw corpus (all of it). A document's score is the mean, over its n-grams, of the log ratio of the two, and one
threshold decides on every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, words

SCALE = 1000  # bucket weights are whole numbers of 1/SCALE nats, so sums don't depend on their order


def trusted_ids(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id of at most `most` documents labelled good and not toxic, taken in order of a hash of doc_id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _at(w: Column, i: Column) -> Column:
    return F.get(w, i)


def ngram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, prior: float = 1.5) -> DataFrame:
    """(bucket, weight): 1000 times the log ratio of each bucket's target and corpus shares, rounded.

    Both shares are raised by `prior` times the mean share of a bucket, so rare n-grams weigh little and a corpus repeated
    ten times has the same weights. Without trusted documents all weights are zero. trusted must be bounded: it is broadcast.
    """
    target = F.broadcast(trusted.select("doc_id", F.lit(1).alias("target")))
    split = docs.select("doc_id", words(F.col("text")).alias("w")).join(target, "doc_id", "left")
    following = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    pairs = split.select("target", F.inline(F.arrays_zip(F.col("w").alias("a"), following.alias("b"))))
    pair = F.when(F.col("b").isNotNull(), _bucket(F.col("a"), F.col("b"), buckets=buckets))
    grams = pairs.select("target", F.explode(F.array(_bucket(F.col("a"), buckets=buckets), pair)).alias("bucket")).where("bucket is not null")
    counted = grams.groupBy("bucket").agg(F.count("*").alias("r"), F.count("target").alias("t"))
    everything = W.partitionBy()  # of at most `buckets` rows
    all_r, all_t = F.sum("r").over(everything), F.sum("t").over(everything)
    share = F.col("r") / all_r
    ratio = (F.coalesce(F.try_divide(F.col("t"), all_t), share) + prior / buckets) / (share + prior / buckets)
    return counted.select("bucket", F.round(F.log(ratio) * SCALE).cast("int").alias("weight"))


def _repeated(w: Column, hashes: Column, again: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; hashes: of the windows; again: those that occur twice.

    Only windows whose hash occurs twice are compared as text; where many differ, all windows are.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["t"] == _at(s, i + 1)["t"]) | ((i > 0) & (x["t"] == _at(s, i - 1)["t"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    starts = F.sequence(F.lit(0), F.size(hashes) - 1)
    maybe = F.when(F.size(again) <= 64, F.filter(starts, lambda i: F.array_contains(again, _at(hashes, i)))).otherwise(starts)
    windows = F.transform(maybe, lambda i: F.struct(F.concat_ws(" ", _at(w, i), _at(w, i + 1), _at(w, i + 2)).alias("t"), i.alias("p")))
    return F.when(F.size(again) == 0, 0).otherwise(let(F.sort_array(windows), covered))


def quality_rules(docs: DataFrame, weights: DataFrame, buckets: int = 1 << 16, min_score: float = -0.1, name: str = "quality") -> DataFrame:
    """docs with a column `name`: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed,
    score (mean log ratio in nats, null without words) and kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept: not base_failed and score >= min_score.
    A null or empty text has no words and fails. Rows are judged one by one, so repeated rows and nulls in other columns
    change nothing; an existing column of that name is replaced. weights holds at most `buckets` rows and goes to the plan as
    one constant array. No row is shuffled. An empty table gives an empty result.
    """
    found = dict(weights.collect())
    table = F.split(F.lit(",".join(str(found.get(b, 0)) for b in range(buckets))), ",").cast("array<int>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    # Each step is a projection of its own: sorting longs is fast only outside of lambdas. g: hashes of word pairs; t: of
    # 3-word windows, mixed from two pairs; s: those that occur twice.
    w, g, t, s = (F.col(f"__quality_{x}") for x in "wgts")
    paired = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, _at(w, i + 1)))
    windows = F.transform(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), lambda x, i: x.bitwiseXOR(F.shiftleft(_at(g, i + 1), 1)))
    again = F.array_distinct(F.filter(s, lambda x, i: x == _at(s, i + 1)))
    df = docs.withColumn("__quality_w", words(F.col("text"))).withColumn("__quality_g", paired).withColumn("__quality_t", windows)
    df = df.withColumn("__quality_s", F.sort_array(t))
    df = df.withColumn("__quality_s", F.when(F.size(F.array_distinct(s)) < F.size(s), again).otherwise(F.slice(s, 1, 0)))
    zero = F.lit(0).cast("long")
    single = F.aggregate(w, zero, lambda acc, x: acc + F.get(table, _bucket(x, buckets=buckets)))
    double = F.aggregate(g, zero, lambda acc, x: acc + F.get(table, F.pmod(x, F.lit(buckets)).cast("int")))
    measured = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(w, t, s).cast("long").alias("n_repeat_words"),
        F.when(F.size(w) > 0, (single + double) / (SCALE * (2 * F.size(w).cast("long") - 1))).alias("score"),
    )

    def judge(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & F.coalesce(m["score"] >= min_score, F.lit(False))
        return F.struct(*(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), m["score"].alias("score"), kept.alias("kept"))

    # The row number keeps filters on the result above these steps; pushed down, they would repeat them many times over.
    out = df.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, let(measured, judge)))
    return out.drop(*(f"__quality_{x}" for x in "wgts"))
