"""Importance resampling towards a target: hashed word counts give each text a weight, and seeded Gumbel scores are drawn from.

Gains of buckets are an array of a fixed size; a text's weight is the mean of its words' gains. The k highest scores are found
by a distributed quickselect on composite keys: random pivots, exact counts of the keys before, at and after each, and on with
the range that holds the k-th. Only the winners are sorted, in ranges, and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_words import ALPHANUMERIC, pieces, split_words
from .common import scratch, stored

PIVOTS = 64


def _features(texts: pa.Array, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of runs of 1 to `length` consecutive words in each text, the runs' buckets text by text and length by length)."""
    counts, words = split_words(texts, ALPHANUMERIC)
    coded = words.dictionary_encode()
    own = np.asarray(coded.indices, np.int64)
    distinct = [w.as_buffer() for w in coded.dictionary]
    found = np.array([zlib.crc32(w) for w in distinct], np.int64)[own] % buckets if len(own) else np.zeros(0, np.int64)
    if length == 1:
        return counts, found
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(own))  # words from here to the text's end
    text = np.repeat(np.arange(len(counts)), counts)
    code, owner = [found], [text]
    raw = [bytes(w) for w in distinct]
    for n in range(2, length + 1):
        starts = np.nonzero(left >= n)[0]
        code.append(np.array([zlib.crc32(b" ".join([raw[w] for w in own[at : at + n]])) % buckets for at in starts], np.int64))
        owner.append(text[starts])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.bincount(owner, minlength=len(counts)), np.concatenate(code)[order]


def bucket_counts(texts: DataFrame, length: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows' `text` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, 0):
            total += np.bincount(_features(b.column(0), length, buckets)[1], minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and raw shares, each bucket smoothed by one, rounded down."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, length: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight and print for every row of docs: the mean gain of its features, rounded down, and a
    hash of its text, which tells rows of equal doc_id apart."""
    spread = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            counts, found = _features(b.column(2), length, len(spread.value))
            upto = np.concatenate([[0], np.cumsum(spread.value[found])])
            ends = np.cumsum(counts)
            weight = (upto[ends] - upto[ends - counts]) // np.maximum(counts, 1)
            words = counts if length == 1 else split_words(b.column(2), ALPHANUMERIC)[0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(weight)], names=["doc_id", "print", "n_words", "n_features", "weight"])

    schema = "doc_id long, print long, n_words long, n_features long, weight long"
    return docs.select("doc_id", F.xxhash64("text").alias("print"), "text").mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel deviate that follows from seed and doc_id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(keys: DataFrame, order: list[str], k: int, seed: int = 12, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest of keys (longs, compared column by column), counted with repeats; None if there are fewer than k.

    A round draws up to `pivots` different keys at random from the range left and counts the keys below and at each. It ends
    at a pivot with the k-th among its equals, else goes on between two pivots. A range of n keys takes about
    log n / log pivots rounds, each a scan of the keys with partial counts; a third of all keys may be equal.
    """
    key = F.struct(*order)
    point = lambda p: F.struct(*(F.lit(int(x)).cast("long").alias(c) for c, x in zip(order, p, strict=True)))
    low, high = None, None
    if not 0 < k <= keys.count():
        return None
    for round_ in range(200):
        left = keys if low is None else keys.where(key > point(low))
        left = left if high is None else left.where(key < point(high))
        # Keys are dealt to classes by a seeded hash and each class gives the least key of another: equal keys are one pivot.
        dealt = left.groupBy(F.pmod(F.xxhash64(F.lit(seed + round_), *order), F.lit(pivots)))
        drawn = dealt.agg(F.min(F.struct(F.xxhash64(F.lit(-seed - round_), *order), *order)).alias("p")).select(*(f"p.{c}" for c in order)).collect()
        tried = sorted(tuple(r) for r in drawn)
        counts = keys.agg(*(F.count_if(op) for p in tried for op in (key < point(p), key == point(p)))).first()
        for i, p in enumerate(tried):
            below, at = counts[2 * i], counts[2 * i + 1]
            if below >= k:
                high = p
                break
            if below + at >= k:
                return p
            low = p
    raise RuntimeError("quickselect did not end")


def ranked(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with `rank` 1, 2, 3 ... by order: ranges are sorted on their own and shifted by the sizes of those before them."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut, _ = stored(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = cut.groupBy("__part").count()
    before = sizes.withColumn("__before", F.sum("count").over(W.orderBy("__part")) - F.col("count")).select("__part", "__before")  # a row for each range
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)).cast("long")
    return cut.join(F.broadcast(before), "__part").withColumn("rank", place + F.col("__before")).drop("__part", "__before")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, length: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of docs (doc_id, text), drawn towards target (text).

    A-Z become lower case; words are runs of 0-9, a-z and characters beyond ASCII. Features are all runs of 1 to `length`
    words. Of the N rows with a doc_id and least_words words or more, floor(percent * N / 100) are drawn: highest scores
    first, ties by doc_id, then by a hash of the text. Other rows have a null rank. Null and empty texts have no features
    and weight 0. Rows without doc_id count as corpus, have a null score and are never drawn. Repeated rows stay repeated
    and are drawn one by one. An empty target leaves weights to the corpus's own shares; an empty docs gives an empty
    result. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as kept:
        gains = bucket_gains(bucket_counts(docs, length, buckets), bucket_counts(target, length, buckets))
        rows = weighed(docs, gains, length).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        rows, path = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        kept.add(path)
        keys = rows.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()).select((-F.col("score")).alias("less"), "doc_id", "print", "row")
        order = ["less", "doc_id", "print"]
        wanted = keys.count() * percent // 100
        last = kth_key(keys, order, wanted, seed)
        won = keys.where(F.lit(False) if last is None else F.struct(*order) <= F.struct(*(F.lit(int(x)).cast("long").alias(c) for c, x in zip(order, last, strict=True))))
        # Rows equal to the last in all of the key may be one too many: the row number settles which of them are drawn.
        drawn, path = stored(ranked(won, [*order, "row"]).where(F.col("rank") <= wanted).select("row", "rank"))
        kept.add(path)
    return rows.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
