"""Hard negatives by Kronecker-packed products: several candidates' components share one wide integer.

Components are integers. A candidate's are biased to be non-negative, and those of several candidates are put into separate
fields of one number; its product with an anchor's component multiplies all fields at once, and the sums over the
components are unpacked exactly, since a field is wide enough for the largest sum. Numbers are doubles while all fields fit
into their 53 bits, so that a product is one matrix multiplication; wider ones are whole numbers without a bound.

Anchors go through the table in blocks of a fixed size, each block broadcast. A task keeps its best rows for each anchor, and
the tasks' best are ranked by anchor: first the positives, then, between each positive's bounds, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stored

BLOCK = 4096  # anchors that are broadcast at once
TILE = 1 << 22  # scores that are held at once
MANTISSA = 53


def pack(rows: np.ndarray, bias: int, bits: int, fields: int) -> np.ndarray:
    """rows (candidates x components, whole numbers as objects if wider than a double's) biased and packed: column j holds candidates fields * j, fields * j + 1, ... from the lowest field on."""
    short = -len(rows) % fields
    biased = np.concatenate([rows + bias, np.zeros((short, rows.shape[1]), rows.dtype)]).reshape(-1, fields, rows.shape[1])
    packed = sum((biased[:, f] * (1 << bits * f) for f in range(1, fields)), biased[:, 0])
    return packed.T if rows.dtype == object else packed.T.astype(float)


def unpack(product: np.ndarray, bits: int, fields: int, count: int) -> np.ndarray:
    """The sums in the fields of product (anchors x packed candidates), as anchors x candidates."""
    whole = product if product.dtype == object else product.astype(np.int64)
    out = np.stack([(whole >> bits * f) & ((1 << bits) - 1) for f in range(fields)], axis=2)
    return out.reshape(len(product), -1)[:, :count]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer anchors and rows, both biased to be non-negative, by packed products."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    bias_a, bias = max(0, -int(anchors.min())), max(0, -int(rows.min()))
    top_a, top = int(anchors.max()) + bias_a, int(rows.max()) + bias
    bits = max(1, (rows.shape[1] * top_a * top).bit_length())
    fields = max(1, MANTISSA // bits)
    wide = object in (anchors.dtype, rows.dtype) or bits > MANTISSA or rows.shape[1] * (top_a + bias_a) * (top + bias) >= 1 << 62
    own = anchors.astype(object) if wide else anchors
    mine = rows.astype(object) if wide else rows
    lifted = own + bias_a
    product = lifted @ pack(mine, bias, bits, fields) if wide else (lifted.astype(float) @ pack(mine, bias, bits, fields))
    both = unpack(product, bits, fields, len(rows))
    # (a + A)(x + B) summed is the wanted sum and A times the biased row and B times the anchor.
    exact = both - bias_a * (mine + bias).sum(axis=1)[None, :] - bias * own.sum(axis=1)[:, None]
    if wide:
        exact = np.clip(exact, np.iinfo(np.int64).min, np.iinfo(np.int64).max)
    return exact.astype(np.int64)


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) for the rows of vectors that take part: v holds floor(scale * component) as doubles.

    A row needs a vec_id, a label and a non-empty vector of finite components. Where vec_id is divisible by 7, label becomes
    (label + 1) % 10. Of rows that share a vec_id the one with the smallest label, then vector, counts.
    """
    usable = "vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Scaling by a power of two is exact in doubles; floor() would narrow to a long.
    parts = F.transform("embedding", lambda x: F.rint(x.cast("double") * scale - F.lit(0.5)))
    floored = F.zip_with(parts, F.col("embedding"), lambda r, x: F.when(r > x.cast("double") * scale, r - 1).when(r + 1 <= x.cast("double") * scale, r + 1).otherwise(r))
    rows = vectors.where(usable).select("vec_id", label.cast("int").alias("label"), floored.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _best(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, score, id) of each line's `count` highest allowed scores, ties by smaller id."""
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, score, low)
    least = np.partition(masked, max(0, score.shape[1] - count), axis=1)[:, max(0, score.shape[1] - count)]
    line, at = np.nonzero((masked >= least[:, None]) & allowed)
    return _first(line, masked[line, at], ids[at], count)


def _first(line: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, line))
    line, score, ids = line[order], score[order], ids[order]
    place = np.arange(len(line)) - np.searchsorted(line, line, "left")
    kept = place < count
    return line[kept], score[kept], ids[kept]


def _ints(column: pa.Array) -> np.ndarray:
    """Rows of equal length as integers: 64 bits if all fit, else whole numbers without a bound."""
    flat = np.asarray(column.flatten())
    return (flat.astype(np.int64) if np.abs(flat).max() < 2**62 else np.array([int(x) for x in flat], object)).reshape(len(column), -1)


def _nearest(rows: DataFrame, anchors: list[tuple], bounds: np.ndarray | None, count: int, percent: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, other_id, score): each anchor's best `count` rows of a task.

    anchors: (vec_id, label, vector). Without bounds these are rows of its label, the anchor left out. Else bounds holds for each
    anchor and positive (anchor's place, positive_id, positive_score), and rows are of another label with a score within
    percent of the positive's and its whole.
    """
    ids, labels = (np.array([a[i] for a in anchors], np.int64) for i in (0, 1))
    vectors = [a[2] for a in anchors]
    spread = rows.sparkSession.sparkContext.broadcast((ids, labels, vectors, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, bounds = spread.value
        sizes = np.array([len(v) for v in vectors])
        lines = np.stack([np.arange(len(ids)), ids * 0, ids * 0], axis=1) if bounds is None else bounds
        held = [(np.zeros(0, np.int64),) * 3]
        for b in batches:
            dims = np.asarray(b.column(2).value_lengths())
            for dim in np.unique(dims):
                own = np.nonzero(dims == dim)[0]
                part = b.take(pa.array(own))
                x, other, label = _ints(part.column(2)), np.asarray(part.column(0)), np.asarray(part.column(1))
                step = max(1, TILE // len(own))
                mine = np.nonzero(sizes[lines[:, 0]] == dim)[0]
                for at in range(0, len(mine), step):
                    line = mine[at : at + step]
                    places, back = np.unique(lines[line, 0], return_inverse=True)
                    a = _ints(pa.array([vectors[p] for p in places], pa.list_(pa.float64())))
                    score = scores(a, x)[back]
                    same = labels[lines[line, 0]][:, None] == label[None, :]
                    if bounds is None:
                        allowed = same & (ids[lines[line, 0]][:, None] != other[None, :])
                    else:
                        most = lines[line, 2][:, None]
                        allowed = ~same & (score <= most) & (score >= -(-percent * most // 100))
                    k, s, o = _best(score, allowed, other, count)
                    held.append((line[k], s, o))
            held = [_first(*(np.concatenate(c) for c in zip(*held)), count)]
        line, score, other = held[0]
        own = lines[line]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[own[:, 0]], own[:, 1], own[:, 2], other, score)], names=["anchor_id", "positive_id", "positive_score", "other_id", "score"])

    return rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, other_id long, score long")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, all exact, over all of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`. An anchor's positives are its first rows of the same label,
    itself left out; for each, the negatives are the first rows of another label that score between percent of the
    positive's score and its whole: highest scores first, ties by smaller vec_id. Which rows take part, and how labels and
    components are changed first, is told at integer_rows; vectors of different lengths do not meet. An anchor without
    positives and a positive without negatives have no rows. A score beyond 64 bits becomes the nearest one within. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    pair = ["anchor_id", "positive_id"]
    order = [F.desc("score"), "other_id"]
    with scratch(spark) as kept:
        rows, _ = stored(integer_rows(vectors))
        anchors = rows.where(F.col("vec_id") % every == 0)
        blocks = max(1, -(-anchors.count() // BLOCK))
        found = []
        for block in range(blocks):
            own = sorted(map(tuple, anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()))
            if not own:
                continue
            near = _nearest(rows, own, None, positives, percent).withColumn("rank", F.row_number().over(W.partitionBy("anchor_id").orderBy(*order))).where(F.col("rank") <= positives)
            place = {a[0]: i for i, a in enumerate(own)}
            bounds = np.array([(place[r[0]], r[1], r[2]) for r in near.select("anchor_id", "other_id", "score").collect()], np.int64).reshape(-1, 3)  # positives of one block
            best = _nearest(rows, own, bounds, negatives, percent).withColumn("rank", F.row_number().over(W.partitionBy(*pair).orderBy(*order)))
            part, path = stored(best.where(F.col("rank") <= negatives).select(*pair, "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
            kept.add(path)
            found.append(part)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, found, empty)


ORACLE_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
 FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id,
 positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5"""
