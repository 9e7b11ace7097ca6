"""Embedding near-duplicates by collision counting over one-dimensional random projections.

Every vector is projected on many fixed directions. Two vectors collide on a direction if their projections differ by at
most a window; pairs that collide on enough directions are verified by cosine. Window and count are set so that a pair at
the threshold is missed with a stated probability.

Vectors of a label of twice cell_rows rows or more meet in cells: a cell is the signs of a few other projections, a vector
lies in one cell of each of several tables, and the tables are so many that a pair shares a cell but for a part of the
stated chance. Bits follow the logarithm of the label's size, so a vector is sent to as many tables as that asks for, not to
a share of its label. A pair counts in the first table that it shares a cell of. A dense cell is cut into units of a bounded
size, and a unit meets itself and the cell's earlier units, a run of at most RUN units at a time. In a group every
projection is sorted, and a vector's windows become ranges of ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, scratch, spread, stored
from .simhash_dedup import Forest

RUN = 8  # earlier units that a unit meets in one group
PAIRS = 1 << 20  # candidates that are verified at once
MISSED = 1e-4  # chance that a pair right at the threshold collides too rarely or shares no cell
MOST_BROADCAST = 100_000  # dense cells


def directions(dim: int, count: int, seed: int = 4) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count))


def calibrate(threshold: float, count: int, missed: float = MISSED) -> tuple[float, int]:
    """(window, collisions needed): a pair at the threshold collides so often on `count` directions but for a chance of `missed`.

    Projections of unit vectors at cosine c differ by a normal deviate of variance 2 - 2c. The window is two and a half of
    its standard deviations; the needed count is the largest whose binomial tail is within `missed`.
    """
    width = 2.5 * math.sqrt(2 - 2 * threshold)
    p = math.erf(2.5 / math.sqrt(2))
    below, need = 0.0, 0
    for k in range(count + 1):
        below += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if below > missed:
            need = k
            break
    return width, need


def cell_bits(rows: int, cell_rows: int) -> int:
    """Signs that tell the cells of a label apart: its cells would have cell_rows to twice as many rows each, were they equal."""
    return max(0, (rows // cell_rows).bit_length() - 1)


def cell_tables(bits: int, threshold: float, count: int, missed: float = MISSED) -> int:
    """Tables of cells of so many signs such that a pair at the threshold shares none, or collides too rarely, with a chance of `missed`.

    Two vectors at cosine c lie on the same side of a random plane with a chance of 1 - acos(c) / pi.
    """
    if not bits:
        return 1
    need = calibrate(threshold, count, missed)[1]
    p = math.erf(2.5 / math.sqrt(2))
    rare = sum(math.comb(count, k) * p**k * (1 - p) ** (count - k) for k in range(need))
    left = max(missed - rare, missed / 100)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(left) / math.log(1 - same))


def cells(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table, as a number of `bits` bits."""
    signs = (unit @ directions(unit.shape[1], bits * tables, 5) > 0).reshape(len(unit), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2)


def candidate_pairs(proj: np.ndarray, home: np.ndarray, width: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (i, j), each pair once, of a home row j and any other row i that collide on at least `need` of proj's columns.

    Every column is sorted once. A home row's window in it is a range of ranks, so all rows' collisions with that row are
    counted by a comparison of ranks for each column.
    """
    n, columns = proj.shape
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    homes = np.nonzero(home)[0]
    ranks, low, span = np.empty((columns, n), kind), np.empty((columns, len(homes)), kind), np.empty((columns, len(homes)), kind)
    for c in range(columns):
        order = np.argsort(proj[:, c], kind="stable")
        ranks[c, order] = np.arange(n)
        line = proj[order, c]
        start = np.searchsorted(line, proj[homes, c] - width, "left")
        low[c], span[c] = start, np.searchsorted(line, proj[homes, c] + width, "right") - start - 1
    past, inside, count = np.empty(n, kind), np.empty(n, bool), np.empty(n, np.uint8)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for k, h in enumerate(homes):
        count.fill(0)
        for c in range(columns):
            np.subtract(ranks[c], low[c, k], out=past)  # ranks below the window wrap around to large numbers
            np.less_equal(past, span[c, k], out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        found = np.nonzero(count >= need)[0]
        found = found[(found < h) | ~home[found]]  # pairs of two home rows count once
        held.append((found, np.full(len(found), h)))
        size += len(found)
        if size > PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, count: int = 16, cell_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have the same length and their cosine, in double
    precision, is at least threshold. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Rows with equal label and vector are one point with a multiplicity, so repeated rows are links of each other
    but never all pairs of rows. component_id is the smallest vec_id reachable; rows without vec_id link and count, but
    name no component, and where they link with nothing their component_id is null. An empty table gives an empty result.
    """
    valid = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(F.expr(valid), F.lit(False)).alias("valid"))
    keyed = rows.withColumn("point", F.when(F.col("valid"), F.xxhash64("label", "embedding")))
    with scratch(vectors.sparkSession) as kept:
        named, path = _named_points(keyed, threshold, count, cell_rows)
        kept.add(path)
    low = named.groupBy("root").agg(F.min("least").alias("low"))
    info = named.join(low, "root").select("point", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low")
    linked = keyed.where("valid").select("vec_id", "point").join(info, "point").select("vec_id", "n_links", F.col("low").alias("component_id"))
    alone = keyed.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _named_points(keyed: DataFrame, threshold: float, count: int, cell_rows: int) -> tuple[DataFrame, str]:
    """(point, n, least, links, root), stored, for every distinct valid vector; and the table's path."""
    width, need = calibrate(threshold, count)
    points = keyed.where("valid").groupBy("label", "embedding").agg(F.first("point").alias("point"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    points, _ = stored(points.withColumn("dim", F.size("embedding")))
    sets = ["label", "dim"]
    kind = dict(points.dtypes)["label"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(1))
            bits = np.array([cell_bits(int(r), cell_rows) for r in np.asarray(b.column(5))], int)
            found: list[np.ndarray | None] = [None] * b.num_rows
            for dim, k in set(zip(dims.tolist(), bits.tolist())):
                own = np.nonzero((dims == dim) & (bits == k))[0]
                x = np.asarray(b.column(4).take(pa.array(own)).flatten()).reshape(len(own), dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                for i, c in zip(own, cells(x / np.linalg.norm(x, axis=1, keepdims=True), k, cell_tables(k, threshold, count))):
                    found[i] = c.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(found, pa.list_(pa.int32()))], names=[*sets, "point", "n", "embedding", "cells"])

    sized = points.groupBy(*sets).agg(F.count("*").alias("rows"))
    wide = points.join(sized, sets).select(*sets, "point", "n", "embedding", "rows")
    placed, _ = stored(wide.mapInArrow(place, f"label {kind}, dim int, point long, n long, embedding array<double>, cells array<int>"))
    where = [*sets, "table", "cell"]
    held = placed.select(*sets, F.posexplode("cells").alias("table", "cell")).groupBy(*where).agg(F.count("*").alias("held"))
    dense, _ = stored(held.select(*where, F.round(F.col("held") / cell_rows).cast("long").alias("slices")).where("slices > 1"))
    dense = F.broadcast(dense) if dense.count() <= MOST_BROADCAST else dense
    copies = placed.select(*sets, F.posexplode("cells").alias("table", "cell"), "point", "n", "embedding", "cells").join(dense, where, "left")
    own = copies.withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("at", F.expr("pmod(xxhash64(point), slices)"))
    meets = f"""concat(transform(sequence(0, at div {RUN}), r -> struct(at as unit, r as run, true as home)),
        if(at + 1 < slices, transform(sequence(at + 1, greatest(slices - 1, at + 1)), u -> struct(u as unit, at div {RUN} as run, false as home)), array()))"""
    dealt = own.select(*where, F.inline(F.expr(meets)), "point", "n", "embedding", "cells")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["point"], ignore_index=True)
        x = np.stack(part.embedding.to_numpy()).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        squares = (x * x).sum(axis=1)
        unit = x / np.sqrt(squares)[:, None]
        home, n, table = part.home.to_numpy(), part.n.to_numpy(), int(part.table[0])
        earlier = np.stack(part.cells.to_numpy())[:, :table]
        among = part.unit[0] // RUN == part.run[0]  # a unit's own pairs count in one of its groups
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        for i, j in candidate_pairs(unit @ directions(x.shape[1], count), home, width, need):
            if not among:
                across = ~(home[i] & home[j])
                i, j = i[across], j[across]
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                cos = np.einsum("ij,ij->i", x[a], x[b]) / np.sqrt(squares[a] * squares[b])
                a, b = a[cos >= threshold], b[cos >= threshold]
                fresh = ~(earlier[a] == earlier[b]).any(axis=1)  # else the pair was met in an earlier table
                a, b = a[fresh], b[fresh]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                forest.join(a, b)
        out = pd.DataFrame({"point": part.point, "links": links, "root": part.point.to_numpy()[forest.parent]})
        return out[(out.links > 0) | (out.root != out.point)]

    groups = [*where, "unit", "run"]
    found, _ = stored(spread(dealt, *groups).groupBy(*groups).applyInPandas(link, "point long, links long, root long"))
    counted = found.groupBy("point").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("point").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "point")
    named = points.select("point", "n", "least").join(counted, "point", "left").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point"))
    return stored(named)
