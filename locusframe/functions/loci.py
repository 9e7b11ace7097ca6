"""Locus keys: contig code in the upper 32 bits, 1-based position in the lower; and seeded hash draws."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AUTOSOMES = 22


def contig_code(name: Column) -> Column:
    """1 to 22, X 23, Y 24, with or without `chr`; null for any other contig."""
    bare = F.regexp_replace(name, "^chr", "")
    number = F.when(F.rlike(bare, F.lit("^[1-9][0-9]?$")), bare.cast("int"))
    return F.when(bare == "X", AUTOSOMES + 1).when(bare == "Y", AUTOSOMES + 2).when(number <= AUTOSOMES, number).cast("long")


def make_key(code: Column, pos: Column) -> Column:
    """The key of a contig code and a position; null unless both are in range."""
    fits = code.between(1, AUTOSOMES + 2) & (pos > 0) & (pos < (1 << 32))
    return F.when(fits, F.shiftleft(code.cast("long"), 32).bitwiseOR(pos.cast("long")))


def strict_key(code: Column, pos: Column) -> Column:
    """make_key that fails the job on an unknown contig or a position out of range."""
    key = make_key(code, pos)
    return F.coalesce(key, F.raise_error(F.concat(F.lit("no locus key for contig "), F.coalesce(code.cast("string"), F.lit("null")), F.lit(" position "), F.coalesce(pos.cast("string"), F.lit("null")))).cast("long"))


def key_code(key: Column) -> Column:
    return F.shiftright(key, 32)


def key_position(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0xFFFFFFFF))


def random_positions(lengths: DataFrame, n: int, seed: int) -> DataFrame:
    """Distinct locus_key of n draws over contigs (code, length), each position of the whole as likely as any other. lengths has a row for each contig."""
    before = F.coalesce(F.sum("length").over(W.orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = lengths.withColumn("before", before).agg(F.array_sort(F.collect_list(F.struct("before", "code"))).alias("ranges"), F.sum("length").alias("whole"))
    slots = lengths.sparkSession.range(n).join(F.broadcast(ranges), F.lit(True))
    at = F.pmod(draw(f"{seed}-high", F.col("id")) * (1 << 20) + F.pmod(draw(f"{seed}-low", F.col("id")), F.lit(1 << 20)), F.col("whole"))
    hit = slots.withColumn("at", at).withColumn("hit", F.element_at(F.filter("ranges", lambda r: r["before"] <= F.col("at")), -1))
    return hit.select(make_key(F.col("hit.code"), F.col("at") - F.col("hit.before") + 1).alias("locus_key")).distinct()


def draw(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 2^32) from the seed and the parts, the same on every engine with md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draws(seed: int | str, firsts: Iterable[object], tails: Iterable[str]) -> np.ndarray:
    """draw(seed, first, rest) inside a task, a row for each tail and a column for each first; a tail is the rest with `|` before each part."""
    heads, tails = [f"{seed}|{x}".encode() for x in firsts], [t.encode() for t in tails]
    found = b"".join([md5(h + t).digest()[:4] for t in tails for h in heads])
    return np.frombuffer(found, ">u4").astype(np.int64).reshape(len(tails), len(heads))


def uniform(seed: int | str, *parts: Column) -> Column:
    return draw(seed, *parts) / float(1 << 32)
