"""Fragment calls: decoding alignments, merging mates, filters, validity, geometry and fragment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import draw, make_key
from .intervals import carry

BAD_FLAGS = 0x4 | 0x100 | 0x200 | 0x400 | 0x800


def alignment_reason(flag: Column, mapq: Column, code: Column, min_mapq: int) -> Column:
    improper = (flag.bitwiseAND(1) != 0) & (flag.bitwiseAND(2) == 0)
    return F.when(flag.bitwiseAND(BAD_FLAGS) != 0, "bad_flag").when(mapq < min_mapq, "low_mapq").when(code.isNull(), "other_contig").when(improper, "improper_pair").otherwise("kept")


def decode_calls(reads: DataFrame) -> DataFrame:
    """reads (code, pos 0-based, cigar, xm, xg and ids) to one row for each Z or z of xm on an aligned base: locus_key, state, read_pos.

    Insertions and soft clips use up read bases without a place on the reference, so calls in them are dropped; deletions
    and skips move the reference alone. Bottom-strand reads name the base before, the forward C.
    """
    ops = F.regexp_extract_all("cigar", F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(1))
    kinds = F.regexp_extract_all("cigar", F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(2))

    def step(acc: Column, op: Column) -> Column:
        size = op["n"].cast("int")
        aligned = op["k"].isin("M", "=", "X")
        block = F.array(F.struct(acc["q"].alias("q"), acc["r"].alias("r"), size.alias("n")))
        return F.struct(
            (acc["q"] + F.when(op["k"].isin("M", "=", "X", "I", "S"), size).otherwise(0)).alias("q"),
            (acc["r"] + F.when(op["k"].isin("M", "=", "X", "D", "N"), size).otherwise(0)).alias("r"),
            F.when(aligned, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
        )

    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<q:int,r:int,n:int>>").alias("blocks"))
    blocks = F.aggregate(F.arrays_zip(ops.alias("n"), kinds.alias("k")), zero, step, lambda acc: acc["blocks"])
    marked = reads.withColumn("blocks", blocks).select("*", F.posexplode(F.split("xm", "")).alias("read_pos", "mark")).where("mark in ('Z', 'z')")
    placed = marked.withColumn("block", F.get(F.filter("blocks", lambda b: (F.col("read_pos") >= b["q"]) & (F.col("read_pos") < b["q"] + b["n"])), F.lit(0))).where("block is not null")
    base = F.col("pos") + F.col("block.r") + F.col("read_pos") - F.col("block.q") + F.when(F.col("xg") == "CT", 1).otherwise(0)
    return placed.withColumn("locus_key", make_key(F.col("code"), base)).withColumn("state", F.when(F.col("mark") == "Z", 1).otherwise(0)).drop("blocks", "block", "mark")


def five_prime(read_pos: Column, length: Column, flag: Column) -> Column:
    """Position from the read's 5' end: records of reverse reads are stored from their far end."""
    return F.when(flag.bitwiseAND(0x10) != 0, length - 1 - read_pos).otherwise(read_pos)


def merge_mates(calls: DataFrame) -> DataFrame:
    """(sample_id, fragment_id, locus_key, state, n): one call for each locus of a fragment; loci whose reads disagree are dropped."""
    merged = calls.groupBy("sample_id", "fragment_id", "locus_key").agg(F.min("state").alias("state"), F.max("state").alias("high"), F.count("*").alias("n"))
    return merged.where("state = high").drop("high")


def mate_stats(calls: DataFrame) -> DataFrame:
    """One row: fragments, calls, loci called by both mates, and conflicts."""
    merged = calls.groupBy("sample_id", "fragment_id", "locus_key").agg(F.min("state").alias("low"), F.max("state").alias("high"), (F.min("mate") != F.max("mate")).alias("both"))
    each = merged.groupBy("sample_id", "fragment_id").agg(F.count("*").alias("calls"), F.count_if("both").alias("both_mates"), F.count_if(F.col("low") != F.col("high")).alias("conflicts"))
    named = F.col("sample_id").isNotNull() & F.col("fragment_id").isNotNull()
    return each.agg(F.count_if(named).alias("fragments"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "both_mates", "conflicts")))


def by_lifted_position(calls: DataFrame, status: DataFrame, by: list[str]) -> DataFrame:
    """calls at their kept targets, with `rank`: the place by target within a fragment. Liftover may turn their order around."""
    return carry(calls, status).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("locus_key")))


def filter_calls(calls: DataFrame, keep: DataFrame) -> DataFrame:
    return calls.join(keep.select("locus_key").distinct(), "locus_key", "left_semi")


def filter_stats(calls: DataFrame, keep: DataFrame) -> DataFrame:
    """One row: calls dropped by a filter on loci, and fragments that it empties."""
    held = keep.select("locus_key").distinct().withColumn("held", F.lit(1))
    each = calls.join(held, "locus_key", "left").groupBy("sample_id", "fragment_id").agg(F.count("*").alias("n"), F.count("held").alias("left_over"))
    return each.agg(F.sum(F.col("n") - F.col("left_over")).alias("calls_dropped"), F.count_if(F.col("left_over") == 0).alias("fragments_emptied"))


def valid_calls(calls: DataFrame, min_cpgs: int, max_cpgs: int) -> DataFrame:
    """calls of fragments with min_cpgs calls or more, the first max_cpgs by position, with `rank` from 1 and `n` of the fragment."""
    own = W.partitionBy("sample_id", "fragment_id")
    df = calls.withColumn("n", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("locus_key")))
    return df.where((F.col("n") >= min_cpgs) & (F.col("rank") <= max_cpgs))


def geometry(calls: DataFrame) -> DataFrame:
    """calls with log distance from the fragment's first call and from the call before, and relative rank."""
    own = W.partitionBy("sample_id", "fragment_id")
    order = own.orderBy("locus_key")
    first, before = F.min("locus_key").over(own), F.lag("locus_key").over(order)
    rank = (F.row_number().over(order) - 1) / F.greatest(F.count("*").over(own) - 1, F.lit(1))
    return calls.select("*", (F.log1p(F.col("locus_key") - first) / 7).alias("from_first"), (F.log1p(F.coalesce(F.col("locus_key") - before, F.lit(0))) / 7).alias("from_prev"), rank.alias("rel_rank"))


def heldout(loci: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The loci that a seeded hash puts into the held-out share."""
    return loci.select("locus_key").distinct().where(draw(seed, F.col("locus_key")) < int(fraction * (1 << 32)))


def fragments_touching(calls: DataFrame, loci: DataFrame, mode: str = "exclude") -> DataFrame:
    """(sample_id, fragment_id) of fragments with no call on loci (exclude) or with one (only)."""
    hit = calls.join(loci.select("locus_key"), "locus_key", "left_semi").select("sample_id", "fragment_id").distinct()
    every = calls.select("sample_id", "fragment_id").distinct()
    return every.join(hit, ["sample_id", "fragment_id"], {"exclude": "left_anti", "only": "left_semi"}[mode])


def read_stats(calls: DataFrame, min_cpgs: int, max_cpgs: int) -> DataFrame:
    """Per sample: fragments, valid ones, and mean calls of a valid one, capped at max_cpgs."""
    each = calls.groupBy("sample_id", "fragment_id").agg(F.count("*").alias("n"))
    valid = F.col("n") >= min_cpgs
    return each.groupBy("sample_id").agg(F.count("*").alias("n_fragments"), F.count_if(valid).alias("n_valid"), F.avg(F.when(valid, F.least("n", F.lit(max_cpgs)))).alias("mean_cpgs"))


def size_histogram(calls: DataFrame, kmax: int) -> DataFrame:
    """(n_cpg, n, p): fragments by number of calls, kmax and more in one bin."""
    each = calls.groupBy("sample_id", "fragment_id").agg(F.least(F.count("*"), F.lit(kmax)).alias("n_cpg"))
    return each.groupBy("n_cpg").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))


def threshold_table(calls: DataFrame, most: int = 5) -> DataFrame:
    """For each threshold from 1 to most: fragments with so many calls, their calls, shares of all, mean size, states and stored bytes."""
    each = calls.groupBy("sample_id", "fragment_id").agg(F.count("*").alias("n"), F.sum("state").alias("up"))
    counted = each.groupBy("n", "up").agg(F.count("*").alias("f"))  # a small table of sizes and methylated counts
    by = counted.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most)).cast("int"))).alias("threshold"))
    total = by.groupBy("threshold").agg(
        F.sum("f").alias("fragments"),
        F.sum(F.col("f") * F.col("n")).alias("calls"),
        F.sum(F.col("f") * F.col("up")).alias("up"),
        F.sum(F.when(F.col("up") == F.col("n"), F.col("f")).otherwise(0)).alias("full_up"),
        F.sum(F.when(F.col("up") == 0, F.col("f")).otherwise(0)).alias("full_down"),
    )
    every = W.partitionBy()
    return total.select(
        "threshold", "fragments", "calls",
        (F.col("fragments") / F.max("fragments").over(every)).alias("fragment_share"), (F.col("calls") / F.max("calls").over(every)).alias("call_share"),
        (F.col("calls") / F.col("fragments")).alias("mean_cpgs"), (100 * F.col("up") / F.col("calls")).alias("pct_up"),
        (F.col("full_up") / F.col("fragments")).alias("fully_up"), (F.col("full_down") / F.col("fragments")).alias("fully_down"), (5 * F.col("calls") + 8 * (F.col("fragments") + 1)).alias("bytes"),
    )


def fixed_subset(items: DataFrame, group: str, item: str, k: int, seed: int) -> DataFrame:
    """The k items of each group that a seeded hash puts first; all of a smaller group."""
    order = W.partitionBy(group).orderBy(draw(seed, F.col(group), F.col(item)), item)
    return items.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def mbias(calls: DataFrame, read: str = "mate", pos: str = "read_pos") -> DataFrame:
    """(read, pos, n, up, pct): methylation by position in the read."""
    return calls.groupBy(F.col(read).alias("read"), F.col(pos).alias("pos")).agg(F.count("*").alias("n"), F.sum("state").alias("up")).withColumn("pct", 100 * F.col("up") / F.col("n"))


def plateau(profile: DataFrame, low: int, high: int) -> DataFrame:
    """(read, plateau): median percentage over a range of positions."""
    return profile.where(F.col("pos").between(low, high)).groupBy("read").agg(F.median("pct").alias("plateau"))


def first_deviation(profile: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """(read, abs_dev, signed_dev, first_dev): how far the first k positions lie from the plateau."""
    order = W.partitionBy("read").orderBy("pos")
    head = profile.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).join(level, "read").withColumn("d", F.col("pct") - F.col("plateau"))
    return head.groupBy("read").agg(F.avg(F.abs("d")).alias("abs_dev"), F.avg("d").alias("signed_dev"), F.min_by("d", "at").alias("first_dev"))
