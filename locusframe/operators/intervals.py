"""Liftover as a binned interval join, and the filters around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import key_code, key_position


def overlap_join(points: DataFrame, blocks: DataFrame, bin_width: int = 4096) -> DataFrame:
    """points (code, p) with every block (src_code, src_start, src_end) whose half-open range holds p; others once, with null block columns.

    Blocks are listed under each bin they touch, so the join is an equi-join on contig and bin; the result does not depend
    on bin_width.
    """
    listed = blocks.withColumn("bin", F.explode(F.sequence(F.expr(f"src_start div {bin_width}"), F.expr(f"(src_end - 1) div {bin_width}"))))
    binned = points.withColumn("bin", F.expr(f"p div {bin_width}"))
    on = (F.col("q.code") == F.col("b.src_code")) & (F.col("q.bin") == F.col("b.bin")) & F.col("q.p").between(F.col("b.src_start"), F.col("b.src_end") - 1)
    return binned.alias("q").join(listed.alias("b"), on, "left").select("q.*", *(F.col(f"b.{c}") for c in blocks.columns)).drop("bin")


def lift(keys: DataFrame, blocks: DataFrame, bin_width: int = 4096) -> DataFrame:
    """(locus_key, n_blocks, target) for the distinct locus_key of keys.

    One covering block lifts a key; none or several leave target null. On a minus-strand block the position counts from the
    block's far end, and the target is the base before, so that it names the forward C.
    """
    points = keys.select("locus_key").distinct().select("locus_key", key_code(F.col("locus_key")).alias("code"), (key_position(F.col("locus_key")) - 1).alias("p"))
    ranged = blocks.withColumn("src_end", F.col("src_start") + F.col("size"))
    off = F.col("p") - F.col("src_start")
    forward = F.col("dst_start") + off + 1
    backward = F.col("dst_start") + F.col("size") - 1 - off
    target = F.shiftleft(F.col("dst_code").cast("long"), 32).bitwiseOR(F.when(F.col("strand") > 0, forward).otherwise(backward))
    met = overlap_join(points, ranged, bin_width).withColumn("target", target)
    found = met.groupBy("locus_key").agg(F.count("src_start").alias("n_blocks"), F.min("target").alias("only"))
    return found.select("locus_key", "n_blocks", F.when(F.col("n_blocks") == 1, F.col("only")).alias("target"))


def lift_status(lifted: DataFrame, reference: DataFrame, stores: list[DataFrame] = ()) -> DataFrame:
    """lifted with `status`: unmapped, ambiguous, not_in_target, collision (a valid target of several keys), not_covered or kept.

    reference and each of stores have a column locus_key; not_covered keys lack an entry in some store.
    """
    known = reference.select(F.col("locus_key").alias("target")).distinct().withColumn("in_target", F.lit(True))
    # Keys without a target would all meet in one partition of the joins: they get no part in them.
    df = lifted.where("target is not null").join(known, "target", "left")
    df = df.withColumn("sources", F.count_if(F.col("in_target")).over(W.partitionBy("target"))).withColumn("covered", F.lit(True))
    for store in stores:
        held = store.select(F.col("locus_key").alias("target")).distinct().withColumn("held", F.lit(True))
        df = df.join(held, "target", "left").withColumn("covered", F.col("covered") & F.coalesce("held", F.lit(False))).drop("held")
    df = df.unionByName(lifted.where("target is null"), allowMissingColumns=True)
    status = F.when(F.col("n_blocks") == 0, "unmapped").when(F.col("n_blocks") > 1, "ambiguous").when(F.col("in_target").isNull(), "not_in_target").when(F.col("sources") > 1, "collision").when(~F.col("covered"), "not_covered").otherwise("kept")
    return df.select("locus_key", "n_blocks", "target", status.alias("status"))


def funnel(status: DataFrame) -> DataFrame:
    """One row of counts: input, lifted, and a column for each status."""
    names = ("unmapped", "ambiguous", "not_in_target", "collision", "not_covered", "kept")
    return status.agg(F.count("*").alias("n_input"), F.count_if(F.col("n_blocks") == 1).alias("lifted"), *(F.count_if(F.col("status") == s).alias(s) for s in names))


def carry(observations: DataFrame, status: DataFrame) -> DataFrame:
    """observations at their kept targets; the mapping was made once for all distinct keys."""
    kept = status.where("status = 'kept'").select("locus_key", "target")
    return observations.join(kept, "locus_key").drop("locus_key").withColumnRenamed("target", "locus_key")


def running_overlap(blocks: DataFrame) -> DataFrame:
    """blocks with `overlaps`: whether an earlier block of the contig reaches past its start."""
    ranged = blocks.withColumn("src_end", F.col("src_start") + F.col("size"))
    before = W.partitionBy("src_code").orderBy("src_start", "src_end", "block_id").rowsBetween(W.unboundedPreceding, -1)
    return ranged.withColumn("overlaps", F.coalesce(F.max("src_end").over(before) > F.col("src_start"), F.lit(False)))


def track_breadth(points: DataFrame, tracks: DataFrame, bin_width: int = 4096) -> DataFrame:
    """(locus_key, group, breadth): share of each group's tracks that cover a locus. tracks: track_id, group, src_code, src_start, src_end."""
    sizes = tracks.groupBy("group").agg(F.countDistinct("track_id").alias("tracks"))
    keyed = points.select("locus_key", key_code(F.col("locus_key")).alias("code"), (key_position(F.col("locus_key")) - 1).alias("p"))
    met = overlap_join(keyed, tracks, bin_width).where("track_id is not null").groupBy("locus_key", "group").agg(F.countDistinct("track_id").alias("n"))
    return met.join(sizes, "group").select("locus_key", "group", (F.col("n") / F.col("tracks")).alias("breadth"))


def missing_keys(wanted: DataFrame, have: DataFrame, key: str = "locus_key") -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def require_covered(loci: DataFrame, universe: DataFrame, key: str = "locus_key") -> DataFrame:
    """loci, if every key is in universe; else fails with their number and the first five."""
    n, first = missing_summary(loci, universe, key).first()
    if n:
        raise ValueError(f"{n} keys outside the store, first {first}")
    return loci


def missing_summary(loci: DataFrame, universe: DataFrame, key: str = "locus_key", most: int = 5) -> DataFrame:
    """One row (n, first): how many keys universe lacks, and the first few of them, joined by commas."""
    missing = missing_keys(loci, universe, key)
    first = missing.orderBy(key).limit(most).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("first"))
    return missing.agg(F.count("*").alias("n")).join(F.broadcast(first), F.lit(True))  # a row each


def merge_shards(base: DataFrame, extension: DataFrame, key: str = "locus_key") -> DataFrame:
    """The rows of two shards of a store; a key that is in both, or twice in one, fails."""
    both = base.unionByName(extension)
    checked = F.when(F.count("*").over(W.partitionBy(key)) == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("key in the shards twice: "), F.col(key))).cast("long"))
    return both.withColumn(key, checked)


def shard_report(base: DataFrame, extension: DataFrame, reference: DataFrame, key: str = "locus_key") -> DataFrame:
    """One row: keys of either shard, keys held twice, and what the merged keys and the reference do not share."""
    marked = base.select(key, F.lit(1).alias("b"), F.lit(0).alias("e")).union(extension.select(key, F.lit(0), F.lit(1)))
    per = marked.groupBy(key).agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
    both = per.join(reference.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return both.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_base"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_extension"), F.count_if(F.col("b") + F.col("e") > 1).alias("repeated"),
        F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("unexpected"),
    )


def index_map(keys: DataFrame, total: int | None = None) -> DataFrame:
    """(index, code, pos): a running number from 1 over the keys in order of contig and position. Another total than the one given fails."""
    ids = dense_ids(keys)
    if total is not None and (n := ids.count()) != total:
        raise ValueError(f"{n} loci, {total} expected")
    return ids.select((F.col("row_id") + 1).alias("index"), key_code(F.col("locus_key")).alias("code"), key_position(F.col("locus_key")).alias("pos"))


def dense_ids(keys: DataFrame) -> DataFrame:
    """(locus_key, row_id): rank of each distinct key from 0, ranked within contigs and shifted by the contigs before."""
    own = keys.select("locus_key").distinct().withColumn("code", key_code(F.col("locus_key")))
    sizes = own.groupBy("code").agg(F.count("*").alias("n"))
    shift = sizes.withColumn("shift", F.coalesce(F.sum("n").over(W.orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = own.withColumn("local", F.row_number().over(W.partitionBy("code").orderBy("locus_key")))
    return ranked.join(F.broadcast(shift), "code").select("locus_key", (F.col("local") - 1 + F.col("shift")).alias("row_id"))


