"""What trimming the ends of reads would do: counterfactual options judged in one pass over the calls or the profile."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS = 62  # options that share one long


def _steps(value: Column, cuts: Sequence[int]) -> list[Column]:
    """For every BITS options a long whose bits tell which of their cuts value reaches; value meets the cuts in falling order."""
    out = []
    for at in range(0, len(cuts), BITS):
        own = cuts[at : at + BITS]
        mask: Column | None = None
        for cut in sorted(set(own), reverse=True):
            held = F.lit(sum(1 << i for i, c in enumerate(own) if c <= cut)).cast("long")
            mask = F.when(value >= cut, held) if mask is None else mask.when(value >= cut, held)
        out.append(mask.otherwise(0))
    return out


def trimming_options(clips_1: Sequence[int], clips_2: Sequence[int], extra_3: Sequence[int]) -> list[tuple[int, int, int]]:
    return [(a, b, c) for a in clips_1 for b in clips_2 for c in extra_3]


def trim_scenarios(calls: DataFrame, options: Sequence[tuple[int, int, int]], base: tuple[int, int], kmax: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, clip_1, clip_2, extra_3, calls, up, conflicts, frags_ge1 ..., pct, calls_lost, delta_pct, frags_ge1_lost ...) for each option.

    calls: sample_id, fragment_id, mate (1 or 2), locus_key, state, read_pos (from the read's 5' end, in reads cut by `base`
    already) and read_len. An option keeps a call whose read_pos is at least the clip beyond base of its mate, and which is at
    least extra_3 away from the read's other end. Then mates are merged: a locus called by both counts once, and not at all if
    they disagree. Shares lost and the change in percent are against the option that cuts no more than base, by group; they
    are null without it.

    Each call carries the options that keep it as bits, which are united by locus and counted by fragment: no call is
    copied for an option, and calls are shuffled once.
    """
    cut = lambda f: [f(o) for o in options]
    first, second = (_steps(F.col("read_pos"), cut(lambda o, i=i: o[i] - base[i])) for i in (0, 1))
    tail = _steps(F.col("read_len") - 1 - F.col("read_pos"), cut(lambda o: o[2]))
    words = range(len(tail))
    kept = {f"m{w}": F.when(F.col("mate") == 1, first[w]).otherwise(second[w]).bitwiseAND(tail[w]) for w in words}
    own = list(dict.fromkeys([*by, "sample_id", "fragment_id"]))
    placed = calls.select(*own, "locus_key", "state", *(c.alias(n) for n, c in kept.items())).repartition(*own)
    sides = [F.bit_or(F.when(F.col("state") == s, F.col(f"m{w}")).otherwise(0)).alias(f"{n}{w}") for n, s in (("up", 1), ("down", 0)) for w in words]
    loci = placed.groupBy(*own, "locus_key").agg(*sides)
    pair: Callable[[int], tuple[Column, Column]] = lambda w: (F.col(f"up{w}"), F.col(f"down{w}"))
    one = F.array(*(u.bitwiseXOR(d) for u, d in map(pair, words)))
    up = F.array(*(u.bitwiseAND(F.bitwise_not(d)) for u, d in map(pair, words)))
    clash = F.array(*(u.bitwiseAND(d) for u, d in map(pair, words)))
    fragments = loci.groupBy(*own).agg(F.collect_list(F.struct(one.alias("one"), up.alias("up"), clash.alias("clash"))).alias("loci"))  # a fragment's calls
    count = lambda field: f"aggregate(loci, 0, (a, l) -> a + cast(shiftright(l.{field}[cast(i div {BITS} as int)], i % {BITS}) & 1 as int))"
    counted = f"transform(sequence(0, {len(options) - 1}), i -> struct(i as option, {count('one')} as n, {count('up')} as up, {count('clash')} as clash))"
    each = fragments.select(*by, F.inline(F.expr(counted)))
    sizes = [F.count_if(F.col("n") >= k).alias(f"frags_ge{k}") for k in range(1, kmax + 1)]
    total = each.groupBy(*by, "option").agg(F.sum("n").alias("calls"), F.sum("up").alias("up"), F.sum("clash").alias("conflicts"), *sizes)
    listed = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("clip_1", "clip_2", "extra_3"), o, strict=True))) for o in options))
    named = total.withColumn("o", F.get(listed, F.col("option"))).select(*by, "o.*", *total.columns[len(by) + 1 :])
    plain = (F.col("clip_1") == base[0]) & (F.col("clip_2") == base[1]) & (F.col("extra_3") == 0)
    before = lambda c: F.max(F.when(plain, F.col(c))).over(W.partitionBy(*by))  # noqa: E731  a row for each option
    lost = lambda c: 1 - F.try_divide(F.col(c), before(c))
    pct = F.try_divide(100 * F.col("up"), F.col("calls"))
    return named.select(
        "*", pct.alias("pct"), lost("calls").alias("calls_lost"), (pct - F.try_divide(100 * before("up"), before("calls"))).alias("delta_pct"),
        *(lost(f"frags_ge{k}").alias(f"frags_ge{k}_lost") for k in range(1, kmax + 1)),
    )


def clip_metrics(profile: DataFrame, base: dict[int, int], options: dict[int, Sequence[int]], plateau: tuple[int, int] = (40, 100), window: int = 10, min_coverage: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, read, clip, extra, calls_lost_read, calls_lost_all, pct, delta_pct, plateau, abs_dev, signed_dev, first_dev) for each option of a read.

    profile: by, read, pos (from 0, in reads cut by base already), n calls and up of them methylated; positions with fewer
    than min_coverage calls are left out. An option cuts a read to `clip` in all, so positions from clip - base on stay. Lost
    calls are shares of the read's and of all reads' calls; plateau is the median percentage over sequencing cycles, and the
    deviations are those of the first `window` positions that stay. An option that leaves nothing has no row.

    Sums over all later positions and means over the next ones stand beside each position, so options only look them up.
    """
    keys = [*by, "read"]
    choose = lambda table: F.coalesce(*(F.when(F.col("read") == r, F.lit(v)) for r, v in table.items()))
    cycle = F.col("pos") + 1 + choose(base)
    rows = profile.where(F.col("n") >= min_coverage).withColumn("share", 100 * F.col("up") / F.col("n"))
    level = rows.groupBy(*keys).agg(F.median(F.when(cycle.between(*plateau), F.col("share"))).alias("plateau"), F.sum("n").alias("all_n"), F.sum("up").alias("all_up"))
    level = level.withColumn("every_n", F.sum("all_n").over(W.partitionBy(*by)))  # a row for each read
    order = W.partitionBy(*keys).orderBy("pos")
    later, ahead = order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(0, window - 1)
    off = F.col("share") - F.col("plateau")
    beside = rows.join(level, keys).select(
        *keys, "pos", "plateau", "all_n", "all_up", "every_n", F.sum("n").over(later).alias("left_n"), F.sum("up").over(later).alias("left_up"),
        F.avg(F.abs(off)).over(ahead).alias("abs_dev"), F.avg(off).over(ahead).alias("signed_dev"), off.alias("first_dev"),
    )
    clips = choose({r: [int(c) for c in v] for r, v in options.items()})
    found = beside.select("*", F.explode(clips).alias("clip")).withColumn("extra", F.col("clip") - choose(base)).where("pos >= extra")
    picked = found.groupBy(*keys, "clip", "extra").agg(F.min_by(F.struct(*beside.columns[len(keys) + 1 :]), "pos").alias("s")).select(*keys, "clip", "extra", "s.*")
    pct = 100 * F.col("left_up") / F.col("left_n")
    gone = F.col("all_n") - F.col("left_n")
    return picked.select(*keys, "clip", "extra", (gone / F.col("all_n")).alias("calls_lost_read"), (gone / F.col("every_n")).alias("calls_lost_all"), pct.alias("pct"), (pct - 100 * F.col("all_up") / F.col("all_n")).alias("delta_pct"), "plateau", "abs_dev", "signed_dev", "first_dev")
