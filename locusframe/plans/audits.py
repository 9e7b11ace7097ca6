"""Queries of trimming audits, storage forecasts and tables that sum up an experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beta, calls, clipping, experiments, metrics, qc, splits
from .benchviews import view
from .registry import OBS, PRED, labelled, observations, plain_hash, query, rounded, seeded, seeded_hash

# Trimming

OPTIONS = clipping.trimming_options((10, 15, 20, 25), (15, 20), (0, 5))
KEPT = "op AS (SELECT a.x AS clip_1, b.x AS clip_2, c.x AS extra_3 FROM (SELECT unnest([10, 15, 20, 25]) AS x) a CROSS JOIN (SELECT unnest([15, 20]) AS x) b CROSS JOIN (SELECT unnest([0, 5]) AS x) c)"
SCENARIOS = f"""{KEPT}, ml AS (SELECT clip_1, clip_2, extra_3, sample_id, fragment_id, locus_key, min(state) AS lo, max(state) AS hi FROM v_reads CROSS JOIN op
 WHERE read_pos >= CASE WHEN mate = 1 THEN clip_1 - 10 ELSE clip_2 - 15 END AND read_len - 1 - read_pos >= extra_3 GROUP BY ALL),
fr AS (SELECT clip_1, clip_2, extra_3, sample_id, fragment_id, count(*) FILTER (lo = hi) AS n, coalesce(sum(lo) FILTER (lo = hi), 0) AS up, count(*) FILTER (lo <> hi) AS clash FROM ml GROUP BY ALL),"""


def scenario_columns(group: str) -> str:
    own = f"{group}, " if group else ""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    base = lambda c: f"max({c}) FILTER (clip_1 = 10 AND clip_2 = 15 AND extra_3 = 0) {over}"
    lost = ", ".join(f"round(1 - frags_ge{k} / nullif({base(f'frags_ge{k}')}, 0), 6) AS frags_ge{k}_lost" for k in range(1, 6))
    sizes = ", ".join(f"count(*) FILTER (n >= {k}) AS frags_ge{k}" for k in range(1, 6))
    return f"""sc AS (SELECT {own}clip_1, clip_2, extra_3, sum(n)::BIGINT AS calls, sum(up)::BIGINT AS up, sum(clash)::BIGINT AS conflicts, {sizes} FROM fr GROUP BY ALL)
SELECT *, round(100 * up / calls, 6) AS pct, round(1 - calls / {base("calls")}, 6) AS calls_lost, round(100 * up / calls - 100 * {base("up")} / {base("calls")}, 6) AS delta_pct, {lost} FROM sc"""


@query("D13_trimming_scenarios", f"WITH {SCENARIOS} {scenario_columns('')}")
def d13s(spark, d):
    return rounded(clipping.trim_scenarios(view(spark, d, "v_reads"), OPTIONS, (10, 15)))


POSITIONS = "pp AS (SELECT sample_id % 40 AS sample_id, mate AS read, read_pos AS pos, count(*) AS n, sum(state)::BIGINT AS up, 100 * sum(state) / count(*) AS pct FROM v_reads GROUP BY ALL)"
CLIPPED = f"""{POSITIONS}, ba AS (SELECT * FROM (VALUES (1, 10), (2, 15)) AS t(read, base)), oc AS (SELECT * FROM (VALUES (1, 10), (1, 15), (1, 20), (2, 15), (2, 20)) AS t(read, clip)),
lv AS (SELECT sample_id, pp.read, base, median(pct) FILTER (pos + 1 + base BETWEEN 30 AND 50) AS plateau, sum(n) AS all_n, sum(up) AS all_up FROM pp JOIN ba ON pp.read = ba.read GROUP BY ALL),
lw AS (SELECT *, sum(all_n) OVER (PARTITION BY sample_id) AS every_n FROM lv),
kp AS (SELECT pp.*, clip, clip - base AS extra, plateau, all_n, all_up, every_n, row_number() OVER (PARTITION BY pp.sample_id, pp.read, clip ORDER BY pos) AS rn FROM pp JOIN lw ON pp.sample_id = lw.sample_id AND pp.read = lw.read JOIN oc ON pp.read = oc.read WHERE pos >= clip - base),
cm AS (SELECT sample_id, read, clip, extra, 1 - sum(n) / any_value(all_n) AS calls_lost_read, (any_value(all_n) - sum(n)) / any_value(every_n) AS calls_lost_all, 100 * sum(up) / sum(n) AS pct, 100 * sum(up) / sum(n) - 100 * any_value(all_up) / any_value(all_n) AS delta_pct, any_value(plateau) AS plateau,
 avg(abs(pct - plateau)) FILTER (rn <= 10) AS abs_dev, avg(pct - plateau) FILTER (rn <= 10) AS signed_dev, max(pct - plateau) FILTER (rn = 1) AS first_dev FROM kp GROUP BY ALL)"""


def clipped(spark, d):
    """Clip metrics of forty pooled samples, by read and total clip."""
    pooled = view(spark, d, "v_reads").withColumn("sample_id", F.col("sample_id") % 40)
    profile = pooled.groupBy("sample_id", F.col("mate").alias("read"), F.col("read_pos").alias("pos")).agg(F.count("*").alias("n"), F.sum("state").alias("up"))
    return clipping.clip_metrics(profile, {1: 10, 2: 15}, {1: [10, 15, 20], 2: [15, 20]}, (30, 50), 10, 1, ["sample_id"])


@query("D14_clip_options", f"WITH {CLIPPED} SELECT sample_id, read, clip, extra, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("calls_lost_read", "calls_lost_all", "pct", "delta_pct", "plateau", "abs_dev", "signed_dev", "first_dev")) + " FROM cm")
def d14o(spark, d):
    return rounded(clipped(spark, d))


@query("D37_batch_shapes_by_clip", f"""WITH {CLIPPED}, sb AS (SELECT read, clip, sample_id % 2 AS half, round(signed_dev, 9) AS dev FROM cm WHERE signed_dev IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY read, clip ORDER BY dev) + (count(*) OVER (PARTITION BY read, clip, dev) - 1) / 2 AS r FROM sb), t AS (SELECT read, clip, sum(c::DOUBLE * c * c - c) AS t FROM (SELECT read, clip, dev, count(*) AS c FROM sb GROUP BY ALL) GROUP BY ALL),
g AS (SELECT read, clip, count(*) FILTER (half = 0) AS n1, count(*) FILTER (half = 1) AS n2, avg(dev) FILTER (half = 0) AS mean1, avg(dev) FILTER (half = 1) AS mean2, sum(r) FILTER (half = 0) AS s FROM k GROUP BY ALL),
u AS (SELECT g.*, s - n1 * (n1 + 1) / 2 AS u, t, (n1 + n2)::DOUBLE AS n FROM g JOIN t ON g.read = t.read AND g.clip = t.clip)
SELECT read, clip, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(u, 6) AS u, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))), 6) AS z FROM u""")
def d37c(spark, d):
    rows = clipped(spark, d).where("signed_dev is not null").select("read", "clip", (F.col("sample_id") % 2).alias("half"), F.round("signed_dev", 9).alias("dev"))
    return rounded(metrics.grouped_mann_whitney(rows, ["read", "clip"], "half", "dev", 0))


# Storage forecasts

THRESHOLDS = """mc AS (SELECT sample_id, fragment_id, locus_key, min(state) AS state FROM v_reads GROUP BY ALL HAVING min(state) = max(state)),
ff AS (SELECT sample_id, fragment_id, count(*) AS k, sum(state) AS up FROM mc GROUP BY ALL),
al AS (SELECT sample_id, count(*) AS all_f, sum(k) AS all_c FROM ff GROUP BY 1),
th AS (SELECT ff.sample_id, t.threshold, count(*) AS fragments, sum(k)::BIGINT AS calls, count(*) / any_value(all_f) AS fragment_share, sum(k) / any_value(all_c) AS call_share, sum(k) / count(*) AS mean_cpgs, 100 * sum(up) / sum(k) AS pct_up,
 count(*) FILTER (up = k) / count(*) AS fully_up, count(*) FILTER (up = 0) / count(*) AS fully_down, 5 * sum(k)::BIGINT + 8 * (count(*) + 1) AS bytes FROM ff JOIN al ON ff.sample_id = al.sample_id JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS threshold) t ON k >= t.threshold GROUP BY ALL),
me AS (SELECT sample_id, CASE WHEN sample_id % 11 = 0 THEN 'B2' ELSE batch END AS batch, diagnosis, 1000 + sample_id * 37 % 5000 AS pairs FROM v_samples),
pi AS (SELECT th.*, batch, diagnosis, pairs FROM th JOIN me ON th.sample_id = me.sample_id WHERE th.sample_id % 3 = 0 AND batch <> 'B2'),
ra AS (SELECT threshold, count(*) AS n_pilot, median(bytes / pairs) AS mid, min(bytes / pairs) AS low, max(bytes / pairs) AS high FROM pi GROUP BY 1),
rb AS (SELECT threshold, batch, median(bytes / pairs) AS mid FROM pi GROUP BY ALL), mb AS (SELECT batch, count(*) AS n, sum(pairs) AS pairs FROM me GROUP BY 1),
ex AS (SELECT ra.threshold, n_pilot, (SELECT sum(n) FROM mb)::BIGINT AS n_target, ra.mid AS ratio_median, (SELECT sum(pairs) FROM mb) * ra.mid AS total_median, (SELECT sum(pairs) FROM mb) * low AS total_min, (SELECT sum(pairs) FROM mb) * high AS total_max, sum(mb.pairs * coalesce(rb.mid, ra.mid)) AS total_batch_median FROM ra CROSS JOIN mb LEFT JOIN rb ON rb.threshold = ra.threshold AND rb.batch = mb.batch GROUP BY ALL)"""


def pilot(spark, d):
    """(pilot, all samples): a third of the samples measured, none of a third batch, by threshold."""
    meta = view(spark, d, "v_samples").select("sample_id", F.when(F.col("sample_id") % 11 == 0, "B2").otherwise(F.col("batch")).alias("batch"), "diagnosis", (1000 + F.col("sample_id") * 37 % 5000).alias("pairs"))
    per = qc.sample_thresholds(calls.merge_mates(view(spark, d, "v_reads")).drop("n"))
    return per.join(meta, "sample_id").where("sample_id % 3 = 0 and batch <> 'B2'"), meta


@query("D9_storage_forecast", f"WITH {THRESHOLDS} SELECT threshold, n_pilot, n_target, round(ratio_median, 6) AS ratio_median, round(total_median, 4) AS total_median, round(total_min, 4) AS total_min, round(total_max, 4) AS total_max, round(total_batch_median, 4) AS total_batch_median FROM ex")
def d9f(spark, d):
    out = qc.storage_forecast(*pilot(spark, d))
    return rounded(out.withColumn("ratio_median", F.round("ratio_median", 6)), 6).select("threshold", "n_pilot", "n_target", "ratio_median", *(F.round(c, 4).alias(c) for c in ("total_median", "total_min", "total_max", "total_batch_median")))


@query("D38_threshold_summary", f"WITH {THRESHOLDS}, ag AS (SELECT threshold, round(avg(fragment_share), 6) AS fragment_share_mean, round(min(fragment_share), 6) AS fragment_share_min, round(max(fragment_share), 6) AS fragment_share_max, round(avg(call_share), 6) AS call_share_mean, sum(fragments)::BIGINT AS fragments, sum(calls)::BIGINT AS calls, round(avg(mean_cpgs), 6) AS mean_cpgs, round(avg(pct_up), 6) AS pct_up, round(avg(fully_up), 6) AS fully_up, round(avg(fully_down), 6) AS fully_down, sum(bytes)::BIGINT AS pilot_bytes FROM pi GROUP BY 1) SELECT ag.*, n_pilot, n_target, round(total_median, 4) AS total_median, round(total_min, 4) AS total_min, round(total_max, 4) AS total_max FROM ag JOIN ex ON ag.threshold = ex.threshold")
def d38s(spark, d):
    out = rounded(qc.threshold_summary(*pilot(spark, d)).drop("ratio_median", "total_batch_median"))
    return out.withColumns({c: F.round(c, 4) for c in ("total_median", "total_min", "total_max")})


@query("D38_threshold_groups", f"WITH {THRESHOLDS} SELECT threshold, batch, diagnosis, count(*) AS samples, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("fragment_share", "call_share", "mean_cpgs", "pct_up", "fully_up", "fully_down")) + " FROM pi GROUP BY ALL")
def d38g(spark, d):
    return rounded(qc.threshold_groups(pilot(spark, d)[0]))


# An experiment's tables

RUNS = PRED + f""", sd AS (SELECT arm, sample_id, sample_id % 5 AS fold, 'B' || sample_id % 2 AS batch, y, cls, s.seed, prob * (1 + {plain_hash('s.seed', 'sample_id', 'cls')} / 4294967296 / 10) AS prob FROM pr CROSS JOIN (SELECT unnest([17, 42, 97]) AS seed) s),
ru AS (SELECT * FROM sd WHERE NOT (arm = 5 AND seed = 97 AND fold = 3) AND NOT (arm = 4 AND fold = 1))"""


def metrics_sql(name: str, source: str, keys: str) -> str:
    """CTEs up to `name`: (keys, accuracy, balanced_accuracy, macro_f1, macro_auroc, n, present) of predictions in source."""
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    return f"""{name}_t AS (SELECT {keys}, sample_id, any_value(y) AS y, min(cls) FILTER (rn = 1) AS label FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, sample_id ORDER BY prob DESC, cls) AS rn FROM {source}) GROUP BY {keys}, sample_id),
{name}_p AS (SELECT {keys}, c.cls, count(*) AS total, count(*) FILTER (y = c.cls) AS support, count(*) FILTER (label = c.cls) AS predicted, count(*) FILTER (y = c.cls AND label = c.cls) AS hits FROM {name}_t CROSS JOIN (SELECT unnest(range(10)) AS cls) c GROUP BY {keys}, c.cls),
{name}_m AS (SELECT {keys}, sum(hits) / max(total) AS accuracy, avg(hits / nullif(support, 0)) AS balanced_accuracy, avg(coalesce(2 * hits / nullif(support + predicted, 0), 0)) AS macro_f1, max(total) AS n, count(*) FILTER (support > 0) AS present FROM {name}_p GROUP BY {keys}),
{name}_r AS (SELECT {keys}, cls, y = cls AS pos, rank() OVER (PARTITION BY {keys}, cls ORDER BY prob) + (count(*) OVER (PARTITION BY {keys}, cls, prob) - 1) / 2 AS r FROM {source}),
{name}_z AS (SELECT {keys}, cls, count(*) AS n, count(*) FILTER (pos) AS p, sum(r) FILTER (pos) AS s FROM {name}_r GROUP BY {keys}, cls),
{name}_a AS (SELECT {keys}, avg((s - p * (p + 1) / 2) / nullif(p * (n - p), 0)) AS macro_auroc FROM {name}_z GROUP BY {keys}),
{name} AS (SELECT m.*, macro_auroc FROM {name}_m m JOIN {name}_a a ON {same('m', 'a')})"""


SEEDS, FOLD_IDS = [17, 42, 97], [0, 1, 2, 3, 4]
CELLS = "dn AS (SELECT DISTINCT arm, seed, fold FROM ru), mi AS (SELECT a.arm, string_agg(s.seed || ':' || f.fold, ',' ORDER BY s.seed, f.fold) AS missing FROM (SELECT DISTINCT arm FROM ru) a CROSS JOIN (SELECT unnest([17, 42, 97]) AS seed) s CROSS JOIN (SELECT unnest(range(5)) AS fold) f LEFT JOIN dn ON dn.arm = a.arm AND dn.seed = s.seed AND dn.fold = f.fold WHERE dn.arm IS NULL GROUP BY 1)"


def runs(spark, d):
    """Predictions of six arms in fifteen cells of seed and fold; one cell of arm 5 and a fold of arm 4 are missing."""
    rows = seeded(spark, d).withColumn("fold", F.col("sample_id") % 5).withColumn("batch", F.concat(F.lit("B"), F.col("sample_id") % 2))
    return rows.where("not (arm = 5 and seed = 97 and fold = 3) and not (arm = 4 and fold = 1)")


@query("D29_incomplete_arms", f"WITH {RUNS}, {CELLS} SELECT a.arm, mi.arm IS NULL AS complete, coalesce(missing, '') AS missing FROM (SELECT DISTINCT arm FROM ru) a LEFT JOIN mi ON a.arm = mi.arm")
def d29i(spark, d):
    return experiments.arm_cells(runs(spark, d), SEEDS, FOLD_IDS)


LISTED = "'accuracy', 'balanced_accuracy', 'macro_f1', 'macro_auroc'"


def listed(cte: str, keys: str) -> str:
    return f"SELECT {keys}, unnest([{LISTED}]) AS metric, unnest([accuracy, balanced_accuracy, macro_f1, macro_auroc]) AS value FROM {cte}"


@query("D29_seed_metrics", f"WITH {RUNS}, {metrics_sql('ps', 'ru', 'arm, seed')}, l AS ({listed('ps', 'arm, seed, n')}) SELECT arm, seed, n, metric, round(value, 6) AS value FROM l")
def d29s(spark, d):
    return rounded(experiments.metric_rows(runs(spark, d), 10, ["arm", "seed"]))


@query("D29_batch_metrics", f"WITH {RUNS}, {metrics_sql('pb', 'ru', 'arm, seed, batch')} SELECT arm, seed, batch, n, present, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM pb")
def d29b(spark, d):
    return rounded(experiments.batch_metrics(runs(spark, d), 10))


@query("D29_arm_table", f"WITH {RUNS}, {CELLS}, {metrics_sql('ps', 'ru', 'arm, seed')}, en AS (SELECT arm, sample_id, y, cls, avg(prob) AS prob FROM ru WHERE arm NOT IN (SELECT arm FROM mi) GROUP BY ALL), {metrics_sql('pe', 'en', 'arm')}, l AS ({listed('ps', 'arm, seed')}), e AS ({listed('pe', 'arm')}) SELECT l.arm, l.arm NOT IN (SELECT arm FROM mi) AS complete, metric, count(*) AS seeds, round(avg(l.value), 6) AS mean, round(stddev_samp(l.value), 6) AS sd, round(any_value(e.value), 6) AS seed_ensemble FROM l LEFT JOIN e USING (arm, metric) GROUP BY l.arm, metric")
def d29t(spark, d):
    return rounded(experiments.arm_table(runs(spark, d), 10, SEEDS, FOLD_IDS))


@query("G11_run_check", f"WITH {RUNS}, {metrics_sql('ps', 'ru', 'arm, fold')}, l AS (SELECT arm, fold, metric, CASE WHEN arm = 3 AND fold = 2 AND metric = 'macro_f1' THEN 'nan'::DOUBLE WHEN arm = 1 AND fold = 0 AND metric = 'accuracy' THEN NULL ELSE value END AS value FROM ({listed('ps', 'arm, fold')})) SELECT arm, fold, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS not_finite, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (value IS NULL OR NOT isfinite(value)), '') AS which, count(*) FILTER (value IS NULL OR NOT isfinite(value)) = 0 AS complete FROM l GROUP BY ALL")
def g11r(spark, d):
    rows = experiments.metric_rows(runs(spark, d), 10, ["arm", "fold"])
    spoilt = F.when(F.expr("arm = 3 and fold = 2 and metric = 'macro_f1'"), float("nan")).when(F.expr("arm = 1 and fold = 0 and metric = 'accuracy'"), None).otherwise(F.col("value"))
    return qc.finite_metrics(rows.withColumn("value", spoilt), ["arm", "fold"])


@query("D39_run_totals", f"WITH {OBS}, f AS (SELECT sample_id, count(*) AS n FROM v_calls GROUP BY sample_id, fragment_id), r AS (SELECT sample_id, count(*) AS n_fragments, count(*) FILTER (n >= 3) AS n_valid FROM f GROUP BY 1) SELECT count(DISTINCT patient_id) AS patients, sum(n_fragments)::BIGINT AS fragments, sum(n_valid)::BIGINT AS valid, (SELECT count(DISTINCT locus_key) FROM ob) AS loci FROM v_samples LEFT JOIN r USING (sample_id)")
def d39t(spark, d):
    placed = labelled(spark, d).withColumnRenamed("official_split", "split")
    return qc.run_totals(placed, calls.read_stats(view(spark, d, "v_calls"), 3, 100), observations(spark, d))


@query("E5_recurrent_loci", f"WITH {OBS}, mn AS (SELECT locus_key, avg(beta) AS m FROM ob GROUP BY 1), tp AS (SELECT sample_id, locus_key FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(beta - m, 9) DESC, locus_key) AS rn FROM ob JOIN mn USING (locus_key)) WHERE rn <= 3), c AS (SELECT diagnosis AS label, locus_key, count(*) AS samples FROM tp JOIN v_samples USING (sample_id) GROUP BY ALL) SELECT label, locus_key, samples, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY samples DESC, locus_key)::INTEGER AS rank FROM c) WHERE rank <= 10")
def e5r(spark, d):
    obs = observations(spark, d)
    means = obs.groupBy("locus_key").agg(F.avg("beta").alias("mean_beta"))
    return beta.recurrent_loci(beta.top_contributions(obs, means, 3), labelled(spark, d), 10)


# Validation strata

STRATA = f"""tr AS (SELECT f.fold, patient_id, CASE WHEN f.fold = 2 AND patient_id = (SELECT min(patient_id) FROM v_samples) THEN 'LONE' ELSE diagnosis END AS label, diagnosis || '|' || CASE WHEN f.fold = 1 AND patient_id = (SELECT min(patient_id) FROM v_samples) THEN 'B9' ELSE batch END AS stratum FROM v_samples CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold) f),
sz AS (SELECT fold, count(*) AS m, (count(*) * 20 + 99) // 100 AS want FROM tr GROUP BY 1),
fe AS (SELECT sz.fold, want, m, (SELECT min(c) >= 2 AND count(*) <= least(want, m - want) FROM (SELECT count(*) AS c FROM tr WHERE tr.fold = sz.fold GROUP BY stratum)) AS fine, (SELECT min(c) >= 2 AND count(*) <= least(want, m - want) FROM (SELECT count(*) AS c FROM tr WHERE tr.fold = sz.fold GROUP BY label)) AS coarse FROM sz),
pl AS (SELECT tr.fold, patient_id, label, CASE WHEN fine THEN 'stratum' WHEN coarse THEN 'label' ELSE 'none' END AS level, CASE WHEN fine THEN stratum WHEN coarse THEN label ELSE '' END AS part, want, m FROM tr JOIN fe ON tr.fold = fe.fold),
qa AS (SELECT fold, part, count(*) * any_value(want) // any_value(m) AS base, count(*) * any_value(want) % any_value(m) AS rest, any_value(want) AS want FROM pl GROUP BY ALL),
qb AS (SELECT fold, part, base + CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY rest DESC, part) <= want - sum(base) OVER (PARTITION BY fold) THEN 1 ELSE 0 END AS quota FROM qa),
rk AS (SELECT *, row_number() OVER (PARTITION BY fold, part ORDER BY {seeded_hash('17', 'fold', 'patient_id')}, patient_id) AS rn FROM pl)"""


@query("G3_validation_strata", f"WITH {STRATA} SELECT rk.fold, patient_id, label, level, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS split FROM rk JOIN qb ON rk.fold = qb.fold AND rk.part = qb.part")
def g3s(spark, d):
    """Three folds: one may be carved by stratum, in one a stratum has a single patient, in one a class has."""
    s = view(spark, d, "v_samples")
    lone = s.agg(F.min("patient_id").alias("lone"))
    rows = s.join(F.broadcast(lone), F.lit(True)).select("patient_id", "diagnosis", "batch", (F.col("patient_id") == F.col("lone")).alias("odd"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    label = F.when(F.expr("fold = 2 and odd"), "LONE").otherwise(F.col("diagnosis"))
    stratum = F.concat_ws("|", "diagnosis", F.when(F.expr("fold = 1 and odd"), "B9").otherwise(F.col("batch")))
    return splits.carve_validation(rows.select("fold", "patient_id", label.alias("label"), stratum.alias("stratum")), 20, 17).select("fold", "patient_id", "label", "level", "split")
