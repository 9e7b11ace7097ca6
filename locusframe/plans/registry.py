"""The queries of the package by name, each with DuckDB SQL where that can express it.

Names begin with the operator's id in the coverage list. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.loci import draw, key_code, key_position, make_key
from ..operators import audit, beta, calls, intervals, metrics, models, pooling, qc, represent, resampling, splits
from ..sources import shared, text
from .benchviews import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def seeded_hash(seed: int | str, *columns: str) -> str:
    """DuckDB's form of draw()."""
    text = f"'{seed}|' || " + " || '|' || ".join(columns)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"



def plain_hash(*columns: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(columns)}), 1, 8))::BIGINT"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def observations(spark: SparkSession, d: str) -> DataFrame:
    return beta.observe(view(spark, d, "v_obs"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    scheme = {c: c for c in CLASSES}
    return splits.apply_labels(view(spark, d, "v_samples"), scheme, CLASSES)


def embedding_store(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("locus_key"), F.col("embedding").alias("vec"))


ARMS = 6


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Six arms of ten class scores from the 64 components; the last four are added to the first four."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    whole = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.get("embedding", i).cast("double") + F.coalesce(F.get("embedding", i + 60).cast("double"), F.lit(0.0)))
    each = e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y"), F.posexplode(whole).alias("i", "x"))
    return each.select("sample_id", "y", F.expr("int(i div 10)").alias("arm"), F.expr("int(i % 10)").alias("cls"), (4 * F.col("x")).alias("score"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.softmax(scores(spark, d), ["arm", "sample_id"]).drop("score")


SCORES = "sc AS (SELECT vec_id AS sample_id, label AS y, ((i - 1) // 10)::INTEGER AS arm, ((i - 1) % 10)::INTEGER AS cls, 4 * (embedding[i]::DOUBLE + coalesce(embedding[i + 60]::DOUBLE, 0)) AS score FROM (SELECT *, unnest(range(1, 61)) AS i FROM embeddings))"
PRED = SCORES + ", pr AS (SELECT sample_id, y, arm, cls, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS prob FROM sc WINDOW w AS (PARTITION BY arm, sample_id))"
TOP = PRED + ", top AS (SELECT arm, sample_id, y, cls AS label, prob AS conf FROM (SELECT *, row_number() OVER (PARTITION BY arm, sample_id ORDER BY prob DESC, cls) AS rn FROM pr) WHERE rn = 1)"
OBS = "ob AS (SELECT sample_id, locus_key, c_count / ct_count AS beta, least(ct_count, 65535) AS coverage FROM v_obs WHERE ct_count > 0)"


def region_values_sql(gap: int) -> tuple[str, str]:
    """CTEs of regions of loci no further apart than gap, and of the samples' values in them."""
    regions = f"""lo AS (SELECT DISTINCT locus_key, locus_key // 4294967296 AS code FROM v_obs),
st AS (SELECT *, CASE WHEN locus_key - lag(locus_key) OVER w <= {gap} THEN 0 ELSE 1 END AS s FROM lo WINDOW w AS (PARTITION BY code ORDER BY locus_key)),
rg AS (SELECT locus_key, (sum(s) OVER (ORDER BY locus_key) - 1)::BIGINT AS region_id FROM st)"""
    return regions, f"{OBS}, {regions}, rb AS (SELECT sample_id, region_id, sum(beta * coverage) / sum(coverage) AS region_beta, count(*) AS n_loci FROM ob JOIN rg USING (locus_key) GROUP BY ALL)"


REGIONS, RB = region_values_sql(150)
# The models' regions. The tables give a sample as many loci at any size, so that only a region as wide as a contig is seen in most samples.
WIDE, SEEN = 500, 0.7
LIFT = """pt AS (SELECT locus_key, locus_key // 4294967296 AS code, locus_key % 4294967296 - 1 AS p FROM v_points),
met AS (SELECT pt.locus_key, b.src_start, b.dst_code * 4294967296 + CASE WHEN strand > 0 THEN dst_start + p - src_start + 1 ELSE dst_start + size - 1 - (p - src_start) END AS target
 FROM pt LEFT JOIN v_chain b ON pt.code = b.src_code AND p >= b.src_start AND p < b.src_start + b.size),
lf AS (SELECT locus_key, count(src_start) AS n_blocks, CASE WHEN count(src_start) = 1 THEN min(target) END AS target FROM met GROUP BY locus_key)"""
STATUS = LIFT + """, ref AS (SELECT DISTINCT target FROM lf WHERE target % 3 <> 0), sto AS (SELECT DISTINCT target FROM lf WHERE target % 5 <> 0),
v AS (SELECT lf.*, ref.target IS NOT NULL AS ok, count(CASE WHEN ref.target IS NOT NULL THEN 1 END) OVER (PARTITION BY lf.target) AS sources, sto.target IS NOT NULL AS held
 FROM lf LEFT JOIN ref ON lf.target = ref.target LEFT JOIN sto ON lf.target = sto.target),
sta AS (SELECT locus_key, n_blocks, target, CASE WHEN n_blocks = 0 THEN 'unmapped' WHEN n_blocks > 1 THEN 'ambiguous' WHEN NOT ok THEN 'not_in_target' WHEN sources > 1 THEN 'collision' WHEN NOT held THEN 'not_covered' ELSE 'kept' END AS status FROM v)"""
MERGED = "mg AS (SELECT sample_id, fragment_id, locus_key, min(state) AS state, count(*) AS n FROM v_calls GROUP BY ALL HAVING min(state) = max(state))"


# Scans, keys and observations


@query("A1_methratio_scan", "SELECT CASE WHEN context <> 'CG' THEN 'non_cg' WHEN code > 22 THEN 'other_contig' WHEN ct_count < 4 THEN 'low_coverage' ELSE 'kept' END AS reason, count(*) AS n FROM v_methratio GROUP BY 1")
def a1(spark, d):
    return beta.scan_stats(view(spark, d, "v_methratio"), 4)


@query("B1_make_key", "SELECT l_orderkey, l_linenumber, (l_partkey % 24 + 1) * 4294967296 + l_orderkey + 1 AS locus_key FROM lineitem")
def b1(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", make_key(F.col("l_partkey") % 24 + 1, F.col("l_orderkey") + 1).alias("locus_key"))


@query("B2_split_key", "SELECT locus_key // 4294967296 AS code, count(*) AS n, min(locus_key % 4294967296) AS first_pos, max(locus_key % 4294967296) AS last_pos FROM v_obs GROUP BY 1")
def b2(spark, d):
    k = F.col("locus_key")
    return view(spark, d, "v_obs").groupBy(key_code(k).alias("code")).agg(F.count("*").alias("n"), F.min(key_position(k)).alias("first_pos"), F.max(key_position(k)).alias("last_pos"))


@query("B3_beta_projection", f"WITH {OBS} SELECT sample_id, locus_key, round(beta, 6) AS beta, coverage FROM ob")
def b3(spark, d):
    return rounded(observations(spark, d))


@query("B4_label_scheme", "SELECT sample_id, CASE diagnosis WHEN 'BUILDING' THEN 'case' ELSE 'rest' END AS label, CASE diagnosis WHEN 'BUILDING' THEN 1 ELSE 0 END AS label_idx FROM v_samples WHERE diagnosis <> 'FURNITURE'")
def b4(spark, d):
    scheme = {c: {"BUILDING": "case", "FURNITURE": None}.get(c, "rest") for c in CLASSES}
    return splits.apply_labels(view(spark, d, "v_samples"), scheme, ["rest", "case"]).select("sample_id", "label", "label_idx")


@query("B5_sample_validation", "SELECT 'null_id' AS violation, count(*) FILTER (sample_id IS NULL OR patient_id IS NULL) AS n FROM v_samples UNION ALL SELECT 'repeated_sample', count(*) FILTER (c > 1) FROM (SELECT count(*) AS c FROM v_samples GROUP BY sample_id) UNION ALL SELECT 'mixed_patient', count(*) FILTER (k > 1) FROM (SELECT count(DISTINCT diagnosis) AS k FROM v_samples GROUP BY batch)")
def b5(spark, d):
    return splits.sample_violations(view(spark, d, "v_samples").withColumn("patient_id", F.col("batch")))


@query("B8_token_features", f"WITH {OBS} SELECT sample_id, locus_key, round(beta - 0.5, 6) AS beta_c, round(ln(1 + coverage) / 5, 6) AS log_cov FROM ob")
def b8(spark, d):
    return rounded(beta.token_features(observations(spark, d)).select("sample_id", "locus_key", "beta_c", "log_cov"))


@query("B15_softmax", f"WITH {PRED} SELECT sample_id, arm, cls, round(prob, 6) AS prob FROM pr")
def b15(spark, d):
    return rounded(predictions(spark, d).select("sample_id", "arm", "cls", "prob"))


@query("B16_argmax", f"WITH {TOP} SELECT arm, sample_id, label, round(conf, 6) AS conf FROM top")
def b16(spark, d):
    return rounded(metrics.predicted(predictions(spark, d), ["arm"]).select("arm", "sample_id", "label", "conf"))


# Liftover


def chain_status(spark, d):
    lifted = shared.kept(intervals.lift(view(spark, d, "v_points"), view(spark, d, "v_chain")))  # reference and store come from it too
    target = lifted.where("target is not null").select(F.col("target").alias("locus_key"))
    return intervals.lift_status(lifted, target.where("locus_key % 3 <> 0"), [target.where("locus_key % 5 <> 0")])


@query("C1_liftover_points", f"WITH {LIFT} SELECT * FROM lf")
def c1(spark, d):
    return intervals.lift(view(spark, d, "v_points"), view(spark, d, "v_chain"))


@query("C3_lift_status", f"WITH {STATUS} SELECT * FROM sta")
def c3(spark, d):
    return chain_status(spark, d)


@query("C4_lift_funnel", f"WITH {STATUS} SELECT count(*) AS n_input, count(*) FILTER (n_blocks = 1) AS lifted, count(*) FILTER (status = 'unmapped') AS unmapped, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'not_in_target') AS not_in_target, count(*) FILTER (status = 'collision') AS collision, count(*) FILTER (status = 'not_covered') AS not_covered, count(*) FILTER (status = 'kept') AS kept FROM sta")
def c4(spark, d):
    return intervals.funnel(chain_status(spark, d))


POINTS = "SELECT l_orderkey AS order_id, l_linenumber AS line, (l_partkey % 22 + 1) * 4294967296 + (l_orderkey * 37) % 46000 + 1 AS locus_key FROM lineitem"


@query("C5_lift_observations", f"WITH {STATUS} SELECT order_id, line, target AS locus_key FROM ({POINTS}) JOIN sta USING (locus_key) WHERE status = 'kept'")
def c5(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    points = rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), make_key(F.col("l_partkey") % 22 + 1, F.col("l_orderkey") * 37 % 46000 + 1).alias("locus_key"))
    return intervals.carry(points, chain_status(spark, d))


@query("C13_distinct_loci", "SELECT DISTINCT locus_key FROM (SELECT locus_key FROM v_obs UNION ALL SELECT locus_key FROM v_calls)")
def c13(spark, d):
    return view(spark, d, "v_obs").select("locus_key").union(view(spark, d, "v_calls").select("locus_key")).distinct()


@query("C14_missing_loci", "SELECT locus_key FROM v_calls EXCEPT SELECT locus_key FROM v_calls WHERE state = 1")
def c14(spark, d):
    c = view(spark, d, "v_calls")
    return intervals.missing_keys(c, c.where("state = 1"))


@query("C15_dense_ids", "SELECT locus_key, row_number() OVER (ORDER BY locus_key) - 1 AS row_id FROM (SELECT DISTINCT locus_key FROM v_obs)")
def c15(spark, d):
    return intervals.dense_ids(view(spark, d, "v_obs"))


@query("C18_track_breadth", 'WITH tr AS (SELECT block_id AS track_id, block_id % 3 AS "group", src_code, src_start, src_start + size AS src_end FROM v_chain), sz AS (SELECT "group", count(DISTINCT track_id) AS tracks FROM tr GROUP BY 1) SELECT locus_key, tr."group", round(count(DISTINCT track_id) / any_value(tracks), 6) AS breadth FROM v_points JOIN tr ON locus_key // 4294967296 = src_code AND locus_key % 4294967296 - 1 >= src_start AND locus_key % 4294967296 - 1 < src_end JOIN sz ON tr."group" = sz."group" GROUP BY 1, 2')
def c18(spark, d):
    tracks = view(spark, d, "v_chain").select(F.col("block_id").alias("track_id"), (F.col("block_id") % 3).alias("group"), "src_code", "src_start", (F.col("src_start") + F.col("size")).alias("src_end"))
    return rounded(intervals.track_breadth(view(spark, d, "v_points"), tracks))


@query("E3_block_overlap", "SELECT block_id, coalesce(max(src_start + size) OVER (PARTITION BY src_code ORDER BY src_start, src_start + size, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > src_start, false) AS overlaps FROM v_chain")
def e3(spark, d):
    return intervals.running_overlap(view(spark, d, "v_chain")).select("block_id", "overlaps")


# Summaries and regions


@query("D1_sample_summary", f"WITH {OBS}, u AS (SELECT count(DISTINCT locus_key) AS n FROM v_obs) SELECT sample_id, count(*) AS n_observed, round(1 - count(*) / any_value(u.n), 6) AS missing_fraction, round(avg(beta), 6) AS mean_beta, round(var_pop(beta), 6) AS var_beta, round(avg(coverage), 6) AS mean_coverage, round(median(coverage), 6) AS median_coverage FROM ob CROSS JOIN u GROUP BY sample_id")
def d1(spark, d):
    obs = observations(spark, d)
    return rounded(beta.sample_summary(obs))


@query("E1_regions", f"WITH {REGIONS} SELECT locus_key, region_id FROM rg")
def e1(spark, d):
    return beta.candidate_regions(view(spark, d, "v_obs"), 150)


def values(spark, d, gap=150):
    obs = shared.kept(observations(spark, d))  # regions and their values
    return beta.region_beta(obs, beta.candidate_regions(obs, gap))


@query("D3_region_beta", f"WITH {RB} SELECT sample_id, region_id, round(region_beta, 6) AS region_beta, n_loci FROM rb")
def d3(spark, d):
    return rounded(values(spark, d))


@query("D3_region_sizes", f"WITH {REGIONS} SELECT region_id, count(*) AS size, min(locus_key % 4294967296) AS first_pos, max(locus_key % 4294967296) AS last_pos FROM rg GROUP BY 1")
def d3b(spark, d):
    return beta.region_sizes(beta.candidate_regions(view(spark, d, "v_obs"), 150))


@query("D4_observed_regions", f"WITH {RB} SELECT region_id, round(count(DISTINCT sample_id) / (SELECT count(*) FROM v_samples), 6) AS observed FROM rb GROUP BY 1 HAVING count(DISTINCT sample_id) >= 0.1 * (SELECT count(*) FROM v_samples)")
def d4(spark, d):
    return rounded(beta.observed_regions(values(spark, d), view(spark, d, "v_samples").count(), 0.1))


WELCH = f"""{RB}, jl AS (SELECT region_id, diagnosis AS label, region_beta FROM rb JOIN v_samples USING (sample_id)),
lab AS (SELECT DISTINCT diagnosis AS label FROM v_samples), pairs AS (SELECT l.label, j.region_id, j.region_beta, j.label = l.label AS own FROM jl j CROSS JOIN lab l),
wt AS (SELECT label, region_id, count(*) FILTER (own) AS n, count(*) FILTER (NOT own) AS n_rest, avg(region_beta) FILTER (own) AS m1, avg(region_beta) FILTER (NOT own) AS m2, var_samp(region_beta) FILTER (own) AS v1, var_samp(region_beta) FILTER (NOT own) AS v2 FROM pairs GROUP BY ALL)"""


@query("D5_welch_one_vs_rest", f"WITH {WELCH}, se AS (SELECT *, v1 / n AS a, v2 / n_rest AS b FROM wt WHERE n >= 2 AND n_rest >= 2) SELECT label, region_id, n, n_rest, round(m1 - m2, 6) AS delta, CASE WHEN a + b > 1e-12 THEN round((m1 - m2) / sqrt(a + b), 4) END AS t, CASE WHEN a + b > 1e-12 THEN round((a + b) ** 2 / (a ** 2 / (n - 1) + b ** 2 / (n_rest - 1)), 3) END AS df FROM se")
def d5(spark, d):
    tests = beta.one_vs_rest(values(spark, d), labelled(spark, d))
    return tests.select("label", "region_id", "n", "n_rest", F.round("delta", 6).alias("delta"), F.round("t", 4).alias("t"), F.round("df", 3).alias("df"))


@query("D6_select_regions")
def d6(spark, d):
    return beta.select_regions(beta.one_vs_rest(values(spark, d), labelled(spark, d)), 5, 0.0)


@query("E5_top_loci", f"WITH {OBS}, mn AS (SELECT locus_key, avg(beta) AS m FROM ob GROUP BY 1) SELECT sample_id, locus_key, round(beta - m, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(beta - m, 9) DESC, locus_key) AS rn FROM ob JOIN mn USING (locus_key)) WHERE rn <= 3")
def e5(spark, d):
    obs = observations(spark, d)
    means = obs.groupBy("locus_key").agg(F.avg("beta").alias("mean_beta"))
    return rounded(beta.top_contributions(obs, means, 3).drop("rank"))


# Calls and fragments


@query("C8_call_filter", "SELECT (sum(n) - sum(k))::BIGINT AS calls_dropped, count(*) FILTER (k = 0) AS fragments_emptied FROM (SELECT fragment_id, count(*) AS n, count(*) FILTER (locus_key % 7 < 5) AS k FROM v_calls GROUP BY sample_id, fragment_id)")
def c8(spark, d):
    c = view(spark, d, "v_calls")
    return calls.filter_stats(c, c.where("locus_key % 7 < 5"))


@query("C9_merge_mates", f"WITH {MERGED} SELECT * FROM mg")
def c9(spark, d):
    return calls.merge_mates(view(spark, d, "v_calls"))


@query("C9_mate_stats", "SELECT count(DISTINCT (sample_id, fragment_id)) AS fragments, count(*) AS calls, count(*) FILTER (m > 1) AS both_mates, count(*) FILTER (lo <> hi) AS conflicts FROM (SELECT sample_id, fragment_id, min(state) AS lo, max(state) AS hi, count(DISTINCT mate) AS m FROM v_calls GROUP BY sample_id, fragment_id, locus_key)")
def c9b(spark, d):
    return calls.mate_stats(view(spark, d, "v_calls"))


HELD = f"ho AS (SELECT DISTINCT locus_key FROM v_calls WHERE {seeded_hash(17, 'locus_key')} < 858993459)"


@query("C11_heldout_loci", f"WITH {HELD} SELECT locus_key FROM ho")
def c11(spark, d):
    return calls.heldout(view(spark, d, "v_calls"), 0.2, 17)


@query("C12_fragments_excluding", f"WITH {HELD} SELECT DISTINCT sample_id, fragment_id FROM v_calls WHERE (sample_id, fragment_id) NOT IN (SELECT (sample_id, fragment_id) FROM v_calls JOIN ho USING (locus_key))")
def c12(spark, d):
    c = view(spark, d, "v_calls")
    return calls.fragments_touching(c, calls.heldout(c, 0.2, 17), "exclude")


@query("C12_fragments_only", f"WITH {HELD} SELECT DISTINCT sample_id, fragment_id FROM v_calls WHERE (sample_id, fragment_id) IN (SELECT (sample_id, fragment_id) FROM v_calls JOIN ho USING (locus_key))")
def c12b(spark, d):
    c = view(spark, d, "v_calls")
    return calls.fragments_touching(c, calls.heldout(c, 0.2, 17), "only")


@query("B9_geometry", f"WITH {MERGED} SELECT fragment_id, locus_key, round(ln(1 + locus_key - min(locus_key) OVER f) / 7, 6) AS from_first, round(ln(1 + coalesce(locus_key - lag(locus_key) OVER o, 0)) / 7, 6) AS from_prev, round((row_number() OVER o - 1) / greatest(count(*) OVER f - 1, 1), 6) AS rel_rank FROM mg WINDOW f AS (PARTITION BY sample_id, fragment_id), o AS (PARTITION BY sample_id, fragment_id ORDER BY locus_key)")
def b9(spark, d):
    return rounded(calls.geometry(calls.merge_mates(view(spark, d, "v_calls"))).select("fragment_id", "locus_key", "from_first", "from_prev", "rel_rank"))


@query("E2_valid_calls", f"WITH {MERGED} SELECT sample_id, fragment_id, locus_key, state FROM (SELECT *, count(*) OVER (PARTITION BY sample_id, fragment_id) AS k, row_number() OVER (PARTITION BY sample_id, fragment_id ORDER BY locus_key) AS rn FROM mg) WHERE k >= 3 AND rn <= 4")
def e2(spark, d):
    return calls.valid_calls(calls.merge_mates(view(spark, d, "v_calls")).drop("n"), 3, 4).select("sample_id", "fragment_id", "locus_key", "state")


@query("D7_size_histogram", f"WITH {MERGED}, e AS (SELECT least(count(*), 5) AS n_cpg FROM mg GROUP BY sample_id, fragment_id) SELECT n_cpg, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM e GROUP BY 1")
def d7(spark, d):
    return rounded(calls.size_histogram(calls.merge_mates(view(spark, d, "v_calls")), 5))


@query("D8_threshold_table", f"WITH {MERGED}, e AS (SELECT count(*) AS k, sum(state) AS up FROM mg GROUP BY sample_id, fragment_id), b AS (SELECT t.threshold, e.* FROM e JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS threshold) t ON e.k >= t.threshold), g AS (SELECT threshold, count(*) AS fragments, sum(k)::BIGINT AS calls, sum(up) AS up, count(*) FILTER (up = k) AS fu, count(*) FILTER (up = 0) AS fd FROM b GROUP BY 1) SELECT threshold, fragments, calls, round(fragments / max(fragments) OVER (), 6) AS fragment_share, round(calls / max(calls) OVER (), 6) AS call_share, round(calls / fragments, 6) AS mean_cpgs, round(100 * up / calls, 6) AS pct_up, round(fu / fragments, 6) AS fully_up, round(fd / fragments, 6) AS fully_down, 5 * calls + 8 * (fragments + 1) AS bytes FROM g")
def d8(spark, d):
    return rounded(calls.threshold_table(calls.merge_mates(view(spark, d, "v_calls")).drop("n")))


@query("D10_read_stats", f"WITH {MERGED}, e AS (SELECT sample_id, count(*) AS k FROM mg GROUP BY sample_id, fragment_id) SELECT sample_id, count(*) AS n_fragments, count(*) FILTER (k >= 3) AS n_valid, round(avg(least(k, 5)) FILTER (k >= 3), 6) AS mean_cpgs FROM e GROUP BY 1")
def d10(spark, d):
    return rounded(calls.read_stats(calls.merge_mates(view(spark, d, "v_calls")), 3, 5))


PROFILE = "pf AS (SELECT mate AS read, (locus_key // 5) % 40 AS pos, count(*) AS n, sum(state)::BIGINT AS up, 100 * sum(state) / count(*) AS pct FROM v_calls GROUP BY ALL)"


def profile(spark, d):
    return calls.mbias(view(spark, d, "v_calls").withColumn("read_pos", F.expr("locus_key div 5 % 40")))


@query("D11_mbias_profile", f"WITH {PROFILE} SELECT read, pos, n, up, round(pct, 6) AS pct FROM pf")
def d11(spark, d):
    return rounded(profile(spark, d))


@query("D14_clip_metrics", f"WITH {PROFILE}, pl AS (SELECT read, median(pct) AS plateau FROM pf WHERE pos BETWEEN 10 AND 30 GROUP BY 1), h AS (SELECT pf.read, pos, pct - plateau AS x FROM pf JOIN pl ON pf.read = pl.read WHERE pos < 10) SELECT read, round(avg(abs(x)), 6) AS abs_dev, round(avg(x), 6) AS signed_dev, round(arg_min(x, pos), 6) AS first_dev FROM h GROUP BY 1")
def d14(spark, d):
    p = profile(spark, d)
    return rounded(calls.first_deviation(p, calls.plateau(p, 10, 30), 10))


@query("F1_fixed_subset", f"SELECT sample_id, fragment_id FROM (SELECT sample_id, fragment_id, row_number() OVER (PARTITION BY sample_id ORDER BY {seeded_hash('17', 'sample_id', 'fragment_id')}, fragment_id) AS rn FROM (SELECT DISTINCT sample_id, fragment_id FROM v_calls)) WHERE rn <= 3")
def f1(spark, d):
    return calls.fixed_subset(view(spark, d, "v_calls").select("sample_id", "fragment_id").distinct(), "sample_id", "fragment_id", 3, 17)


# Splits and audits


@query("G2_kfold", f"""WITH a AS (SELECT patient_id, diagnosis || '|' || batch AS stratum, {seeded_hash('17', 'patient_id')} AS h FROM v_samples),
z AS (SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM a GROUP BY 1)
SELECT patient_id, ((shift + row_number() OVER (PARTITION BY a.stratum ORDER BY h, patient_id) - 1) % 5)::INTEGER AS fold FROM a JOIN z ON a.stratum = z.stratum""")
def g2(spark, d):
    return splits.fold_of(splits.patients(labelled(spark, d), ["label", "batch"]), 5, 17).select("patient_id", "fold")


FOLDS = f"""fa AS (SELECT patient_id, diagnosis AS label, diagnosis || '|' || batch AS stratum, {seeded_hash('17', 'patient_id')} AS h FROM v_samples),
fz AS (SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM fa GROUP BY 1),
fo AS (SELECT patient_id, label, fa.stratum, ((shift + row_number() OVER (PARTITION BY fa.stratum ORDER BY h, patient_id) - 1) % 5)::INTEGER AS own FROM fa JOIN fz ON fa.stratum = fz.stratum),
al AS (SELECT f.fold, patient_id, label, stratum, own = f.fold AS test FROM fo CROSS JOIN (SELECT unnest(range(5))::INTEGER AS fold) f),
ff AS (SELECT z.fold, z.m, (z.m * 20 + 99) // 100 AS want, s.ok AND s.k <= least((z.m * 20 + 99) // 100, z.m - (z.m * 20 + 99) // 100) AS fine, l.ok AND l.k <= least((z.m * 20 + 99) // 100, z.m - (z.m * 20 + 99) // 100) AS coarse
 FROM (SELECT fold, count(*) AS m FROM al WHERE NOT test GROUP BY 1) z JOIN (SELECT fold, min(c) >= 2 AS ok, count(*) AS k FROM (SELECT fold, count(*) AS c FROM al WHERE NOT test GROUP BY fold, stratum) GROUP BY 1) s ON s.fold = z.fold
 JOIN (SELECT fold, min(c) >= 2 AS ok, count(*) AS k FROM (SELECT fold, count(*) AS c FROM al WHERE NOT test GROUP BY fold, label) GROUP BY 1) l ON l.fold = z.fold),
tp AS (SELECT al.*, want, m, CASE WHEN fine THEN stratum WHEN coarse THEN label ELSE '' END AS part FROM al JOIN ff ON al.fold = ff.fold WHERE NOT test),
qb AS (SELECT fold, part, count(*) * any_value(want) // any_value(m) AS base, count(*) * any_value(want) % any_value(m) AS rest, any_value(want) AS want FROM tp GROUP BY ALL),
qc AS (SELECT fold, part, base + CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY rest DESC, part) <= want - sum(base) OVER (PARTITION BY fold) THEN 1 ELSE 0 END AS quota FROM qb),
ra AS (SELECT tp.*, row_number() OVER (PARTITION BY fold, part ORDER BY {seeded_hash('17', 'fold', 'patient_id')}, patient_id) AS rn FROM tp),
sp AS (SELECT ra.fold, patient_id, ra.label, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS split FROM ra JOIN qc ON ra.fold = qc.fold AND ra.part = qc.part UNION ALL SELECT fold, patient_id, label, 'test' FROM al WHERE test)"""


def split_table(spark, d):
    return splits.kfold_splits(splits.patients(labelled(spark, d), ["label", "batch"]), 5, 20, 17)


@query("G3_split_assignment", f"WITH {FOLDS} SELECT * FROM sp")
def g3(spark, d):
    return split_table(spark, d)


@query("G4_official_splits", f"""WITH t AS (SELECT 0 AS fold, patient_id, diagnosis AS label FROM v_samples WHERE official_split = 'train'),
q AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS m FROM t GROUP BY 1), q2 AS (SELECT label, n * ((m * 20 + 99) // 100) // m AS base, n * ((m * 20 + 99) // 100) % m AS rest, (m * 20 + 99) // 100 AS want FROM q),
q3 AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q2),
o AS (SELECT t.*, row_number() OVER (PARTITION BY label ORDER BY {seeded_hash('17|0', 'patient_id')}, patient_id) AS rn FROM t)
SELECT fold, patient_id, o.label, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS split FROM o JOIN q3 ON o.label = q3.label UNION ALL SELECT 0, patient_id, diagnosis, 'test' FROM v_samples WHERE official_split = 'test'""")
def g4(spark, d):
    return splits.official_splits(labelled(spark, d), 20, 17)


@query("G5_cross_batch", "SELECT fold, 'test' AS split, count(*) AS n FROM (SELECT dense_rank() OVER (ORDER BY batch) - 1 AS fold FROM v_samples) GROUP BY 1 UNION ALL SELECT f.fold, s.split, CASE s.split WHEN 'val' THEN (f.n * 20 + 99) // 100 ELSE f.n - (f.n * 20 + 99) // 100 END FROM (SELECT b.fold, count(*) AS n FROM (SELECT DISTINCT batch, dense_rank() OVER (ORDER BY batch) - 1 AS fold FROM v_samples) b JOIN v_samples v ON v.batch <> b.batch GROUP BY 1) f CROSS JOIN (SELECT unnest(['val', 'train']) AS split) s")
def g5(spark, d):
    return splits.cross_batch_splits(labelled(spark, d), 20, 17).groupBy(F.col("fold").cast("long").alias("fold"), "split").agg(F.count("*").alias("n"))


LEAKY = """tb AS (SELECT f.fold, patient_id, diagnosis AS label, CASE (patient_id + f.fold) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM v_samples CROSS JOIN (SELECT unnest(range(5))::INTEGER AS fold) f),
lk AS (SELECT * FROM tb WHERE NOT (fold = 4 AND split = 'val') UNION ALL SELECT fold, patient_id, label, 'train' FROM tb WHERE patient_id % 37 = fold)"""


def leaky_splits(spark, d):
    """A split table with leaks: some patients are in train a second time, and the last fold has no validation part."""
    people = view(spark, d, "v_samples").select("patient_id", F.col("diagnosis").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    at = (F.col("patient_id") + F.col("fold")) % 5
    table = people.select("fold", "patient_id", "label", F.when(at == 0, "test").when(at == 1, "val").otherwise("train").alias("split"))
    again = table.where("patient_id % 37 = fold").withColumn("split", F.lit("train"))
    return table.where("not (fold = 4 and split = 'val')").union(again)


@query("G6_leakage", f"WITH {LEAKY}, p AS (SELECT fold, patient_id, count(*) AS n, count(DISTINCT split) AS k FROM lk GROUP BY ALL), m AS (SELECT fold, 3 - count(DISTINCT split) AS missing_splits FROM lk GROUP BY 1) SELECT p.fold, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (k > 1) AS spanning, any_value(missing_splits) AS missing_splits FROM p JOIN m ON p.fold = m.fold GROUP BY 1")
def g6(spark, d):
    return splits.leakage(leaky_splits(spark, d))


@query("D18_contingency", "SELECT diagnosis, batch, count(*) AS n FROM v_samples GROUP BY ALL")
def d18(spark, d):
    return audit.contingency(view(spark, d, "v_samples"), "diagnosis", "batch")


@query("D19_chi_square", "WITH c AS (SELECT diagnosis, batch, count(*) AS o FROM v_samples GROUP BY ALL), e AS (SELECT o, sum(o) OVER (PARTITION BY diagnosis) * sum(o) OVER (PARTITION BY batch) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c) SELECT any_value(n)::BIGINT AS n, 4::BIGINT AS dof, round(sum((o - e) * (o - e) / e), 6) AS chi2, round(min(e), 6) AS min_expected, round(avg(CASE WHEN e >= 5 THEN 1 ELSE 0 END), 6) AS share_expected_5, round(sqrt(sum((o - e) * (o - e) / e) / any_value(n)), 6) AS cramers_v FROM e")
def d19(spark, d):
    return rounded(audit.chi_square(view(spark, d, "v_samples"), "diagnosis", "batch"))


@query("D19_chi_square_p")
def d19b(spark, d):
    return rounded(audit.chi_square_p(view(spark, d, "v_samples"), "diagnosis", "batch"))


@query("D21_confounded", "SELECT diagnosis AS label, min(b) AS batch FROM (SELECT diagnosis, CASE WHEN diagnosis = 'BUILDING' THEN 'B0' ELSE batch END AS b FROM v_samples) GROUP BY 1 HAVING count(DISTINCT b) = 1")
def d21(spark, d):
    planted = F.when(F.col("diagnosis") == "BUILDING", "B0").otherwise(F.col("batch"))
    return splits.confounded_classes(labelled(spark, d).withColumn("batch", planted))


@query("D22_robust_classes", "SELECT label, min(n) AS fewest FROM (SELECT diagnosis AS label, batch, count(DISTINCT patient_id) AS n FROM v_samples GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2 AND min(n) >= 10")
def d22(spark, d):
    return splits.robust_classes(labelled(spark, d), 10)


@query("D17_group_summaries", "SELECT coalesce(batch, 'all') AS batch, coalesce(diagnosis, 'all') AS diagnosis, count(*) AS n, round(avg(age), 4) AS mean FROM v_samples GROUP BY GROUPING SETS ((), (batch), (diagnosis))")
def d17(spark, d):
    return rounded(audit.group_summaries(view(spark, d, "v_samples"), "age"), 4)


@query("D33_grouped_medians", "SELECT diagnosis, batch, round(median(age), 4) AS median, count(*) AS n FROM v_samples GROUP BY ALL")
def d33(spark, d):
    return rounded(audit.grouped_medians(view(spark, d, "v_samples"), ["diagnosis", "batch"], "age"), 4)


RANKS = "rk AS (SELECT diagnosis, batch, age, rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2 AS r FROM v_samples), ti AS (SELECT sum(k::DOUBLE * k * k - k) AS t FROM (SELECT count(*) AS k FROM v_samples GROUP BY age))"


@query("D32_kruskal_wallis", f"WITH {RANKS}, g AS (SELECT count(*) AS k, sum(r) AS s FROM rk GROUP BY diagnosis), n AS (SELECT count(*)::DOUBLE AS n FROM rk) SELECT (SELECT count(*) FROM g) AS k, any_value(n.n)::BIGINT AS n, round((12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(s * s / k) - 3 * (any_value(n.n) + 1)) / (1 - any_value(t) / (any_value(n.n) ** 3 - any_value(n.n))), 6) AS h, round(1 - any_value(t) / (any_value(n.n) ** 3 - any_value(n.n)), 6) AS tie FROM g, n, ti")
def d32(spark, d):
    return rounded(metrics.rank_tests(view(spark, d, "v_samples").select("diagnosis", "age"), "diagnosis", "age"))


@query("D32_mann_whitney", f"WITH {RANKS}, g AS (SELECT count(*) FILTER (batch = 'B0') AS n1, count(*) FILTER (batch <> 'B0') AS n2, sum(r) FILTER (batch = 'B0') AS s FROM rk), u AS (SELECT n1, n2, s - n1 * (n1 + 1) / 2 AS u, t, (n1 + n2)::DOUBLE AS n FROM g, ti) SELECT n1, n2, round(u, 6) AS u, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))), 6) AS z FROM u")
def d32b(spark, d):
    return rounded(metrics.mann_whitney(view(spark, d, "v_samples").select("batch", "age"), "batch", "age", "B0"))


@query("E1_sessions", "WITH s AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS s FROM v_events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM s) SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY ALL")
def e1s(spark, d):
    return rounded(audit.sessions(view(spark, d, "v_events"), 1800), 4)


# Predictions


@query("D23_confusion", f"WITH {TOP} SELECT arm, y, label, count(*) AS n FROM top GROUP BY ALL")
def d23(spark, d):
    return metrics.confusion(metrics.predicted(predictions(spark, d), ["arm"]), ["arm"])


PER = TOP + ", per AS (SELECT arm, c.cls, count(*) AS total, count(*) FILTER (y = c.cls) AS support, count(*) FILTER (label = c.cls) AS predicted, count(*) FILTER (y = c.cls AND label = c.cls) AS hits FROM top CROSS JOIN (SELECT unnest(range(10)) AS cls) c GROUP BY ALL), pm AS (SELECT *, hits / nullif(support, 0) AS sens, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM per)"


@query("D23_class_metrics", f"WITH {PER} SELECT arm, cls::INTEGER AS cls, support, predicted, hits, round(sens, 6) AS sensitivity, round((total - support - predicted + hits) / nullif(total - support, 0), 6) AS specificity, round(f1, 6) AS f1 FROM pm")
def d23b(spark, d):
    return rounded(metrics.class_metrics(metrics.predicted(predictions(spark, d), ["arm"]), 10, ["arm"]).drop("total"))


@query("D24_summary_metrics", f"WITH {PER}, s2 AS (SELECT arm, avg(CASE WHEN y IN (c1, c2) THEN 1 ELSE 0 END) AS top2 FROM (SELECT arm, sample_id, any_value(y) AS y, min(cls) FILTER (rn = 1) AS c1, min(cls) FILTER (rn = 2) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY arm, sample_id ORDER BY prob DESC, cls) AS rn FROM pr) GROUP BY arm, sample_id) GROUP BY arm), ll AS (SELECT arm, -avg(ln(least(greatest(prob, 1e-12), 1))) AS loss FROM pr WHERE cls = y GROUP BY arm) SELECT pm.arm, round(sum(hits) / max(total), 6) AS accuracy, round(avg(sens), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(any_value(top2), 6) AS top2_accuracy, round(any_value(loss), 6) AS log_loss FROM pm JOIN s2 ON pm.arm = s2.arm JOIN ll ON pm.arm = ll.arm GROUP BY pm.arm")
def d24(spark, d):
    return rounded(metrics.summary_metrics(predictions(spark, d), 10, ["arm"]))


@query("D25_calibration", f"WITH {TOP}, b AS (SELECT arm, ceil(conf * 10) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN y = label THEN 1 ELSE 0 END) AS a FROM top GROUP BY ALL) SELECT arm, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def d25(spark, d):
    return rounded(metrics.calibration_error(metrics.predicted(predictions(spark, d), ["arm"]), ["arm"]))


@query("D26_auroc", f"WITH {PRED}, q AS (SELECT arm, cls, prob, y = cls AS pos, rank() OVER (PARTITION BY arm, cls ORDER BY prob) + (count(*) OVER (PARTITION BY arm, cls, prob) - 1) / 2 AS r FROM pr), z AS (SELECT arm, cls, count(*) AS n, count(*) FILTER (pos) AS p, sum(r) FILTER (pos) AS s FROM q GROUP BY ALL) SELECT arm, round(avg((s - p * (p + 1) / 2) / nullif(p * (n - p), 0)), 6) AS macro_auroc FROM z GROUP BY 1")
def d26(spark, d):
    return rounded(metrics.macro_auroc(predictions(spark, d), ["arm"]))


@query("D27_probability_check", f"WITH {PRED}, s AS (SELECT sum(prob) AS s, count(*) AS k FROM pr GROUP BY arm, sample_id) SELECT count(*) FILTER (k <> 10) AS wrong_shape, round(max(abs(s - 1)), 6) AS largest_gap FROM s")
def d27(spark, d):
    return rounded(metrics.probability_violations(predictions(spark, d), ["arm"], 10))


SEEDED = PRED + f", sd AS (SELECT arm, sample_id, y, cls, s.seed, prob * (1 + {plain_hash('s.seed', 'sample_id', 'cls')} / 4294967296 / 10) AS prob FROM pr CROSS JOIN (SELECT unnest([17, 42, 97]) AS seed) s)"


def seeded(spark, d):
    each = predictions(spark, d).withColumn("seed", F.explode(F.array(F.lit(17), F.lit(42), F.lit(97))))
    text = F.concat_ws("|", F.col("seed").cast("string"), F.col("sample_id").cast("string"), F.col("cls").cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return each.withColumn("prob", F.col("prob") * (1 + h / float(1 << 32) / 10))


@query("D28_seed_ensemble", f"WITH {SEEDED} SELECT arm, sample_id, y, cls, round(avg(prob), 6) AS prob, count(DISTINCT seed) AS seeds FROM sd GROUP BY ALL")
def d28(spark, d):
    return rounded(metrics.seed_ensemble(seeded(spark, d)))


@query("D30_win_rates", f"WITH {SEEDED}, t AS (SELECT arm, seed, sample_id, y, arg_max(cls, prob) AS label FROM sd GROUP BY arm, seed, sample_id, y), r AS (SELECT arm, seed, sample_id % 5 AS fold, avg(CASE WHEN y = label THEN 1 ELSE 0 END) AS v FROM t GROUP BY ALL) SELECT b.arm::VARCHAR AS arm, count(*) AS cells, count(*) FILTER (a.v > b.v) AS wins, round(avg(a.v - b.v), 6) AS mean_delta FROM r a JOIN r b ON a.seed = b.seed AND a.fold = b.fold AND a.arm = 0 AND b.arm <> 0 GROUP BY b.arm")
def d30(spark, d):
    top = metrics.predicted(seeded(spark, d), ["arm", "seed"])
    runs = top.groupBy(F.col("arm").cast("string").alias("arm"), "seed", (F.col("sample_id") % 5).alias("fold")).agg(F.avg((F.col("y") == F.col("label")).cast("double")).alias("value"))
    return rounded(metrics.win_rates(runs, "0"))


@query("D31_spearman", f"WITH {TOP}, q AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY conf) + (count(*) OVER (PARTITION BY arm, conf) - 1) / 2 AS a, rank() OVER (PARTITION BY arm ORDER BY sample_id) AS b FROM top) SELECT arm, count(*) AS n, round(corr(a, b), 6) AS rho FROM q GROUP BY 1")
def d31(spark, d):
    return rounded(metrics.spearman(metrics.predicted(predictions(spark, d), ["arm"]), "conf", "sample_id", ["arm"]))


REPLICATES = 2000


def arm_pair(a: int, b: int) -> str:
    return PRED + f""", pa AS (SELECT * FROM pr WHERE arm IN ({a}, {b})),
to_ AS (SELECT arm, sample_id, y, cls AS label FROM (SELECT *, row_number() OVER (PARTITION BY arm, sample_id ORDER BY prob DESC, cls) AS rn FROM pa) WHERE rn = 1)"""


# Metrics by (rep, arm) of wt (rep, arm, y, label, w) and wp (rep, arm, y, cls, prob, w), then the first arm's minus the second's.
METRICS = """ce AS (SELECT rep, arm, y, label, sum(w) AS n FROM wt GROUP BY ALL),
pe AS (SELECT rep, arm, c.cls, sum(n) AS total, coalesce(sum(n) FILTER (y = c.cls), 0) AS support, coalesce(sum(n) FILTER (label = c.cls), 0) AS predicted, coalesce(sum(n) FILTER (y = c.cls AND label = c.cls), 0) AS hits FROM ce CROSS JOIN (SELECT unnest(range(10)) AS cls) c GROUP BY ALL),
me AS (SELECT rep, arm, sum(hits) / max(total) AS accuracy, avg(hits / nullif(support, 0)) AS balanced_accuracy, avg(coalesce(2 * hits / nullif(support + predicted, 0), 0)) AS macro_f1 FROM pe GROUP BY ALL),
cn AS (SELECT rep, arm, cls, prob, sum(w) AS n, coalesce(sum(w) FILTER (y = cls), 0) AS p FROM wp GROUP BY ALL),
rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep, arm, cls ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM cn),
au AS (SELECT rep, arm, avg(auc) AS macro_auroc FROM (SELECT rep, arm, cls, (sum(r * p) - sum(p) * (sum(p) + 1) / 2) / nullif(sum(p) * (sum(n) - sum(p)), 0) AS auc FROM rk GROUP BY ALL) GROUP BY ALL),
lo_ AS (SELECT rep, arm, unnest(['accuracy', 'balanced_accuracy', 'macro_f1', 'macro_auroc']) AS metric, unnest([accuracy, balanced_accuracy, macro_f1, macro_auroc]) AS value FROM me JOIN au USING (rep, arm)),
dl AS (SELECT rep, metric, max(value) FILTER (arm = {a}) AS a, max(value) FILTER (arm <> {a}) AS b, round(max(value) FILTER (arm = {a}) - max(value) FILTER (arm <> {a}), 12) AS delta FROM lo_ GROUP BY ALL)"""


def bootstrap_sql(a: int, b: int) -> str:
    return f"""{arm_pair(a, b)}, pp AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS at, count(*) OVER (PARTITION BY y) AS n FROM to_ WHERE arm = {a}),
dr AS (SELECT s.rep, p.sample_id, count(*) AS w FROM (SELECT r.rep, y, {seeded_hash('17', 'r.rep', 'pp.y', 'pp.at')} % n AS k FROM pp CROSS JOIN (SELECT unnest(range({REPLICATES})) AS rep) r) s JOIN pp p ON s.y = p.y AND s.k = p.at GROUP BY ALL UNION ALL SELECT -1, sample_id, 1 FROM pp),
wt AS (SELECT rep, t.*, w FROM to_ t JOIN dr USING (sample_id)), wp AS (SELECT rep, pa.*, w FROM pa JOIN dr USING (sample_id)), {METRICS.format(a=a)},
bo AS (SELECT s.metric, any_value(o.a) AS a, any_value(o.b) AS b, any_value(o.delta) AS delta, quantile_cont(s.delta, 0.025) AS low, quantile_cont(s.delta, 0.975) AS high, avg(CASE WHEN s.delta <= 0 THEN 1 ELSE 0 END) AS share_le_0 FROM dl s JOIN dl o ON s.metric = o.metric AND s.rep >= 0 AND o.rep = -1 GROUP BY 1)"""


def permutation_sql(a: int, b: int) -> str:
    return f"""{arm_pair(a, b)}, sw AS (SELECT rep, sample_id, rep >= 0 AND {seeded_hash('17', 'rep', 'sample_id')} % 2 = 1 AS swap FROM (SELECT DISTINCT sample_id FROM to_) CROSS JOIN (SELECT unnest(range(-1, {REPLICATES})) AS rep)),
wt AS (SELECT rep, CASE WHEN swap THEN {a + b} - arm ELSE arm END AS arm, y, label, 1 AS w FROM to_ JOIN sw USING (sample_id)),
wp AS (SELECT rep, CASE WHEN swap THEN {a + b} - arm ELSE arm END AS arm, y, cls, prob, 1 AS w FROM pa JOIN sw USING (sample_id)), {METRICS.format(a=a)},
pm AS (SELECT s.metric, any_value(o.delta) AS delta, (count(*) FILTER (abs(s.delta) >= abs(o.delta) - 1e-12) + 1) / (count(*) + 1) AS p FROM dl s JOIN dl o ON s.metric = o.metric AND s.rep >= 0 AND o.rep = -1 GROUP BY 1)"""


def arm_table(spark, d):
    return predictions(spark, d).withColumn("arm", F.col("arm").cast("string"))


@query("J2_paired_bootstrap", f"WITH {bootstrap_sql(0, 1)} SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(share_le_0, 6) AS share_le_0 FROM bo")
def j2(spark, d):
    return rounded(resampling.paired_bootstrap(arm_table(spark, d), "0", "1", 10, REPLICATES, 17))


@query("J3_paired_permutation", f"WITH {permutation_sql(0, 1)} SELECT metric, round(delta, 6) AS delta, round(p, 6) AS p FROM pm")
def j3(spark, d):
    return rounded(resampling.paired_permutation(arm_table(spark, d), "0", "1", 10, REPLICATES, 17))


def compared_sql(a: int, b: int) -> str:
    boot = f"(WITH {bootstrap_sql(a, b)} SELECT * FROM bo)"
    perm = f"(WITH {permutation_sql(a, b)} SELECT metric, p FROM pm)"
    rest = ", ".join(f"round({c}, 6) AS {c}" for c in ("a", "b", "delta", "low", "high", "share_le_0", "p"))
    return f"SELECT '{a}' AS arm_a, '{b}' AS arm_b, metric, {rest}, (SELECT count(*) FROM embeddings) AS n FROM {boot} x JOIN {perm} y USING (metric)"


@query("J4_compare_arms", f"{compared_sql(0, 1)} UNION ALL {compared_sql(2, 5)}")
def j4(spark, d):
    return rounded(resampling.compare_arms(arm_table(spark, d), [("0", "1"), ("2", "5"), ("0", "absent")], 10, REPLICATES, 17))


# Representations and pooling


@query("D35_store_moments", "SELECT (i - 1)::INTEGER AS dim, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM (SELECT i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY 1")
def d35(spark, d):
    return rounded(represent.moments(embedding_store(spark, d)))


@query("H3_standardise", "WITH e AS (SELECT vec_id AS locus_key, (i - 1)::INTEGER AS dim, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) SELECT locus_key, dim, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 5) AS z FROM e WINDOW w AS (PARTITION BY dim)")
def h3(spark, d):
    return rounded(represent.standardise(embedding_store(spark, d)), 5)


@query("C6_gather", "SELECT vec_id AS locus_key, (i - 1)::INTEGER AS dim, round(embedding[i]::DOUBLE, 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)")
def c6(spark, d):
    store = embedding_store(spark, d)
    found = represent.gather(store.select("locus_key"), store)
    return rounded(found.select("locus_key", F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x")))


@query("F5_hash_sample", f"SELECT vec_id AS locus_key FROM embeddings ORDER BY {seeded_hash('17', 'vec_id')}, vec_id LIMIT 100")
def f5(spark, d):
    return represent.hash_sample(embedding_store(spark, d).select("locus_key"), 100, 17)


@query("F7_shuffled_control", f"WITH a AS (SELECT vec_id AS k, row_number() OVER (ORDER BY {seeded_hash('17', 'vec_id')}, vec_id) AS at, row_number() OVER (ORDER BY {seeded_hash('17-source', 'vec_id')}, vec_id) AS bt FROM embeddings) SELECT a.k AS locus_key, b.k AS source FROM a JOIN a b ON a.at = b.bt")
def f7(spark, d):
    return represent.shuffled_control(embedding_store(spark, d), 17)


@query("H1_projection")
def h1(spark, d):
    return represent.project(embedding_store(spark, d), 8, 2000, 17)[0]


def pooled_rows(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.col("label").alias("bag"), (5 * F.get("embedding", F.lit(0)).cast("double")).alias("score"), F.col("embedding").cast("array<double>").alias("vec"))


POOL = "SELECT label AS bag, (i - 1)::INTEGER AS dim, round(sum(exp(5 * embedding[1]::DOUBLE) * embedding[i]::DOUBLE) / sum(exp(5 * embedding[1]::DOUBLE)), 6) AS pooled FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL"


@query("I1_softmax_pool", POOL)
def i1(spark, d):
    return rounded(pooling.softmax_pool(pooled_rows(spark, d), "bag"))


@query("I2_merged_pool", POOL)
def i2(spark, d):
    rows = pooled_rows(spark, d).withColumn("part", F.col("vec_id") % 7)
    return rounded(pooling.merge_parts(pooling.pool_parts(rows, "bag", "part"), "bag"))


@query("I3_mean_max_pool", "SELECT label AS bag, (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(max(embedding[i]::DOUBLE), 6) AS max FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL")
def i3(spark, d):
    return rounded(pooling.mean_max_pool(pooled_rows(spark, d), "bag"))


# Models: fitted inside a fold, checked by tests


@query("K5_summary_logistic")
def k5(spark, d):
    obs = observations(spark, d)
    summary = beta.sample_summary(obs).na.fill(0.0)
    long = summary.select("sample_id", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("n_observed", "mean_beta", "var_beta", "mean_coverage")))).alias("f")).select("sample_id", "f.*")
    samples = labelled(spark, d).select("sample_id", "label_idx", F.col("official_split").alias("split"))
    return models.fit_predict(models.assemble(long, "sample_id", "name", "value"), samples)


def with_regions(spark, d, samples):
    """samples with their values of regions as a map `held`, written once for all folds."""
    return shared.kept(samples.join(beta.by_sample(values(spark, d, WIDE)), "sample_id", "left"))


def selected_features(fit, placed):
    """(sample_id, features) of K3, K4 and K6: regions observed in most fit samples, as in D4, then selected and filled on them."""
    return models.vectors(beta.filled(placed, beta.chosen_regions(fit, SEEN, 4)), "sample_id", "values")


def region_features(spark, d):
    """(features, samples) of K3 and K4."""
    samples = with_regions(spark, d, labelled(spark, d).select("sample_id", "label", "label_idx", F.col("official_split").alias("split")))
    return selected_features(samples.where("split = 'train'"), samples), samples.select("sample_id", "label_idx", "split")


@query("K3_region_logistic")
def k3(spark, d):
    return models.fit_predict(*region_features(spark, d))


@query("K4_region_boosting")
def k4b(spark, d):
    return models.fit_predict(*region_features(spark, d), boosts=300)


# Quality control and consistency


@query("B18_fingerprint", "SELECT sample_id, count(*) AS n, bit_xor(('0x' || substr(h, 1, 8))::BIGINT) AS print, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS total FROM (SELECT sample_id, md5('|' || locus_key || '|' || state) AS h FROM v_calls) GROUP BY 1")
def b18(spark, d):
    return qc.fingerprint(view(spark, d, "v_calls"), ["locus_key", "state"], ["sample_id"])


@query("C16_same_samples", "SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM (SELECT DISTINCT sample_id AS k FROM v_obs) a FULL JOIN (SELECT DISTINCT sample_id AS k FROM v_samples WHERE batch = 'B0') b ON a.k = b.k")
def c16(spark, d):
    return qc.same_keys(view(spark, d, "v_obs"), view(spark, d, "v_samples").where("batch = 'B0'"), "sample_id")


@query("C17_open_cells", "SELECT arm, fold FROM (SELECT unnest(range(3)) AS fold) CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS arm) WHERE (arm, fold) NOT IN (SELECT DISTINCT chr((97 + c_custkey % 2)::INTEGER), c_nationkey % 3 FROM customer)")
def c17(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    done = rows.select(F.char(97 + F.col("c_custkey") % 2).alias("arm"), (F.col("c_nationkey") % 3).cast("long").alias("fold")).distinct()
    return qc.open_cells(done, {"arm": ["a", "b", "c"], "fold": [0, 1, 2]}).select("arm", F.col("fold").cast("long").alias("fold"))


@query("C20_regression", "WITH a AS (SELECT sample_id * 4294967296 * 64 + locus_key AS k, * FROM v_obs) SELECT 'c_count' AS \"column\", count(*) AS equal, 0::BIGINT AS different FROM a UNION ALL SELECT 'ct_count', count(*) FILTER (locus_key % 10 <> 0), count(*) FILTER (locus_key % 10 = 0) FROM a")
def c20(spark, d):
    rows = view(spark, d, "v_obs").withColumn("k", F.col("sample_id") * (1 << 38) + F.col("locus_key"))
    again = rows.withColumn("ct_count", F.col("ct_count") + F.when(F.col("locus_key") % 10 == 0, 1).otherwise(0))
    return qc.regression(rows, again, "k", ["c_count", "ct_count"])


PAIRS = "pp AS (SELECT batch, count(*) * 3 + sample_id % 5 AS pairs, CASE WHEN sample_id % 3 = 0 THEN 5 * count(*) + 8 END AS bytes FROM v_calls JOIN v_samples USING (sample_id) GROUP BY sample_id, batch)"


@query("D9_extrapolation", f"WITH {PAIRS}, a AS (SELECT median(bytes / pairs) AS r FROM pp) SELECT batch, count(*) AS n, round(coalesce(median(bytes / pairs), any_value(a.r)), 6) AS ratio, round(sum(pairs) * coalesce(median(bytes / pairs), any_value(a.r)), 4) AS expected FROM pp, a GROUP BY 1")
def d9(spark, d):
    rows = view(spark, d, "v_calls").join(view(spark, d, "v_samples").select("sample_id", "batch"), "sample_id").groupBy("sample_id", "batch").agg(F.count("*").alias("n"))
    per = rows.select("batch", (F.col("n") * 3 + F.col("sample_id") % 5).alias("pairs"), F.when(F.col("sample_id") % 3 == 0, 5 * F.col("n") + 8).alias("bytes"))
    out = qc.extrapolated_bytes(per)
    return out.select("batch", "n", F.round("ratio", 6).alias("ratio"), F.round("expected", 4).alias("expected"))


ENDS = "en AS (SELECT mate, state, locus_key - min(locus_key) OVER w AS d5, max(locus_key) OVER w - locus_key AS d3 FROM v_calls WINDOW w AS (PARTITION BY sample_id, fragment_id)), ed AS (SELECT 5 AS \"end\", mate AS read, d5 AS dist, state FROM en UNION ALL SELECT 3, mate, d3, state FROM en), ep AS (SELECT \"end\", read, dist, count(*) AS n, sum(state)::BIGINT AS up FROM ed WHERE dist < 600 GROUP BY ALL)"


@query("D12_end_distances", f"WITH {ENDS} SELECT * FROM ep")
def d12(spark, d):
    return qc.end_distances(view(spark, d, "v_calls"), 600)


@query("D15_end_excess", f"WITH {ENDS} SELECT \"end\", read, round(100 * (sum(up) FILTER (dist < 10) / sum(n) FILTER (dist < 10) - sum(up) FILTER (dist BETWEEN 10 AND 100) / sum(n) FILTER (dist BETWEEN 10 AND 100)), 6) AS excess FROM ep GROUP BY ALL")
def d15(spark, d):
    return rounded(qc.end_excess(qc.end_distances(view(spark, d, "v_calls"), 600), 10, 10, 100))


@query("D13_clip_grid", "WITH g AS (SELECT unnest([{'a': 0, 'b': 0}, {'a': 5, 'b': 0}, {'a': 5, 'b': 10}]) AS g), m AS (SELECT g.a AS clip_1, g.b AS clip_2, min(state) AS lo, max(state) AS hi FROM v_calls CROSS JOIN g WHERE locus_key // 5 % 40 >= CASE WHEN mate = 1 THEN g.a ELSE g.b END GROUP BY g.a, g.b, sample_id, fragment_id, locus_key) SELECT clip_1, clip_2, count(*) FILTER (lo = hi) AS calls, (sum(lo) FILTER (lo = hi))::BIGINT AS up, count(*) FILTER (lo <> hi) AS conflicts FROM m GROUP BY ALL")
def d13(spark, d):
    return qc.clip_grid(view(spark, d, "v_calls").withColumn("read_pos", F.expr("locus_key div 5 % 40")), [(0, 0), (5, 0), (5, 10)])


@query("D20_fisher_tables", "WITH c AS (SELECT diagnosis AS label, count(*) FILTER (batch = 'B0') AS a, count(*) FILTER (batch <> 'B0') AS b FROM v_samples GROUP BY 1), t AS (SELECT *, (sum(a) OVER () - a)::BIGINT AS c, (sum(b) OVER () - b)::BIGINT AS d FROM c) SELECT *, round(a * d / (b * c), 6) AS odds FROM t")
def d20(spark, d):
    flagged = labelled(spark, d).withColumn("flag", F.when(F.col("batch") == "B0", 1).otherwise(0))
    return rounded(qc.fisher_by_class(flagged, "label", "flag").drop("p"))


@query("D20_fisher_p")
def d20b(spark, d):
    flagged = labelled(spark, d).withColumn("flag", F.when(F.col("batch") == "B0", 1).otherwise(0))
    return rounded(qc.fisher_by_class(flagged, "label", "flag"))


@query("D29_arm_spread", f"WITH {SEEDED}, t AS (SELECT arm, seed, y, arg_max(cls, prob) AS label FROM sd GROUP BY arm, seed, sample_id, y), v AS (SELECT arm, seed, avg(CASE WHEN y = label THEN 1 ELSE 0 END) AS v FROM t GROUP BY ALL) SELECT arm, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM v GROUP BY 1")
def d29(spark, d):
    top = metrics.predicted(seeded(spark, d), ["arm", "seed"])
    return rounded(qc.arm_spread(top.select("arm", "seed", (F.col("y") == F.col("label")).cast("double").alias("value"))))


@query("D34_filter_totals", "SELECT sample_id % 4 AS shard, CASE WHEN context <> 'CG' THEN 'non_cg' WHEN code > 22 THEN 'other_contig' WHEN ct_count < 4 THEN 'low_coverage' ELSE 'kept' END AS reason, count(*) AS n FROM v_methratio GROUP BY ALL")
def d34(spark, d):
    rows = view(spark, d, "v_methratio").withColumn("shard", F.col("sample_id") % 4)
    return rows.groupBy("shard", beta.scan_reason(F.col("context"), F.col("code"), F.col("ct_count"), 4).alias("reason")).agg(F.count("*").alias("n"))


@query("F2_random_bag", f"WITH i AS (SELECT DISTINCT sample_id, fragment_id FROM v_calls), p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {seeded_hash(17, 'sample_id', 'fragment_id')}, fragment_id) - 1 AS place, count(*) OVER (PARTITION BY sample_id) AS n FROM i), s AS (SELECT DISTINCT sample_id, n, unnest(range(4)) AS slot FROM p WHERE n < 4) SELECT sample_id, place AS slot, fragment_id FROM p WHERE n >= 4 AND place < 4 UNION ALL SELECT s.sample_id, s.slot, p.fragment_id FROM s JOIN p ON s.sample_id = p.sample_id AND p.place = {seeded_hash('17-slot', 's.sample_id', 's.slot')} % s.n")
def f2(spark, d):
    bag = qc.random_bag(view(spark, d, "v_calls").select("sample_id", "fragment_id").distinct(), "sample_id", "fragment_id", 4, 17)
    return bag.withColumn("slot", F.col("slot").cast("long"))


@query("F3_balanced_schedule", f"WITH p AS (SELECT diagnosis AS label, sample_id, row_number() OVER (PARTITION BY diagnosis ORDER BY sample_id) - 1 AS at FROM v_samples), c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS cls FROM p GROUP BY 1), s AS (SELECT unnest(range(1000)) AS slot), x AS (SELECT slot, {seeded_hash('17-class', 'slot')} % (SELECT count(*) FROM c) AS cls FROM s) SELECT slot, p.label, sample_id FROM x JOIN c ON x.cls = c.cls JOIN p ON p.label = c.label AND p.at = {seeded_hash('17-sample', 'slot')} % c.n")
def f3(spark, d):
    return qc.balanced_schedule(labelled(spark, d), 1000, 17)


@query("G1_patients", "SELECT patient_id, diagnosis AS label, diagnosis || '|' || batch AS stratum, 1::BIGINT AS n_labels FROM v_samples")
def g1(spark, d):
    return splits.patients(labelled(spark, d), ["label", "batch"])


@query("G9_content_twins", f"WITH {LEAKY}, ca AS (SELECT sample_id, locus_key, state FROM v_calls UNION ALL SELECT sample_id + 1000000, locus_key, state FROM v_calls WHERE sample_id % 25 = 1), co AS (SELECT sample_id, string_agg(locus_key || ':' || state, ',' ORDER BY locus_key, state) AS content FROM ca GROUP BY 1), pl AS (SELECT fold, patient_id AS sample_id, split FROM tb UNION ALL SELECT fold, patient_id + 1000000, CASE split WHEN 'test' THEN 'test' ELSE 'val' END FROM tb WHERE patient_id % 25 = 1), bo AS (SELECT pl.*, content FROM pl JOIN co ON pl.sample_id = co.sample_id), gr AS (SELECT fold, content, min(sample_id) AS twin FROM bo GROUP BY ALL HAVING count(DISTINCT split) > 1) SELECT bo.fold, twin, sample_id, split FROM bo JOIN gr ON bo.fold = gr.fold AND bo.content = gr.content")
def g9(spark, d):
    c = view(spark, d, "v_calls")
    copied = c.union(c.where("sample_id % 25 = 1").withColumn("sample_id", F.col("sample_id") + 1000000).select(c.columns))
    at = (F.col("patient_id") + F.col("fold")) % 5
    table = view(spark, d, "v_samples").select("patient_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    table = table.select("fold", "patient_id", F.when(at == 0, "test").when(at == 1, "val").otherwise("train").alias("split"))
    more = table.where("patient_id % 25 = 1").select("fold", (F.col("patient_id") + 1000000).alias("patient_id"), F.when(F.col("split") == "test", "test").otherwise("val").alias("split"))
    return splits.content_twins(copied, table.union(more))


@query("G11_completeness", "SELECT count(*) FILTER (p.k IS NULL) AS missing, count(*) FILTER (e.sample_id IS NULL) AS unexpected, count(*) FILTER (p.k > 1) AS repeated FROM (SELECT sample_id, count(*) AS k FROM (SELECT sample_id FROM v_samples WHERE sample_id % 3 <> 0 UNION ALL SELECT sample_id FROM v_samples WHERE sample_id % 7 = 0) GROUP BY 1) p FULL JOIN (SELECT sample_id FROM v_samples WHERE official_split = 'test') e ON p.sample_id = e.sample_id")
def g11(spark, d):
    s = view(spark, d, "v_samples").select("sample_id", "official_split")
    return qc.completeness(s.where("sample_id % 3 <> 0").union(s.where("sample_id % 7 = 0")), s.where("official_split = 'test'"))


@query("G12_model_choice", "WITH m AS (SELECT diagnosis AS candidate, ascii(diagnosis) AS place, avg(age) AS mean FROM v_samples GROUP BY ALL), n AS (SELECT * FROM m WHERE mean >= (SELECT max(mean) FROM m) - 200) SELECT arg_min(candidate, place) AS candidate, round(arg_min(mean, place), 4) AS mean FROM n")
def g12(spark, d):
    s = view(spark, d, "v_samples").select(F.col("diagnosis").alias("candidate"), F.ascii("diagnosis").alias("place"), F.col("age").alias("value"))
    return rounded(qc.simplest_within(s, 200.0), 4)


@query("G13_recheck", "WITH m AS (SELECT diagnosis AS name, avg(age) AS v FROM v_samples GROUP BY 1) SELECT name, round(v, 4) AS recomputed, round(v + 1, 4) AS stored FROM m WHERE name < 'F'")
def g13(spark, d):
    m = view(spark, d, "v_samples").groupBy(F.col("diagnosis").alias("name")).agg(F.avg("age").alias("value"))
    return rounded(qc.recheck(m, m.withColumn("value", F.col("value") + F.when(F.col("name") < "F", 1.0).otherwise(0.0)), "name", 1e-6), 4)


@query("K4_region_trees")
def k4(spark, d):
    return models.fit_predict(*region_features(spark, d), trees=300)


# Sequence text


@query("A9_motif_positions", "WITH t AS (SELECT doc_id, lower(replace(text, chr(10), '')) AS t FROM documents), u AS (SELECT doc_id, t, unnest(range(1, length(t))) AS pos FROM t) SELECT doc_id, pos FROM u WHERE t[pos:pos + 1] = 'th'")
def a9(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return text.motif_positions(lines, "doc_id", "th").withColumn("pos", F.col("pos").cast("long"))


CONTEXTS = "pc AS (SELECT l_returnflag AS context, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS read, (l_orderkey % 40)::BIGINT AS pos, count(*) AS n, 100 * avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS pct FROM lineitem GROUP BY ALL)"


def context_profile(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    read = F.when(F.col("l_linestatus") == "F", 1).otherwise(2)
    return rows.groupBy(F.col("l_returnflag").alias("context"), read.alias("read"), (F.col("l_orderkey") % 40).alias("pos")).agg(F.count("*").alias("n"), (100 * F.avg((F.col("l_quantity") > 25).cast("int"))).alias("pct"))


@query("D16_context_excess", f"WITH {CONTEXTS}, lv AS (SELECT context, read, median(pct) AS level FROM pc WHERE pos BETWEEN 10 AND 30 GROUP BY ALL), h AS (SELECT context, read, avg(pct) AS head FROM (SELECT *, row_number() OVER (PARTITION BY context, read ORDER BY pos) AS rn FROM pc) WHERE rn <= 5 GROUP BY ALL) SELECT h.context, h.read, round(head - level, 6) AS excess FROM h JOIN lv ON h.context = lv.context AND h.read = lv.read")
def d16(spark, d):
    return rounded(qc.noncpg_excess(context_profile(spark, d), 5, 10, 30))


@query("D36_profile_check", f"WITH {CONTEXTS}, a AS (SELECT * FROM pc WHERE context = 'N'), b AS (SELECT * FROM pc WHERE context = 'R') SELECT a.read, count(*) AS positions, round(max(abs(a.pct - b.pct)), 6) AS largest_gap, round(sum(a.n) / sum(b.n), 6) AS coverage_ratio FROM a JOIN b ON a.read = b.read AND a.pos = b.pos WHERE a.n >= 3 AND b.n >= 3 GROUP BY 1")
def d36(spark, d):
    p = context_profile(spark, d)
    return rounded(qc.profile_check(p.where("context = 'N'"), p.where("context = 'R'"), 3))


@query("E6_tail_deviation", f"WITH {PROFILE}, pl AS (SELECT read, median(pct) AS plateau FROM pf WHERE pos BETWEEN 10 AND 30 GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY pos DESC) AS rn FROM pf) SELECT t.read, round(avg(pct - plateau), 6) AS signed_dev FROM t JOIN pl ON t.read = pl.read WHERE rn <= 10 GROUP BY 1")
def e6(spark, d):
    p = profile(spark, d)
    return rounded(qc.tail_deviation(p, calls.plateau(p, 10, 30), 10))


@query("D38_threshold_rollup", "WITH f AS (SELECT sample_id, fragment_id, count(*) AS n FROM v_calls GROUP BY ALL), s AS (SELECT t.threshold, sample_id, avg(CASE WHEN n >= t.threshold THEN 1 ELSE 0 END) AS share FROM f CROSS JOIN (SELECT unnest([1, 2, 3]) AS threshold) t GROUP BY ALL) SELECT threshold, batch, diagnosis, count(*) AS samples, round(avg(share), 6) AS mean, round(min(share), 6) AS low, round(max(share), 6) AS high FROM s JOIN v_samples USING (sample_id) GROUP BY ALL")
def d38(spark, d):
    each = view(spark, d, "v_calls").groupBy("sample_id", "fragment_id").agg(F.count("*").alias("n"))
    by = each.select("sample_id", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("threshold"))
    share = by.groupBy("sample_id", "threshold").agg(F.avg((F.col("n") >= F.col("threshold")).cast("int")).alias("share"))
    return rounded(qc.threshold_rollup(share.join(view(spark, d, "v_samples"), "sample_id")))


@query("D39_run_rollup", "WITH f AS (SELECT sample_id, count(*) AS n FROM v_calls GROUP BY sample_id, fragment_id), r AS (SELECT sample_id, count(*) AS n_fragments, count(*) FILTER (n >= 3) AS n_valid FROM f GROUP BY 1) SELECT official_split AS split, diagnosis AS label, count(DISTINCT patient_id) AS patients, sum(n_fragments)::BIGINT AS fragments, sum(n_valid)::BIGINT AS valid FROM v_samples LEFT JOIN r USING (sample_id) GROUP BY ALL")
def d39(spark, d):
    placed = labelled(spark, d).withColumnRenamed("official_split", "split")
    return qc.run_rollup(placed, calls.read_stats(view(spark, d, "v_calls"), 3, 100))


@query("H7_loading_mass", "WITH l AS (SELECT vec_id % 5 AS pc, i % 4 AS \"group\", embedding[i]::DOUBLE AS w FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)), s AS (SELECT pc, \"group\", sum(w * w) AS s FROM l GROUP BY ALL) SELECT pc, \"group\", round(s / sum(s) OVER (PARTITION BY pc), 6) AS mass FROM s")
def h7(spark, d):
    each = embedding_store(spark, d).select((F.col("locus_key") % 5).alias("pc"), F.posexplode("vec").alias("i", "w"))
    return rounded(qc.loading_mass(each.select("pc", ((F.col("i") + 1) % 4).cast("long").alias("group"), F.col("w").cast("double").alias("w"))))


def grouped_vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("vec"))


# (id, grp, head, s) of a CTE sc, pooled for each group and head.
POOLED = "pw AS (SELECT id, grp, head, exp(s - max(s) OVER (PARTITION BY grp, head)) AS e FROM sc), SELECTED AS (SELECT pw.*, embedding, unnest(range(1, 65)) AS i FROM pw JOIN embeddings ON id = vec_id) SELECT grp, (head - 1)::INTEGER AS head, (i - 1)::INTEGER AS dim, round(sum(e * embedding[i]::DOUBLE) / sum(e), 6) AS pooled FROM SELECTED GROUP BY ALL".replace("SELECTED", "px")
ROW = "list_sum(list_transform(range(1, 65), lambda i: {f}(64 * ({j} - 1) + i) * embedding[i]::DOUBLE))"
GATES, QUERIES_ASKED = 10, 3


@query("I4_gated_attention_pool", f"WITH gt AS (SELECT vec_id AS id, label AS grp, j, tanh({ROW.format(f='sin', j='j')}) / (1 + exp(-{ROW.format(f='cos', j='j')})) AS g FROM (SELECT *, unnest(range(1, 4)) AS j FROM embeddings)), sc AS (SELECT id, grp, head, sum(cos(3 * (head - 1) + j) * g) AS s FROM gt CROSS JOIN (SELECT unnest(range(1, {GATES + 1})) AS head) GROUP BY ALL), {POOLED}")
def i4(spark, d):
    """Ten heads, one a class, over three gated units."""
    x, w = np.arange(1, 1 + 3 * 64).reshape(3, 64), np.arange(1, 1 + 3 * GATES).reshape(GATES, 3)
    return rounded(pooling.pool_heads(pooling.gated_scores(grouped_vectors(spark, d), np.sin(x), np.cos(x), np.cos(w)), GATES))


@query("I5_query_attention_pool", f"WITH sc AS (SELECT vec_id AS id, label AS grp, head, {ROW.format(f='sin', j='head')} / sqrt(3) AS s FROM (SELECT *, unnest(range(1, 4)) AS head FROM embeddings)), {POOLED}")
def i5(spark, d):
    x = np.arange(1, 1 + 3 * 64).reshape(3, 64)
    return rounded(pooling.pool_heads(pooling.query_scores(grouped_vectors(spark, d), np.sin(x), np.eye(3)), QUERIES_ASKED))
