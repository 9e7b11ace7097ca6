"""Values of the queries that have no SQL twin, against closed forms, NumPy and plain enumeration."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import beta, metrics, models, represent
from locusframe.plans import registry
from locusframe.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
TESTED = {"D6_select_regions", "D19_chi_square_p", "D20_fisher_p", "D31_spearman_p", "D32_rank_tests_p", "D37_batch_shapes_p", "H1_projection", "H5_block_svd", "K3_region_logistic", "K4_region_boosting", "K4_region_trees", "K5_summary_logistic", "K6_fold_loop", "K6_region_folds"}


def run(spark, name):
    return QUERIES[name](spark, DATA)


def test_every_query_without_sql_has_a_test_here():
    assert set(QUERIES) - set(ORACLE_SQL) == TESTED


def t_tail(t, df):
    """Two-sided tail of Student's t by the trapezoid rule, in the variable that makes the range finite."""
    u = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 200_001)
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * front * np.trapezoid(np.cos(u) ** (df - 1), u)


def test_tails_of_chi_square_and_ranks(spark):
    four = lambda x: math.exp(-x / 2) * (1 + x / 2)  # noqa: E731  upper tail at four degrees of freedom
    r = run(spark, "D19_chi_square_p").first()
    assert r.dof == 4 and r.p == pytest.approx(four(r.chi2), abs=1e-5)
    both = {r.test: (r.statistic, r.p) for r in run(spark, "D32_rank_tests_p").collect()}
    assert both["kruskal_wallis"][1] == pytest.approx(four(both["kruskal_wallis"][0]), abs=1e-5)
    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    assert both["mann_whitney"][1] == pytest.approx(normal(both["mann_whitney"][0]), abs=1e-5)
    for r in run(spark, "D37_batch_shapes_p").collect():
        assert r.p == pytest.approx(normal(r.z), abs=1e-5)
    for r in run(spark, "D31_spearman_p").collect():
        assert r.p == pytest.approx(t_tail(r.rho * math.sqrt((r.n - 2) / (1 - r.rho**2)), r.n - 2), abs=1e-4)


def test_fisher_by_enumeration(spark):
    for r in run(spark, "D20_fisher_p").collect():
        row, col, n = r.a + r.b, r.a + r.c, r.a + r.b + r.c + r.d
        weight = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        assert r.p == pytest.approx(sum(w for w in weight.values() if w <= weight[r.a]) / sum(weight.values()), abs=1e-6)


def test_selected_regions_have_the_smallest_p(spark):
    tests = beta.one_vs_rest(registry.values(spark, DATA), registry.labelled(spark, DATA)).where("t is not null").collect()
    found = {}
    for r in run(spark, "D6_select_regions").collect():
        found.setdefault(r.label, []).append((r["rank"], r.region_id, r.p))
    for label in {r.label for r in tests}:
        wanted = sorted((t_tail(r.t, r.df), r.region_id) for r in tests if r.label == label)[:5]
        assert [x[1] for x in sorted(found[label])] == [x[1] for x in wanted]
        assert [x[2] for x in sorted(found[label])] == pytest.approx([x[0] for x in wanted], rel=1e-4)


def stored_vectors(spark):
    rows = registry.embedding_store(spark, DATA).orderBy("locus_key").collect()
    return [r.locus_key for r in rows], np.array([r.vec for r in rows], float)


def test_projection_is_the_principal_axes(spark):
    keys, x = stored_vectors(spark)
    found = {r.locus_key: r.vec for r in run(spark, "H1_projection").collect()}
    centred = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    scale = 1 / math.sqrt((s[:8] ** 2).mean() / len(x))
    want, got = centred @ v[:8].T * scale, np.array([found[k] for k in keys])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)


def test_block_svd_equals_numpy(spark):
    keys, x = stored_vectors(spark)
    bits = registry.embedding_store(spark, DATA).select("locus_key", represent.unpack_bits(F.unhex(F.substring(F.md5(F.col("locus_key").cast("string")), 1, 4)), 16).alias("b"))
    own = {r.locus_key: r.b for r in bits.collect()}
    b = np.array([own[k] for k in keys], float)
    whole = np.hstack([b / math.sqrt((b * b).mean()), (x - x.mean(axis=0)) / x.std(axis=0)])
    _, _, v = np.linalg.svd(whole, full_matrices=False)
    want = np.abs(whole @ v[:8].T)
    found = {(r.locus_key, r.dim): abs(r.x) for r in run(spark, "H5_block_svd").collect()}
    got = np.array([[found[(k % 22 + 1 << 32) + k, i] for i in range(8)] for k in keys])
    assert np.allclose(got, want, atol=1e-6)


def softmax_fit(x, y, w, reg):
    """Multinomial logistic regression by Newton's steps: weighted mean loss plus half reg times the squares of standardised coefficients."""
    k, n = y.max() + 1, x.shape[1] + 1
    z = np.hstack([x, np.ones((len(x), 1))])
    beta_ = np.zeros((k, n))
    w = w / w.sum()
    ridge = np.diag(np.tile(np.append(np.full(n - 1, reg), 1e-9), k))
    for _ in range(60):
        s = z @ beta_.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - np.eye(k)[y]) * w[:, None]).T @ z
        grad = grad.ravel() + ridge @ beta_.ravel()
        hess = np.zeros((k * n, k * n))
        for a in range(k):
            for b in range(k):
                d = w * p[:, a] * ((a == b) - p[:, b])
                hess[a * n : (a + 1) * n, b * n : (b + 1) * n] = z.T @ (z * d[:, None])
        beta_ = beta_ - np.linalg.solve(hess + ridge + 1e-9 * np.eye(k * n), grad).reshape(k, n)
    return beta_


def expected_probabilities(rows, x):
    """{sample_id: probabilities} of the test rows (label_idx, split) by a fit on the others with balanced weights."""
    y, fit = np.array([r.label_idx for r in rows]), np.array([r.split != "test" for r in rows])
    size = np.bincount(y[fit])
    w = fit.sum() / (len(size) * size[y[fit]])
    mean = (x[fit] * w[:, None]).sum(axis=0) / w.sum()
    std = np.sqrt((w[:, None] * (x[fit] - mean) ** 2).sum(axis=0) / (w.sum() - (w * w).sum() / w.sum()))
    coefficients = softmax_fit((x[fit] - mean) / std, y[fit], w, 1 / w.sum())
    s = np.hstack([(x - mean) / std, np.ones((len(x), 1))]) @ coefficients.T
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    return {r.sample_id: p[i] for i, r in enumerate(rows) if not fit[i]}


def furthest(found, want):
    probs = {}
    for r in found:
        probs.setdefault(r.sample_id, {})[r.cls] = r.prob
    assert set(probs) == set(want)
    return max(abs(probs[i][c] - want[i][c]) for i in want for c in range(5))


def test_summary_logistic_reaches_the_optimum(spark):
    summary = beta.sample_summary(registry.observations(spark, DATA)).na.fill(0.0)
    samples = registry.labelled(spark, DATA).select("sample_id", "label_idx", F.col("official_split").alias("split"))
    rows = samples.join(summary, "sample_id").collect()
    x = np.array([[r.mean_beta, r.mean_coverage, r.n_observed, r.var_beta] for r in rows], float)  # in the order of the names
    assert furthest(run(spark, "K5_summary_logistic").collect(), expected_probabilities(rows, x)) < 2e-3


def test_region_logistic_reaches_the_optimum(spark):
    features, samples = registry.region_features(spark, DATA)
    rows = features.join(samples, "sample_id").collect()
    x = np.array([r.features.toArray() for r in rows])
    assert furthest(run(spark, "K3_region_logistic").collect(), expected_probabilities(rows, x)) < 5e-3


@pytest.mark.parametrize("name", ["K3_region_logistic", "K4_region_trees"])
def test_region_models_predict_the_test_split_once(spark, name):
    samples = {r.sample_id: r.label_idx for r in registry.labelled(spark, DATA).where("official_split = 'test'").collect()}
    rows = run(spark, name).collect()
    assert {(r.sample_id, r.cls) for r in rows} == {(i, c) for i in samples for c in range(5)} and len(rows) == 5 * len(samples)
    total = {}
    for r in rows:
        total[r.sample_id] = total.get(r.sample_id, 0) + r.prob
        assert r.y == samples[r.sample_id] and 0 <= r.prob <= 1
    assert all(abs(t - 1) < 1e-9 for t in total.values())


def test_fold_loop_predicts_each_sample_in_its_own_fold(spark):
    own = {r.patient_id: r.fold for r in registry.split_table(spark, DATA).where("split = 'test'").collect()}
    rows = run(spark, "K6_fold_loop").collect()
    assert {(r.fold, r.sample_id, r.cls) for r in rows} == {(f, i, c) for i, f in own.items() for c in range(5)} and len(rows) == 5 * len(own)


def test_region_folds_predict_each_sample_once_a_seed(spark):
    rows = run(spark, "K6_region_folds").collect()
    people = {r.sample_id for r in registry.labelled(spark, DATA).collect()}
    for seed in (17, 42):
        own = [(r.sample_id, r.cls) for r in rows if r.seed == seed]
        assert len(own) == len(set(own)) and set(own) == {(i, c) for i in people for c in range(5)}
    assert {r.fold for r in rows} == {0, 1, 2} and {(r.seed, r.sample_id): r.fold for r in rows if r.cls == 0} != {}


def test_fold_loop_learns_and_never_sees_test_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, "ab"[i % 2], i % 2, float(i % 2 + rng.normal(0, 0.3))) for i in range(120)]
    data = spark.createDataFrame(rows, "sample_id long, patient_id long, label string, label_idx int, x double")
    table = data.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), "patient_id", F.lit("").alias("split")).withColumn("split", F.when(F.col("patient_id") % 4 == 2 * F.col("fold"), "test").when(F.col("patient_id") % 4 == 2 * F.col("fold") + 1, "test").otherwise("train"))
    seen = []

    def features(fit, placed):
        seen.append((fit.columns, placed.columns, fit.where("split = 'test'").count()))
        return models.assemble(data.select("sample_id", F.lit("x").alias("name"), F.col("x").alias("value")), "sample_id", "name", "value")

    found = models.fold_loop(features, data.select("sample_id", "patient_id", "label", "label_idx"), table).collect()
    assert all(n == 0 and "label" not in p and "label_idx" not in p for _, p, n in seen)
    right = sum((r.prob > 0.5) == (r.y == r.cls) for r in found)
    assert len(found) == 240 and right >= 0.9 * len(found)


def test_grouped_rank_tests_of_empty_sides(spark):
    rows = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 2.0), ("y", "a", 1.0), ("y", "b", 1.0)], "s string, g string, v double")
    got = {r.s: (r.n1, r.n2, r.u, r.z) for r in metrics.grouped_mann_whitney(rows, ["s"], "g", "v", "a").collect()}
    assert got == {"x": (2, 0, 0.0, None), "y": (1, 1, 0.5, None)}
