"""Trimming, storage, experiment tables, numbering, boosted trees, streams and motif search against plain loops and worked cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import audit, beta, clipping, experiments, metrics, models, numbering, pooling, qc, represent, resampling, splits
from locusframe.plans import streams
from locusframe.plans.catalog import QUERIES
from locusframe.sources import text

CALLS = "sample_id string, fragment_id long, mate int, locus_key long, state int, read_pos int, read_len int"


def merged(calls, clip_1, clip_2, extra, base):
    """(calls, up, conflicts) of one fragment by plain counting."""
    kept = [(key, state) for _, _, mate, key, state, pos, size in calls if pos >= (clip_1 - base[0] if mate == 1 else clip_2 - base[1]) and size - 1 - pos >= extra]
    states = {}
    for key, state in kept:
        states.setdefault(key, set()).add(state)
    return sum(len(s) == 1 for s in states.values()), sum(s == {1} for s in states.values()), sum(len(s) == 2 for s in states.values())


def test_trimming_of_a_worked_pair(spark):
    """Reads of 20 and 20 with calls at known places: two loci shared, one of them in dispute."""
    first = [(100, 1, 0), (110, 1, 10), (115, 0, 15)]
    second = [(110, 0, 12), (115, 0, 7), (119, 1, 3)]
    rows = [("s", 1, 1, k, s, p, 20) for k, s, p in first] + [("s", 1, 2, k, s, p, 20) for k, s, p in second]
    options = clipping.trimming_options((10, 15), (15, 20), (0, 5))
    found = {(r.clip_1, r.clip_2, r.extra_3): (r.calls, r.up, r.conflicts) for r in clipping.trim_scenarios(spark.createDataFrame(rows, CALLS), options, (10, 15), 3).collect()}
    assert found[10, 15, 0] == (3, 2, 1) and found[15, 15, 0] == (2, 1, 1) and found[10, 20, 0] == (2, 1, 1)
    assert found[10, 15, 5] == (3, 2, 1) and found[15, 20, 5] == (1, 0, 1)  # 115 is left by the first read, then 119 and 100 go as well
    assert found == {o: merged(rows, *o, (10, 15)) for o in options}


@pytest.mark.parametrize("extra", [(0, 5), tuple(range(20))])
def test_trimming_equals_plain_counting(spark, extra):
    """With twenty extra clips there are more options than one long has bits."""
    r = random.Random(1)
    rows = [(f"s{i % 3}", i % 40, r.randint(1, 2), 1000 + r.randint(0, 6), r.randint(0, 1), r.randint(0, 40), 41 + r.randint(0, 9)) for i in range(600)]
    options = clipping.trimming_options((10, 15, 20, 25), (15, 20), extra)
    fragments = {}
    for x in rows:
        fragments.setdefault(x[:2], []).append(x)
    base = None
    for by in ([], ["sample_id"]):
        found = clipping.trim_scenarios(spark.createDataFrame(rows, CALLS).repartition(5), options, (10, 15), 3, by).collect()
        assert len(found) == len(options) * (3 if by else 1)
        groups = {r.sample_id if by else None for r in found}
        for group in groups:
            mine = {(r.clip_1, r.clip_2, r.extra_3): r for r in found if not by or r.sample_id == group}
            each = {o: [merged(c, *o, (10, 15)) for k, c in fragments.items() if not by or k[0] == group] for o in options}
            base = each[10, 15, 0]
            for o, counts in each.items():
                got, total = mine[o], [sum(c[i] for c in counts) for i in range(3)]
                assert [got.calls, got.up, got.conflicts] == total and [got.frags_ge1, got.frags_ge3] == [sum(c[0] >= k for c in counts) for k in (1, 3)]
                assert got.calls_lost == pytest.approx(1 - total[0] / sum(c[0] for c in base)) and got.delta_pct == pytest.approx(100 * total[1] / total[0] - 100 * sum(c[1] for c in base) / sum(c[0] for c in base))
                assert got.frags_ge3_lost == pytest.approx(1 - sum(c[0] >= 3 for c in counts) / sum(c[0] >= 3 for c in base))
    empty = clipping.trim_scenarios(spark.createDataFrame([], CALLS), options, (10, 15), 2)
    assert empty.count() == 0


def test_clip_metrics_of_a_step(spark):
    """Ten positions at 20 percent, then 60 at 80: what is cut changes what is left, and the level stays."""
    rows = [("s", 1, p, 10, 2 if p < 10 else 8) for p in range(70)] + [("s", 2, p, 5, 4) for p in range(40)] + [("s", 1, 70, 1, 0)]
    profile = spark.createDataFrame(rows, "sample_id string, read int, pos int, n long, up long")
    found = {(r.read, r.clip): r for r in clipping.clip_metrics(profile, {1: 10, 2: 15}, {1: [10, 15, 20], 2: [15, 999]}, (40, 70), 10, 5, ["sample_id"]).collect()}
    assert set(found) == {(1, 10), (1, 15), (1, 20), (2, 15)}  # an option that leaves nothing has no row
    a, b, c = (found[1, x] for x in (10, 15, 20))
    assert [x.plateau for x in (a, b, c)] == [80.0] * 3 and [x.extra for x in (a, b, c)] == [0, 5, 10]
    assert [x.calls_lost_read for x in (a, b, c)] == pytest.approx([0, 50 / 700, 100 / 700]) and c.calls_lost_all == pytest.approx(100 / 900)
    assert [x.signed_dev for x in (a, b, c)] == pytest.approx([-60, -30, 0]) and [x.abs_dev for x in (a, b, c)] == pytest.approx([60, 30, 0]) and [x.first_dev for x in (a, b, c)] == pytest.approx([-60, -60, 0])
    assert c.pct == pytest.approx(80) and c.delta_pct == pytest.approx(80 - 100 * 500 / 700)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_follow_the_order_over_ranges(spark, kind):
    r = random.Random(4)
    ids = r.sample(range(10**6), 400)
    rows = [("ab"[i % 7 == 0], x if kind == "long" else f"id{x}") for i, x in enumerate(ids)]
    found = numbering.numbered(spark.createDataFrame(rows, f"g string, k {kind}").repartition(6), ["g"], ["k"], "at", 8).collect()
    for g in "ab":
        assert [x.k for x in sorted((x for x in found if x.g == g), key=lambda x: x.at)] == sorted(k for h, k in rows if h == g)
        assert sorted(x.at for x in found if x.g == g) == list(range(1, 1 + sum(h == g for h, _ in rows)))
    assert numbering.numbered(spark.createDataFrame([], "g string, k long"), [], ["k"], "at").count() == 0


def test_weights_are_the_draws(spark):
    people = spark.createDataFrame([(i % 3, f"p{i}") for i in range(50)], "y int, sample_id string")
    drawn = Counter((r.rep, r.sample_id) for r in resampling.stratified_resample(people, 150, 9).collect())
    ids, matrix = resampling._matrix(resampling.bootstrap_weights(people, 0, 150, 9))
    assert matrix.shape == (50, 150) and {(rep, s): int(w) for s, row in zip(ids, matrix) for rep, w in enumerate(row) if w} == dict(drawn)
    ids, late = resampling._matrix(resampling.bootstrap_weights(people, 100, 150, 9))
    assert (late == matrix[:, 100:]).all()


def test_blocks_of_replicates_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(arm, i, i % 3, c, round(float(r.random()), 2)) for arm in "ab" for i in range(40) for c in range(3)]
    pred = spark.createDataFrame(rows, "arm string, sample_id long, y int, cls int, prob double")
    whole = [{x.metric: tuple(x) for x in f(pred, "a", "b", 3, 12, 2).collect()} for f in (resampling.paired_bootstrap, resampling.paired_permutation)]
    monkeypatch.setattr(resampling, "HELD", 40 * 7)
    monkeypatch.setattr(resampling, "TILE", 64)
    for f, want in zip((resampling.paired_bootstrap, resampling.paired_permutation), whole):
        got = {x.metric: tuple(x) for x in f(pred, "a", "b", 3, 12, 2).collect()}
        assert all(got[m][1:] == pytest.approx(want[m][1:]) for m in want)


def test_forecast_falls_back_to_all_batches(spark):
    pilot = spark.createDataFrame([(1, "a", 10, 100), (1, "a", 10, 300), (1, "b", 10, 600)], "threshold int, batch string, pairs long, bytes long")
    samples = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), ("c", 100)], "batch string, pairs long")
    r = qc.storage_forecast(pilot, samples).first()
    assert (r.n_pilot, r.n_target, r.ratio_median) == (3, 4, 30.0)
    assert (r.total_median, r.total_min, r.total_max) == (135 * 30.0, 135 * 10.0, 135 * 60.0) and r.total_batch_median == 30 * 20.0 + 5 * 60.0 + 100 * 30.0


def test_thresholds_of_a_worked_sample(spark):
    """Fragments M, MM, UUU and MUMM."""
    shapes = ["1", "11", "000", "1011"]
    rows = [("s", i, 100 * i + j, int(c)) for i, shape in enumerate(shapes) for j, c in enumerate(shape)]
    found = {r.threshold: r for r in qc.sample_thresholds(spark.createDataFrame(rows, "sample_id string, fragment_id long, locus_key long, state int")).collect()}
    assert (found[1].fragments, found[1].calls, found[1].fully_up) == (4, 10, 0.5)
    assert (found[3].fragments, found[3].calls, found[3].bytes) == (2, 7, 59) and found[3].pct_up == pytest.approx(300 / 7)


def predictions(spark, lacking=()):
    r = np.random.default_rng(8)
    rows = [(arm, seed, i % 2, i, f"b{i % 3}", i % 3, c, float(p)) for arm in ("x", "y") for seed in (1, 2) for i in range(30) for c, p in enumerate(r.dirichlet(np.ones(3))) if (arm, seed, i % 2) not in lacking]
    return spark.createDataFrame(rows, "arm string, seed int, fold int, sample_id long, batch string, y int, cls int, prob double")


def test_arm_table_leaves_incomplete_arms_without_an_ensemble(spark):
    runs = predictions(spark, {("y", 2, 1)})
    assert {r.arm: (r.complete, r.missing) for r in experiments.arm_cells(runs, [1, 2], [0, 1]).collect()} == {"x": (True, ""), "y": (False, "2:1")}
    table = {(r.arm, r.metric): r for r in experiments.arm_table(runs, 3, [1, 2], [0, 1]).collect()}
    assert len(table) == 8 and all(table["y", m].seed_ensemble is None and not table["y", m].complete for m in experiments.NAMES)
    seeds = {(r.arm, r.seed, r.metric): r.value for r in experiments.metric_rows(runs, 3, ["arm", "seed"]).collect()}
    ensemble = {r.metric: r.value for r in experiments.metric_rows(metrics.seed_ensemble(runs.where("arm = 'x'")), 3, ["arm"]).collect()}
    for m in experiments.NAMES:
        own = [seeds["x", s, m] for s in (1, 2)]
        assert (table["x", m].mean, table["x", m].sd, table["x", m].seed_ensemble) == pytest.approx((np.mean(own), np.std(own, ddof=1), ensemble[m]))
    one = experiments.arm_table(runs.where("seed = 1"), 3, [1], [0, 1])
    assert {r.sd for r in one.collect()} == {None}


def test_recall_by_batch_is_over_the_classes_it_has(spark):
    rows = [("x", 1, i, "b0", 0, c, p) for i in range(4) for c, p in enumerate((0.9, 0.05, 0.05) if i else (0.1, 0.8, 0.1))]
    r = experiments.batch_metrics(spark.createDataFrame(rows, "arm string, seed int, sample_id long, batch string, y int, cls int, prob double"), 3).first()
    assert (r.n, r.present, r.accuracy, r.balanced_accuracy) == (4, 1, 0.75, 0.75)


def test_runs_with_a_metric_that_is_no_number(spark):
    rows = [("a", "m", 1.0), ("a", "n", float("nan")), ("a", "o", None), ("b", "m", 0.0), ("c", "m", float("inf"))]
    found = qc.finite_metrics(spark.createDataFrame(rows, "arm string, metric string, value double"), ["arm"])
    assert {r.arm: (r.not_finite, r.which, r.complete) for r in found.collect()} == {"a": (2, "n,o", False), "b": (0, "", True), "c": (1, "m", False)}


def test_validation_takes_the_finest_stratum_that_will_do(spark):
    rows = [(f, i, "AB"[i % 2], f"{'AB'[i % 2]}{i // 2 % 2}") for f in range(3) for i in range(40)]
    rows = [(f, i, "Z" if f == 2 and i == 0 else label, "odd" if f == 1 and i == 0 else stratum) for f, i, label, stratum in rows]
    rows += [(3, i, f"c{i}", f"d{i}") for i in range(6)]
    found = splits.carve_validation(spark.createDataFrame(rows, "fold int, patient_id long, label string, stratum string"), 20, 5).collect()
    level = {r.fold: r.level for r in found}
    assert level == {0: "stratum", 1: "label", 2: "stratum", 3: "none"}
    for fold, want in ((0, 8), (1, 8), (2, 8), (3, 2)):
        assert sum(r.split == "val" for r in found if r.fold == fold) == want
    assert Counter(r.stratum for r in found if r.fold == 0 and r.split == "val") == {"A0": 2, "A1": 2, "B0": 2, "B1": 2}
    assert Counter(r.label for r in found if r.fold == 1 and r.split == "val") == {"A": 4, "B": 4}


def test_recurrent_loci(spark):
    top = spark.createDataFrame([("s1", 5), ("s2", 5), ("s2", 7), ("s3", 7), ("s3", 9)], "sample_id string, locus_key long")
    samples = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B")], "sample_id string, label string")
    assert sorted(tuple(r) for r in beta.recurrent_loci(top, samples, 1).collect()) == [("A", 5, 2, 1), ("B", 7, 1, 1)]


def planted(spark, n=240):
    """Two features of which neither alone tells the classes apart, and four of noise."""
    r = np.random.default_rng(6)
    x = r.uniform(-1, 1, (n, 6))
    y = (x[:, 0] > 0).astype(int) * 2 + (x[:, 1] > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), "test" if i % 3 == 0 else "train") for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, v array<double>, label_idx int, split string")
    return represent.as_features(df, "v").select("sample_id", "features"), df.select("sample_id", "label_idx", "split")


def loss(rows):
    return -np.mean([np.log(max(r.prob, 1e-12)) for r in rows if r.cls == r.y])


def test_boosted_trees_beat_the_forest(spark):
    features, samples = planted(spark)
    boosted = models.fit_predict(features, samples, boosts=25, rate=0.3).collect()
    forest = models.fit_predict(features, samples, trees=25).collect()
    total = {}
    for r in boosted:
        total[r.sample_id] = total.get(r.sample_id, 0) + r.prob
        assert 0 <= r.prob <= 1
    assert len(boosted) == 4 * 80 and all(abs(t - 1) < 1e-9 for t in total.values())
    assert loss(boosted) < 0.8 * loss(forest)
    best = {r.sample_id: r for r in sorted(boosted, key=lambda r: r.prob)}
    assert sum(r.cls == r.y for r in best.values()) > 68


def test_region_models_find_planted_regions(spark):
    """Regions that differ by class: selected, filled and fitted, they predict well; the other models do as well."""
    r = np.random.default_rng(7)
    rows = [(s, k, float(np.clip(0.5 + 0.3 * (k % 3 == s % 3) * (k < 6) + r.normal(0, 0.08), 0, 1)), 1) for s in range(90) for k in range(20) if (s + k) % 11]
    values = spark.createDataFrame(rows, "sample_id long, region_id long, region_beta double, n_loci long")
    samples = spark.createDataFrame([(s, "abc"[s % 3], s % 3, "test" if s % 5 == 0 else "train") for s in range(90)], "sample_id long, label string, label_idx int, split string")
    fit = samples.where("split = 'train'")
    chosen = beta.select_regions(beta.one_vs_rest(values.join(fit.select("sample_id"), "sample_id"), fit), 2, 0.1)
    assert {x.region_id for x in chosen.collect()} == set(range(6))
    features = models.assemble(beta.impute_medians(values, fit, samples, chosen), "sample_id", "region_id", "region_beta")
    for settings in ({}, {"trees": 30}, {"boosts": 15, "rate": 0.3}):
        rows = models.fit_predict(features, samples.select("sample_id", "label_idx", "split"), **settings).collect()
        best = {x.sample_id: x for x in sorted(rows, key=lambda x: x.prob)}
        assert len(best) == 18 and sum(x.cls == x.y for x in best.values()) >= 17, settings


def test_axes_have_fixed_signs(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(120, 5)) @ r.normal(size=(5, 5))
    store = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "locus_key long, vec array<double>")
    mean, axes, shares = represent.principal_axes(store, 3, 1000, 1)
    top = np.abs(axes).argmax(axis=0)
    assert (axes[top, range(3)] > 0).all() and np.allclose(mean, x.mean(axis=0)) and shares == sorted(shares, reverse=True)
    y = (x - mean) @ axes
    assert np.isclose((y**2).mean(), 1)  # the common scale
    found = {k: v for k, v in represent.project(store.repartition(4), 3, 1000, 1)[0].collect()}
    assert np.allclose([found[i] for i in range(120)], y, atol=1e-5)
    plan = represent.by_matrix(store, axes, mean)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 2000


def test_heads_are_pooled_apart(spark):
    r = np.random.default_rng(2)
    x, w = r.normal(size=(40, 4)), r.normal(size=(3, 4))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(99, 1, None)], "id long, grp long, vec array<double>")
    scored = pooling.head_scores(rows, lambda b: b @ w.T * 200)
    found = {(p.grp, p.head, p.dim): p.pooled for p in pooling.pool_heads(scored, 3).collect()}
    for g in range(3):
        own = x[np.arange(40) % 3 == g]
        s = own @ w.T * 200
        e = np.exp(s - s.max(axis=0))
        want = (e.T @ own) / e.sum(axis=0)[:, None]
        assert np.allclose([[found[g, h, d] for d in range(4)] for h in range(3)], want)


def test_streams_go_on_from_their_checkpoint(spark):
    """A sum over two parts: the second start must know the first one's state."""
    part = lambda a, b: spark.range(a, b).select((F.col("id") % 3).alias("k"), "id")
    updates = streams.taken_up_again([part(0, 30), part(30, 90)], lambda s: s.groupBy("k").agg(F.sum("id").alias("total"), F.count("*").alias("n")), "update", files=2, at_once=1)
    assert updates.select("batch").distinct().count() >= 4
    assert {r.k: (r.total, r.n) for r in streams.newest(updates, ["k"]).collect()} == {k: (sum(range(k, 90, 3)), 30) for k in range(3)}


@pytest.mark.parametrize("motif", ["CG", "CGC", "A"])
@pytest.mark.parametrize("chunk", [7, 300, 1 << 20])
def test_motifs_over_the_ends_of_runs(spark, motif, chunk):
    r = random.Random(11)
    sequences = {c: "".join(r.choices("CGcgA", k=400)) for c in ("x", "y")}
    rows = []
    for c, whole in sequences.items():
        at = 0
        while at < len(whole):
            n = r.choice((1, 1, 2, 9))
            rows.append((c, at, whole[at : at + n], len(rows)))
            at += n
    lines = spark.createDataFrame(rows, "contig string, offset long, line string, line_no long").repartition(4)
    wanted = {(c, i + 1) for c, w in sequences.items() for i in range(len(w)) if w[i : i + len(motif)].upper() == motif}
    for columns in (["contig", "offset", "line"], ["contig", "line_no", "line"]):
        found = [tuple(x) for x in text.motif_positions(lines.select(*columns), "contig", motif, chunk).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_tests_without_spread_are_null_not_errors(spark):
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    assert metrics.rank_tests(same, "g", "v").first().h is None and metrics.mann_whitney(same, "g", "v", "a").first().z is None
    one = spark.createDataFrame([("x", "p", 1), ("y", "p", 2)], "c string, n string, e int")
    r = audit.chi_square(one, "c", "n").first()
    assert (r.n, r.dof, r.cramers_v) == (2, 0, None) and audit.chi_square(one, "n", "c").first().chi2 == 0
    names = spark.createDataFrame([(i % 2, i % 3) for i in range(60)], "r int, o int")
    assert audit.chi_square(names, "r", "o").first().chi2 == pytest.approx(0)


def test_registered_streams_and_boosting():
    assert {"S1_running_regions", "S1_running_summary", "S2_running_pool", "S3_closed_sessions", "K4_region_boosting", "K6_region_folds"} <= set(QUERIES)


@pytest.mark.parametrize("settings", [{}, {"trees": 5}, {"boosts": 2}])
def test_models_without_features_take_classes_as_equally_likely(spark, settings):
    samples = spark.createDataFrame([(s, (0, 2, 2, 1)[s % 4], "test" if s % 4 == 3 else "train") for s in range(12)], "sample_id long, label_idx int, split string")
    none = models.assemble(spark.createDataFrame([], "sample_id long, region_id long, region_beta double"), "sample_id", "region_id", "region_beta")
    found = models.fit_predict(none, samples, **settings).collect()
    assert sorted(tuple(r) for r in found) == [(s, 1, c, (0.5, 0.0, 0.5)[c]) for s in (3, 7, 11) for c in range(3)]
    assert models.fit_predict(none, samples.where("split = 'test'"), **settings).count() == 0


def test_bags_are_cut_to_their_first_rows_before_the_shuffle(spark):
    rows = [("hot", i) for i in range(3000)] + [("even", i) for i in range(4)] + [("few", i) for i in range(2)] + [(None, 7)]
    items = spark.createDataFrame(rows, "grp string, item long").repartition(6)
    bag = qc.random_bag(items, "grp", "item", 4, 3)
    found = bag.collect()
    assert Counter(r.grp for r in found) == {"hot": 4, "even": 4, "few": 4} and all({r.slot for r in found if r.grp == g} == set(range(4)) for g in ("hot", "even", "few"))
    assert {r.item for r in found if r.grp == "even"} == set(range(4)) and len({r.item for r in found if r.grp == "hot"}) == 4 and {r.item for r in found if r.grp == "few"} <= {0, 1}
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
