"""Hand-computed cases of single operators."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import stats
from locusframe.functions.loci import contig_code, key_code, key_position, make_key, strict_key
from locusframe.operators import beta, calls, intervals, metrics, pooling, represent, resampling, splits
from locusframe.plans import registry


def k(code, pos):
    return code << 32 | pos


def test_keys(spark):
    rows = spark.createDataFrame([("chr2", 5), ("22", 7), ("chrX", 1), ("Y", 2), ("chrM", 3), ("1", 0), ("1", -5), ("1", 1 << 32), (None, 1)], "c string, p long")
    got = [r[0] for r in rows.select(make_key(contig_code(F.col("c")), F.col("p"))).collect()]
    assert got == [k(2, 5), k(22, 7), k(23, 1), k(24, 2), None, None, None, None, None]
    back = rows.limit(2).select(key_code(F.lit(k(7, 9))), key_position(F.lit(k(7, 9)))).first()
    assert tuple(back) == (7, 9)
    with pytest.raises(Exception, match="no locus key"):
        rows.select(strict_key(contig_code(F.col("c")), F.col("p"))).collect()


def test_methratio_scan(spark):
    data = [("chr2", 500, "+", "CG", 3, 4), ("chr1", 200, "+", "CG", 5, 10), ("chr1", 100, "+", "CG", 0, 4), ("chr1", 150, "+", "CHG", 2, 9), ("chrX", 100, "+", "CG", 2, 9), ("chrM", 10, "+", "CG", 2, 9), ("chr3", 300, "+", "CG", 1, 3)]
    rows = spark.createDataFrame([("s", *r) for r in data], "sample_id string, chr string, pos long, strand string, context string, c_count long, ct_count long").withColumn("code", contig_code(F.col("chr")))
    assert {r.reason: r.n for r in beta.scan_stats(rows).collect()} == {"non_cg": 1, "other_contig": 2, "low_coverage": 1, "kept": 3}
    assert sorted(tuple(r)[1:] for r in beta.scan_kept(rows).collect()) == [(k(1, 100), 0, 4), (k(1, 200), 5, 10), (k(2, 500), 3, 4)]
    with pytest.raises(Exception, match="bad methratio row"):
        beta.scan_kept(rows.union(rows)).collect()


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_lift_does_not_depend_on_bins(spark, width):
    blocks = spark.createDataFrame([(1, 1, 100, 50, 1, 1000, 1), (2, 1, 170, 130, 1, 1080, 1), (3, 2, 0, 100, 3, 4700, -1), (4, 1, 400, 60, 5, 10, 1), (5, 1, 450, 150, 6, 10, 1)], "block_id int, src_code long, src_start long, size long, dst_code long, dst_start long, strand int")
    keys = [k(1, x) for x in (101, 150, 160, 171, 300, 50, 401, 455, 600, 601)] + [k(2, 11), k(2, 1)]
    got = {r.locus_key: (r.n_blocks, r.target) for r in intervals.lift(spark.createDataFrame([(x,) for x in keys], "locus_key long"), blocks, width).collect()}
    assert got[k(1, 101)] == (1, k(1, 1001)) and got[k(1, 150)] == (1, k(1, 1050)) and got[k(1, 160)] == (0, None) and got[k(1, 300)] == (1, k(1, 1210))
    assert got[k(2, 11)] == (1, k(3, 4789)) and got[k(2, 1)] == (1, k(3, 4799))
    assert got[k(1, 455)] == (2, None) and got[k(1, 600)][0] == 1 and got[k(1, 601)] == (0, None)


def test_lift_status_counts_every_drop(spark):
    lifted = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate([(1, 10), (1, 20), (1, 10), (1, 30), (0, None), (2, None), (1, 40), (1, 50)])], "locus_key long, n_blocks long, target long")
    ref = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "locus_key long")
    store = spark.createDataFrame([(20,), (30,)], "locus_key long")
    row = intervals.funnel(intervals.lift_status(lifted, ref, [store])).first()
    assert tuple(row) == (8, 6, 1, 1, 1, 2, 1, 2)


def test_summary_and_regions(spark):
    obs = spark.createDataFrame([("A", 10, 0.25, 4), ("A", 30, 1.0, 8), ("A", 40, 0.5, 6), ("B", 10, 0.0, 5), ("B", 20, 0.75, 9), ("B", 50, 1.0, 4)], "sample_id string, locus_key long, beta double, coverage int")
    got = {r.sample_id: r for r in beta.sample_summary(obs, 5).collect()}
    assert got["A"].n_observed == 3 and got["A"].missing_fraction == pytest.approx(0.4) and got["A"].mean_coverage == got["B"].mean_coverage == 6
    loci = spark.createDataFrame([(k(1, x),) for x in (100, 150, 250, 251, 600)] + [(k(2, x),) for x in (601, 650)], "locus_key long")
    ids = lambda gap: [r.region_id for r in beta.candidate_regions(loci, gap).orderBy("locus_key").collect()]
    assert ids(100) == [0, 0, 0, 0, 1, 2, 2] and ids(99) == [0, 0, 1, 1, 2, 3, 3]


def test_one_vs_rest_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((12, 3)) + (np.arange(12) >= 6)[:, None] * np.array([0.5, 0, 0])
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(3)], "sample_id long, region_id long, region_beta double")
    labels = spark.createDataFrame([(i, "ab"[i >= 6]) for i in range(12)], "sample_id long, label string")
    for r in beta.one_vs_rest(values, labels).collect():
        a, b = x[:6, r.region_id], x[6:, r.region_id]
        a, b = (a, b) if r.label == "a" else (b, a)
        va, vb = a.var(ddof=1) / 6, b.var(ddof=1) / 6
        assert r.delta == pytest.approx(a.mean() - b.mean()) and r.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
        assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 5 + vb**2 / 5))
    assert beta.select_regions(beta.one_vs_rest(values, labels), 1).select("region_id").distinct().first()[0] == 0


def test_tails():
    assert stats.t_two_sided([2.0], [10])[0] == pytest.approx(0.0733880348)
    assert stats.chi2_sf([3.841458821, 74.3], [1, 5]) == pytest.approx([0.05, 1.3022e-14], rel=1e-4)
    assert stats.norm_two_sided([1.959964])[0] == pytest.approx(0.05, rel=1e-5)
    assert stats.fisher_2x2([3], [1], [1], [3])[0] == pytest.approx(0.4857142857)


def test_alignments(spark):
    rows = [("a", 1, 100, "10M", "...z......", "CT"), ("b", 1, 300, "3M2I10M", "..Z.z.Z........", "GA"), ("c", 1, 50, "2S4M", "ZZ..Z.", "CT"), ("d", 1, 50, "2M3D2M", "...Z", "CT")]
    reads = spark.createDataFrame(rows, "fragment_id string, code long, pos long, cigar string, xm string, xg string")
    got = sorted((r.fragment_id, r.locus_key - k(1, 0), r.state) for r in calls.decode_calls(reads).collect())
    assert got == [("a", 104, 0), ("b", 302, 1), ("b", 304, 1), ("c", 53, 1), ("d", 57, 1)]
    flags = spark.createDataFrame([(0x400, 60, 1), (0, 5, 1), (0, 60, None), (1, 60, 1), (3, 60, 1)], "flag int, mapq int, code long")
    assert [r[0] for r in flags.select(calls.alignment_reason(F.col("flag"), F.col("mapq"), F.col("code"), 10)).collect()] == ["bad_flag", "low_mapq", "other_contig", "improper_pair", "kept"]


def test_mates_and_geometry(spark):
    rows = [("s", 1, 1, 100, 1), ("s", 1, 2, 100, 1), ("s", 1, 2, 110, 0), ("s", 1, 1, 150, 1), ("s", 2, 1, 200, 1), ("s", 2, 2, 200, 0)]
    c = spark.createDataFrame(rows, "sample_id string, fragment_id long, mate int, locus_key long, state int")
    merged = calls.merge_mates(c)
    assert sorted((r.fragment_id, r.locus_key, r.state) for r in merged.collect()) == [(1, 100, 1), (1, 110, 0), (1, 150, 1)]
    assert tuple(calls.mate_stats(c).first()) == (2, 4, 2, 1)
    g = calls.geometry(merged).orderBy("locus_key").collect()
    assert [r.from_first for r in g] == pytest.approx([math.log1p(x) / 7 for x in (0, 10, 50)]) and [r.from_prev for r in g] == pytest.approx([math.log1p(x) / 7 for x in (0, 10, 40)])
    assert [r.rel_rank for r in g] == [0, 0.5, 1]


def test_splits(spark):
    rows = [(i, i, "ABC"[i % 3], f"b{i // 3 % 2}", "train" if i % 4 else "test") for i in range(60)]
    samples = spark.createDataFrame(rows, "sample_id long, patient_id long, label string, batch string, official_split string")
    people = splits.patients(samples, ["label", "batch"])
    table = splits.kfold_splits(people, 5, 20, 17)
    assert all(tuple(r)[1:] == (0, 0, 0) for r in splits.leakage(table).collect())
    test = [r.n for r in table.where("split = 'test'").groupBy("fold", "label").agg(F.count("*").alias("n")).collect()]
    assert set(test) == {4} and len(test) == 15
    assert {r.n for r in table.where("split = 'val'").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {10}
    again = splits.kfold_splits(people.repartition(7), 5, 20, 17)
    assert table.exceptAll(again).count() == 0
    hidden = splits.guarded(table, ["label"]).where("split = 'test' and label is not null")
    assert hidden.count() == 0
    with pytest.raises(ValueError, match="not declared"):
        splits.apply_labels(samples, {"x": "z"}, ["y"])


def test_metrics(spark):
    probs = [[0.7, 0.2, 0.1], [0.3, 0.6, 0.1], [0.2, 0.7, 0.1], [0.1, 0.8, 0.1], [0.5, 0.1, 0.4], [0.1, 0.2, 0.7]]
    pred = spark.createDataFrame([("a", i, i // 2, c, p) for i, row in enumerate(probs) for c, p in enumerate(row)], "arm string, sample_id int, y int, cls int, prob double")
    r = metrics.summary_metrics(pred, 3, ["arm"]).first()
    assert r.macro_f1 == pytest.approx((0.5 + 0.8 + 2 / 3) / 3) and r.balanced_accuracy == pytest.approx(2 / 3) and r.accuracy == pytest.approx(4 / 6) and r.top2_accuracy == 1
    tied = spark.createDataFrame([("a", 0, 1, c, 0.5) for c in (1, 0)], "arm string, sample_id int, y int, cls int, prob double")
    assert metrics.predicted(tied, ["arm"]).first().label == 0
    assert metrics.auroc(tied, ["arm"]).where("auc is not null").count() == 0


def two_arms(spark, other):
    r = np.random.default_rng(4)
    rows = []
    for i in range(45):
        p = r.dirichlet([1, 1, 1])
        q = r.dirichlet([1, 1, 1]) if other else p
        rows += [(arm, i, i % 3, c, float(v[c])) for arm, v in (("a", p), ("b", q)) for c in range(3)]
    return spark.createDataFrame(rows, "arm string, sample_id long, y int, cls int, prob double")


def test_resampling_of_equal_arms(spark):
    pred = two_arms(spark, False)
    boot, perm = (f(pred, "a", "b", 3, 20, 1).collect() for f in (resampling.paired_bootstrap, resampling.paired_permutation))
    assert {r.metric for r in boot} == {"accuracy", "balanced_accuracy", "macro_f1", "macro_auroc"}
    assert all((r.delta, r.low, r.high, r.share_le_0) == (0, 0, 0, 1) for r in boot) and all((r.delta, r.p) == (0, 1) for r in perm)
    people = pred.where("arm = 'a' and cls = 0").select("sample_id", "y")
    drawn = resampling.stratified_resample(people, 20, 1).join(people, "sample_id").groupBy("rep", "y").count()
    assert {r["count"] for r in drawn.collect()} == {15}


def test_arm_comparison_against_plain_loops(spark):
    pred = two_arms(spark, True)
    rows = {(r.arm, r.sample_id, r.cls): r.prob for r in pred.collect()}
    prob = {arm: np.array([[rows[arm, i, c] for c in range(3)] for i in range(45)]) for arm in "ab"}
    y = np.arange(45) % 3

    def plain(y, p):
        label = p.argmax(axis=1)
        hit = [[((y == c) & (label == c)).sum(), (y == c).sum(), (label == c).sum()] for c in range(3)]
        wins = []
        for c in range(3):
            a, b = p[y == c, c][:, None], p[y != c, c][None, :]
            wins.append(((a > b) + 0.5 * (a == b)).mean())
        return {"accuracy": (label == y).mean(), "balanced_accuracy": np.mean([h / n for h, n, _ in hit if n]), "macro_f1": np.mean([2 * h / (n + m) if n + m else 0 for h, n, m in hit]), "macro_auroc": np.mean(wins)}

    drawn = {}
    for r in resampling.stratified_resample(pred.where("arm = 'a' and cls = 0").select("sample_id", "y"), 40, 3).collect():
        drawn.setdefault(r.rep, []).append(r.sample_id)
    each = [{arm: plain(y[i], prob[arm][i]) for arm in "ab"} for i in drawn.values()]
    seen = {arm: plain(y, prob[arm]) for arm in "ab"}
    found = resampling.compare_arms(pred, [("a", "b"), ("a", "zz")], 3, 40, 3).collect()
    assert len(found) == 4 and all((r.arm_a, r.arm_b, r.n) == ("a", "b", 45) for r in found)
    for r in found:
        delta = np.array([x["a"][r.metric] - x["b"][r.metric] for x in each])
        assert (r.a, r.b) == pytest.approx((seen["a"][r.metric], seen["b"][r.metric]))
        assert (r.low, r.high) == pytest.approx(tuple(np.percentile(delta, [2.5, 97.5]))) and r.share_le_0 == pytest.approx((np.round(delta, 12) <= 0).mean())
        assert 0 < r.p <= 1
    with pytest.raises(ValueError, match="not on the same samples"):
        resampling.compare_arms(pred.where("arm = 'a' or sample_id < 40"), [("a", "b")], 3, 5, 3)
    with pytest.raises(ValueError, match="no pair"):
        resampling.compare_arms(pred, [("x", "y")], 3, 5, 3)


def test_pooling_in_parts_equals_one_step(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i % 4, i % 3, float(rng.normal(0, 300)), rng.normal(size=3).tolist()) for i in range(60)], "g int, part int, score double, vec array<double>")
    one = {(r.g, r.dim): r.pooled for r in pooling.softmax_pool(rows, "g").collect()}
    for parts in (rows, rows.withColumn("part", F.lit(0)), rows.withColumn("part", F.col("score"))):
        assert {(r.g, r.dim): r.pooled for r in pooling.merge_parts(pooling.pool_parts(parts, "g", "part"), "g").collect()} == pytest.approx(one)


def test_representations(spark):
    loci = spark.createDataFrame([(k(1, x),) for x in range(1, 2001)], "locus_key long")
    a = represent.random_vectors(loci, 4, 17).toPandas().set_index("locus_key").vec
    b = represent.random_vectors(loci.orderBy(F.desc("locus_key")).limit(50), 4, 17).toPandas().set_index("locus_key").vec
    assert all(np.array_equal(a[x], b[x]) for x in b.index) and abs(np.stack(a).mean()) < 0.05 and abs(np.stack(a).std() - 1) < 0.05
    shuffled = represent.shuffled_control(loci, 5).toPandas()
    assert sorted(shuffled.source) == sorted(shuffled.locus_key) == [k(1, x) for x in range(1, 2001)] and (shuffled.source != shuffled.locus_key).mean() > 0.9
    store = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [3.0])], "locus_key long, vec array<float>")
    with pytest.raises(Exception, match="repeated key"):
        represent.gather(spark.createDataFrame([(1,)], "locus_key long"), store).collect()
    with pytest.raises(Exception, match="missing key"):
        represent.gather(spark.createDataFrame([(9,)], "locus_key long"), store).collect()


def test_region_trees_take_the_logistic_models_features(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    if not Path(d).is_dir():
        pytest.skip("needs the driver's tables")
    fitted = []
    monkeypatch.setattr(registry.models, "fit_predict", lambda features, samples, trees=0: fitted.append((features.first().features.size, trees)))
    registry.QUERIES["K3_region_logistic"](spark, d)
    registry.QUERIES["K4_region_trees"](spark, d)
    assert fitted[0][0] == fitted[1][0] > 4 and [t for _, t in fitted] == [0, 300]


def test_contradicting_inputs_fail(spark, tmp_path):
    people = spark.createDataFrame([(i, i // 2, "x" if i % 4 < 2 else "y", f"B{i // 2 % 2}", "train" if i < 30 else "test") for i in range(40)], "sample_id long, patient_id long, label string, batch string, official_split string")
    flipped = people.withColumn("label", F.when(F.col("sample_id") == 1, "y").otherwise(F.col("label")))
    with pytest.raises(Exception, match="different labels"):
        splits.patients(flipped, ["label"]).collect()
    with pytest.raises(Exception, match="fewer than 11 patients"):
        splits.fold_of(splits.patients(people, ["label"]), 11, 1).collect()
    with pytest.raises(ValueError, match="every class must be in every batch"):
        splits.cross_batch_splits(people, 20, 1)
    with pytest.raises(Exception, match="several batches"):
        splits.cross_batch_splits(people.withColumn("batch", F.concat(F.lit("B"), F.col("sample_id") % 2)), 20, 1).collect()
    with pytest.raises(Exception, match="train or test"):
        splits.official_splits(people.withColumn("official_split", F.lit("other")), 20, 1).collect()
    seeds = spark.createDataFrame([("a", 1, 0, 0, s, 0.5) for s in (1, 2)] + [("a", 2, 0, 0, 1, 0.5)], "arm string, sample_id int, y int, cls int, seed int, prob double")
    with pytest.raises(Exception, match="numbers of seeds"):
        metrics.seed_ensemble(seeds).collect()
    table, path = splits.kfold_splits(splits.patients(people, ["label"]), 5, 20, 17), str(tmp_path / "splits")
    assert splits.keep_splits(table, path).count() == splits.keep_splits(table, path).count() == 100
    with pytest.raises(ValueError, match="different assignment"):
        splits.keep_splits(splits.kfold_splits(splits.patients(people, ["label"]), 5, 20, 18), path)


def test_stores_refuse_what_does_not_fit(spark, tmp_path):
    store = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "locus_key long, vec array<float>")
    path = str(tmp_path / "own")
    info = represent.materialise(store, store.where("locus_key < 8"), path).first()
    assert (info.n_loci, info.dim, info.shuffle_seed) == (8, 2, None)
    assert {r.locus_key: r.vec for r in represent.load_materialised(store.where("locus_key < 8"), path).collect()} == {i: [float(i), 1.0] for i in range(8)}
    with pytest.raises(ValueError, match="another set of loci"):
        represent.load_materialised(store, path)
    with pytest.raises(ValueError, match="2 keys outside the store, first 10,11"):
        represent.materialise(store, spark.range(12).withColumnRenamed("id", "locus_key"), str(tmp_path / "other"))
    with pytest.raises(Exception, match="key in the shards twice"):
        intervals.merge_shards(store, store.limit(1)).collect()
    with pytest.raises(ValueError, match="10 loci, 11 expected"):
        intervals.index_map(store.select((F.col("locus_key") + k(1, 1)).alias("locus_key")), 11)


def test_welch_counts_tiny_spreads_as_none(spark):
    values = spark.createDataFrame([(i, 0, 0.1) for i in range(6)] + [(i, 1, float(i % 2)) for i in range(6)], "sample_id int, region_id int, region_beta double")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "sample_id int, label string")
    found = {(r.region_id, r.label): (r.delta, r.t, r.df) for r in beta.one_vs_rest(values, labels).collect()}
    assert all(found[0, c][1:] == (None, None) and found[0, c][0] == pytest.approx(0) for c in "ab") and found[1, "b"] == (1.0, None, None)


def test_fingerprints_see_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3), (2, 3), (2, 2)], "g int, x int")
    a, b = (tuple(r)[1:] for r in splits.fingerprint(rows, ["x"], ["g"]).orderBy("g").collect())
    assert a[0] == b[0] == 3 and a != b


def test_mate_stats_tell_samples_apart(spark):
    calls_ = spark.createDataFrame([("a", 1, 5, 1, 1), ("b", 1, 5, 1, 1)], "sample_id string, fragment_id long, locus_key long, mate int, state int")
    assert calls.mate_stats(calls_).first().fragments == 2
