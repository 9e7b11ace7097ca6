"""What keeps a task's share bounded as the tables grow."""

from pyspark.sql import functions as F

from locusframe.functions.loci import draw
from locusframe.operators import calls, resampling
from locusframe.plans import benchviews
from locusframe.sources import text

HERE = "/root/testdata/sf0.001"


def test_views_of_fragments_take_more_tasks_for_more_rows(spark, monkeypatch):
    before = benchviews.view(spark, HERE, "v_calls").exceptAll(benchviews.view(spark, HERE, "v_calls"))
    assert before.count() == 0
    whole = sorted(map(tuple, calls.merge_mates(benchviews.view(spark, HERE, "v_calls")).collect()))
    monkeypatch.setattr(benchviews, "GROUPED", 100)
    rows = spark.read.parquet(f"{HERE}/lineitem.parquet").count()
    merged = calls.merge_mates(benchviews.view(spark, HERE, "v_calls"))
    sizes = merged.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > rows // 100 * 0.8 and max(r[1] for r in sizes) < 400
    assert sorted(map(tuple, merged.collect())) == whole


def test_mate_stats_counts_fragments_with_both_keys_and_nothing_in_an_empty_table(spark):
    schema = "sample_id long, fragment_id long, mate int, locus_key long, state int"
    rows = [(1, 1, 1, 5, 0), (1, 1, 2, 5, 1), (1, 1, 2, 6, 1), (1, 2, 1, 5, 1), (1, 2, 1, 5, 1), (None, 3, 1, 7, 0), (2, None, None, 7, 0)]
    assert tuple(calls.mate_stats(spark.createDataFrame(rows, schema)).first()) == (2, 5, 1, 1)
    assert tuple(calls.mate_stats(spark.createDataFrame([], schema)).first()) == (0, 0, 0, 0)


def test_lines_of_one_file_are_put_in_order_in_chunks(spark, tmp_path, monkeypatch):
    """Splits of 64 bytes, chunks of three lines: samples and chains go on over both."""
    monkeypatch.setattr(text, "CHUNK", 3)
    monkeypatch.setattr(text, "GROUPED", 8)
    soft, chain, want_soft, want_chain = [], ["7", "junk"], set(), set()
    for i in range(30):
        soft += [f"^SAMPLE = GSM{i}", f"!Sample_title = a{i}", *["!other"] * (i % 8), f"!Sample_title = b{i}", f"!Sample_x = y{i}\r", "^PLATFORM = p", "!Sample_title = no"]
        want_soft |= {(f"GSM{i}", "title", f"a{i}"), (f"GSM{i}", "x", f"y{i}")}
        chain += [f"chain 9 chr1 99999 + {i} 9 chr2 99999 {'-' if i % 2 else '+'} {2 * i} 9 {i}"]
        t, q = i, 2 * i
        for j in range(i % 9):
            chain.append(f"{j + 1}\t{j}\t{2 * j}")
            want_chain.add((str(i), 1, t, j + 1, 2, 99999 - q - j - 1 if i % 2 else q, -1 if i % 2 else 1))
            t, q = t + 2 * j + 1, q + 3 * j + 1
        chain += ["5", ""]
        want_chain.add((str(i), 1, t, 5, 2, 99999 - q - 5 if i % 2 else q, -1 if i % 2 else 1))
    (tmp_path / "s.soft").write_text("\n".join(soft) + "\n")
    (tmp_path / "c.chain").write_text("\n".join(chain) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = text.numbered_lines(spark, str(tmp_path / "c.chain"))
        assert lines.rdd.getNumPartitions() > 10
        assert [r.line for r in lines.orderBy("line_no").collect()] == chain
        assert sorted(r.line_no for r in lines.collect()) == list(range(len(chain)))
        got = text.chain_blocks(lines).collect()
        assert len(got) == len(want_chain) and {tuple(r) for r in got} == want_chain
        got = text.soft_samples(text.numbered_lines(spark, str(tmp_path / "s.soft"))).drop("file").collect()
        assert len(got) == len(want_soft) and {tuple(r) for r in got} == want_soft
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_imputed_regions_are_those_of_a_tenth_of_the_fit_samples(spark):
    """K2 fills every sample in all regions that D4's rule finds among the fit samples, not only in those as wide as a contig."""
    from locusframe.operators import beta
    from locusframe.plans import catalog, registry

    here = HERE.replace("0.001", "0.01")
    fit = benchviews.view(spark, here, "v_samples").where("official_split = 'train'")
    seen = beta.observed_regions(registry.values(spark, here).join(fit.select("sample_id"), "sample_id"), fit.count(), 0.1).count()
    assert seen > 22
    assert catalog.QUERIES["K2_imputed_regions"](spark, here).count() == seen * 1500


def test_weights_come_to_the_driver_packed(spark):
    """Two bits or so for a drawn weight and one for a swap, beside the samples' ids; they were sixteen."""
    people = spark.createDataFrame([(i % 3, i) for i in range(3000)], "y int, sample_id long")
    size = lambda table: sum(table.column(c).nbytes for c in table.column_names)
    assert size(resampling.bootstrap_weights(people, 0, 128, 9).toArrow()) < 3000 * 128 * 0.3 + 3000 * 2 * 10
    assert size(resampling.swap_weights(people, 0, 128, 9).toArrow()) < 3000 * 128 * 0.14 + 3000 * 10
    ids, w = resampling._matrix(resampling.swap_weights(people, 5, 9, 9))
    want = people.select("sample_id", *((draw(9, F.lit(r), F.col("sample_id")) % 2).alias(f"r{r}") for r in range(5, 9))).orderBy("sample_id").collect()
    assert ids.tolist() == [r[0] for r in want] and w.tolist() == [list(r[1:]) for r in want]


def test_pairs_of_arms_on_the_same_samples_share_their_weights(spark, monkeypatch):
    """The replicates of all pairs are drawn once, and a pair has the values that it has alone."""
    rows = [(a, s, s % 3, c, draw_ / 97 + (c == s % 3) * 0.2) for a in "abc" for s in range(40) for c in range(3) for draw_ in [(ord(a) * 31 + s * 17 + c * 7) % 97]]
    pred = spark.createDataFrame(rows, "arm string, sample_id long, y int, cls int, prob double")
    alone = {(b, r.metric): (r.delta, r.low, r.high, r.share_le_0) for b in "bc" for r in resampling.paired_bootstrap(pred, "a", b, 3, 12, 2).collect()}
    calls_, weigh = [], resampling.bootstrap_weights
    monkeypatch.setattr(resampling, "bootstrap_weights", lambda *rest: calls_.append(rest) or weigh(*rest))
    found = resampling.compare_arms(pred, [("a", "b"), ("a", "c")], 3, 12, 2).collect()
    assert len(calls_) == 1 and len(found) == 8
    assert {(r.arm_b, r.metric): (r.delta, r.low, r.high, r.share_le_0) for r in found} == alone


def test_streams_keep_their_sums_in_as_many_tasks_as_the_rows_need(spark, monkeypatch):
    """Each batch of S1 writes a file for each task that holds sums; there were as many as shuffle partitions."""
    from locusframe.operators import beta
    from locusframe.plans import streams
    from locusframe.sources import shared
    from locusframe.streaming import incremental

    monkeypatch.setattr(streams, "HELD", 500)
    counts = shared.kept(benchviews.view(spark, HERE, "v_obs"))
    regions = shared.kept(beta.candidate_regions(counts, 150))
    halves = [counts.where("locus_key % 3 = 0"), counts.where("locus_key % 3 <> 0")]
    found = streams.taken_up_again(halves, lambda s: incremental.running_regions(s, regions), "update")
    files = found.select("batch", F.input_file_name().alias("f")).distinct().groupBy("batch").count().collect()
    assert len(files) == 4 and all(r[1] > counts.count() // 500 * 0.8 for r in files)
    got = streams.newest(found, ["sample_id", "region_id"]).select("sample_id", "region_id", "weighted", "coverage")
    want = counts.where("ct_count > 0").join(regions, "locus_key").groupBy("sample_id", "region_id").agg(F.sum("c_count"), F.sum("ct_count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_folds_choose_and_fill_regions_without_joins_or_groups_of_all_values(spark):
    """K3, K4 and K6: what a fold selects and fills equals the joins on (sample, region) with whole medians that it took before."""
    from locusframe.operators import beta, models
    from locusframe.plans import registry
    from locusframe.sources import shared

    rows = [(s, r, ((s * 7919 + r * 31) % 997) / 997 if r < 4 else float(s % 2), 1) for s in range(2001) for r in range(6) if (s + r) % 5 or r == 2]
    values = spark.createDataFrame(rows, "sample_id long, region_id long, region_beta double, n_loci int").repartition(7)
    whole = dict(values.groupBy("region_id").agg(F.median("region_beta")).collect())
    assert beta.medians(values, list(range(6))) == whole
    samples = spark.createDataFrame([(s, "ab"[s % 2], s % 2) for s in range(2003)], "sample_id long, label string, label_idx int")
    held = shared.kept(samples.join(beta.by_sample(values), "sample_id", "left"))
    fit = held.where("sample_id % 3 <> 0")
    found = registry.selected_features(fit, held)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    seen = beta.observed_regions(values.join(fit.select("sample_id"), "sample_id"), fit.count(), registry.SEEN)
    chosen = beta.select_regions(beta.one_vs_rest(values.join(seen.select("region_id"), "region_id"), fit), 4, 0.0)
    want = models.assemble(beta.impute_medians(values, fit, samples, chosen), "sample_id", "region_id", "region_beta")
    assert dict(found.collect()) == dict(want.collect()) and found.count() == 2003


def test_medians_outside_their_bounds_are_taken_whole(spark, monkeypatch):
    from locusframe.operators import beta

    values = spark.createDataFrame([(r, float(i)) for r in range(2) for i in range(100 + r)], "region_id long, region_beta double")
    monkeypatch.setattr(F, "percentile_approx", lambda c, *rest: F.array(F.max(c), F.max(c)))
    assert beta.medians(values, [0, 1]) == {0: 49.5, 1: 50.0}


def test_samples_meet_their_folds_once(spark):
    from locusframe.operators import models

    samples = spark.createDataFrame([(s, s, s % 2) for s in range(30)], "sample_id long, patient_id long, label_idx int")
    places = spark.createDataFrame([(f, p, "test" if p % 3 == f else "train") for f in range(3) for p in range(30)], "fold int, patient_id long, split string")
    plans = []

    def features(fit, placed):
        plans.append(placed._jdf.queryExecution().executedPlan().toString())
        return placed.select("sample_id", F.col("sample_id").cast("double").alias("x")).where("false").select("sample_id", F.expr("array(x)").alias("features"))

    found = models.fold_loop(features, samples, places)
    assert found.select("fold", "sample_id").distinct().count() == 30 and len(plans) == 3 and not any("Join" in p for p in plans)


def test_models_are_fitted_in_as_many_tasks_as_the_samples_need(spark, monkeypatch):
    """All features lay in one file, so each step of a fit was one task, whatever the cores."""
    from locusframe.operators import models

    assert [models.tasks_for(n, 12) for n in (0, 1500, 100_000, 3_800_000, 38_000_000)] == [1, 1, 4, 12, 73]
    rows = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label_idx"), F.when(F.col("id") % 4 == 3, "test").otherwise("train").alias("split"))
    features = models.vectors(rows.select("sample_id", F.array((F.col("label_idx") + F.rand(3)).cast("double")).alias("v")), "sample_id", "v")
    monkeypatch.setattr(models, "FITTED", 100)
    monkeypatch.setattr(models, "new_path", lambda _: paths[0])
    import tempfile

    paths = [tempfile.mkdtemp() + "/table"]
    assert models.fit_predict(features, rows).count() == 200
    files = spark.read.parquet(paths[0]).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 4
