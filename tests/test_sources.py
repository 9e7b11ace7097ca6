"""Text sources and streaming on small files."""

import gzip

import pytest

from locusframe.functions.loci import make_key
from locusframe.operators import beta, pooling
from locusframe.sources import text
from locusframe.streaming import incremental


def k(code, pos):
    return code << 32 | pos


def test_methratio_files(spark, tmp_path):
    head = "\t".join(["chr", "pos", "strand", "context", "ratio", "eff_CT_count", "C_count", "CT_count", "rev_G_count", "rev_GA_count", "CI_lower", "CI_upper"])
    with gzip.open(tmp_path / "GSM1_KRp2-7_bsmap_meth.txt.gz", "wt") as f:
        f.write(f"{head}\nchr1\t100\t+\tCG\t0.5\t4.0\t2\t4\tNA\tNA\t0.1\t0.9\nchrM\t5\t+\tCG\t0.5\t4.0\t2\t4\tNA\tNA\t0.1\t0.9\n")
    rows = text.read_methratio(spark, str(tmp_path))
    assert {(r.sample_id, r.batch, r.code, r.pos, r.c_count, r.ct_count) for r in rows.collect()} == {("GSM1", "KRp2", 1, 100, 2, 4), ("GSM1", "KRp2", None, 5, 2, 4)}
    assert {r.reason: r.n for r in beta.scan_stats(rows).collect()} == {"kept": 1, "other_contig": 1}


def test_soft_metadata(spark, tmp_path):
    (tmp_path / "s.soft").write_text("^DATABASE = x\n!Sample_title = no\n^SAMPLE = GSM1\n!Sample_title = KRp1-3\n!Sample_characteristics_ch1 = age: 61\n!Sample_characteristics_ch1 = Tissue Type: plasma\n^SAMPLE = GSM2\n!Sample_title = KRp2-1\n")
    got = {(r.sample, r.key): r.value for r in text.soft_samples(text.numbered_lines(spark, str(tmp_path))).collect()}
    assert got == {("GSM1", "title"): "KRp1-3", ("GSM1", "char_age"): "61", ("GSM1", "char_tissue_type"): "plasma", ("GSM2", "title"): "KRp2-1"}


def test_sample_table(spark):
    runs = spark.createDataFrame([("r2", "GSM1", "u2", "m2", 5, "10;20"), ("r1", "GSM1", "u1", "m1", 7, "3")], "run_accession string, sample_alias string, fastq_ftp string, fastq_md5 string, read_count long, fastq_bytes string")
    samples = spark.createDataFrame([("GSM1", "KRp1-3", "n/a")], "sample_id string, title string, age string")
    r = text.sample_table(samples, runs).first()
    assert (r.runs, r.reads, r.bytes, r.batch, r.age) == ("r1;r2", 12, 33, "KRp1", None)
    with pytest.raises(Exception, match="no runs"):
        text.sample_table(samples.union(spark.createDataFrame([("GSM9", "x", "1")], samples.schema)), runs).collect()
    a = spark.createDataFrame([("s1", "b"), ("s2", "b"), ("s3", "b")], "sample_id string, batch string")
    b = spark.createDataFrame([("s1", "b"), ("s3", "c"), ("s4", "b")], "sample_id string, batch string")
    assert {tuple(r) for r in text.reconcile(a, b).collect()} == {("no_file", "s2"), ("batch", "s3"), ("no_sample", "s4")}


def test_chain_blocks(spark, tmp_path):
    (tmp_path / "x.chain").write_text("chain 1 chr1 1000 + 100 300 chr1 5000 + 1000 1210 1\n50 20 30\n130\n\nchain 1 chr2 200 + 0 100 chr3 4900 - 100 200 2\n100\n\nchain 1 chrUn 9 + 0 9 chr1 9 + 0 9 3\n9\n")
    got = sorted(tuple(r) for r in text.chain_blocks(text.numbered_lines(spark, str(tmp_path))).collect())
    assert got == [("1", 1, 100, 50, 1, 1000, 1), ("1", 1, 170, 130, 1, 1080, 1), ("2", 2, 0, 100, 3, 4700, -1)]


def test_fasta_motifs_cross_lines(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 x\nACGc\nGTTC\ng\n>chr2\nC\nG\n>chrUn\nCG\n")
    lines = text.fasta_lines(text.placed_lines(spark, str(tmp_path)))
    assert {r.contig: r.sequence for r in text.fasta_sequences(lines).collect()} == {"chr1": "ACGcGTTCg", "chr2": "CG", "chrUn": "CG"}
    got = sorted(tuple(r) for r in text.motif_positions(lines, "contig", "CG").collect())
    assert got == [("chr1", 2), ("chr1", 4), ("chr1", 8), ("chr2", 1), ("chrUn", 1)]
    assert sorted(r[0] for r in text.reference_keys(lines, ["chr1", "chr2"]).collect()) == [k(1, 2), k(1, 4), k(1, 8), k(2, 1)]
    with pytest.raises(ValueError, match="chr3"):
        text.reference_keys(lines, ["chr1", "chr3"])


def test_fasta_in_many_splits(spark, tmp_path):
    seq = {f"chr{c}": "".join("ACGT"[(i * i * c + i // 7) % 4] for i in range(3000 * c)) for c in (1, 2, 3)}
    record = lambda c: f">{c}\r\n" + "".join(seq[c][i : i + 50] + "\r\n" for i in range(0, len(seq[c]), 50))
    (tmp_path / "r.fa").write_bytes("".join(map(record, seq)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = text.placed_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 10
        assert {r.contig: r.sequence for r in text.fasta_sequences(text.fasta_lines(lines, ["chr1", "chr3"])).collect()} == {c: seq[c] for c in ("chr1", "chr3")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reports_and_sam(spark, tmp_path):
    (tmp_path / "m.txt").write_text("CpG context (R1)\n===\nposition\tcount\n1\t3\t1\t75.0\t4\n2\t0\t0\t\t0\n\nCHG context (R2)\n1\t1\t1\t50.0\t2\n")
    got = sorted(tuple(r)[1:] for r in text.mbias_report(text.numbered_lines(spark, str(tmp_path / "m.txt"))).collect())
    assert got[0] == ("CHG", 2, 1, 1, 1, 50.0, 2) and got[1] == ("CpG", 1, 1, 3, 1, 75.0, 4) and got[2][5] is None
    (tmp_path / "d.txt").write_text("Total number of alignments analysed in x.bam:\t200\nTotal number duplicated alignments removed:\t50 (25%)\n")
    assert text.dedup_report(spark, str(tmp_path / "d.txt")).first().rate == 0.25
    (tmp_path / "S1.sam").write_text("@HD\nq1\t0\tchr2\t101\t60\t4M\t*\t0\t0\tACGT\t*\tXM:Z:.Z..\tXG:Z:CT\n")
    r = text.sam_records(spark, str(tmp_path / "S1.sam")).first()
    assert (r.sample_id, r.qname, r.code, r.pos, r.cigar, r.xm, r.xg) == ("S1", "q1", 2, 100, "4M", ".Z..", "CT")


def test_cohort_and_aliases(spark):
    people = spark.createDataFrame([("p1", "Training", "A", "II")], ["sample_id", "Set", "Source", "Cancer\nstage"])
    files = spark.createDataFrame([("p1", "x.bam 1000 bytes"), ("p1", "x.bam.md5 3 bytes")], "sample_id string, Files string")
    r = text.cohort_table(people, files).first()
    assert (r.official_split, r.batch, r.bytes, r.Cancer_stage) == ("train", "hospital_A", 1000, "II")
    with pytest.raises(Exception, match="in one table only"):
        text.cohort_table(people, files.withColumn("sample_id", make_key(files.sample_id.cast("string").isNull().cast("long") + 1, files.sample_id.isNull().cast("long") + 1).cast("string"))).collect()
    assert text.resolve_columns(people, {"id": ["key", "sample_id"]}).columns == ["id"]
    with pytest.raises(ValueError, match="0 of the columns"):
        text.resolve_columns(people, {"id": ["key"]})


def test_streams(spark, tmp_path):
    spark.createDataFrame([("s", 1, 2, 4), ("s", 2, 1, 4), ("t", 1, 0, 0)], "sample_id string, locus_key long, c_count long, ct_count long").repartition(2).write.parquet(str(tmp_path / "in"))
    regions = spark.createDataFrame([(1, 0), (2, 0)], "locus_key long, region_id long")
    stream = spark.readStream.schema("sample_id string, locus_key long, c_count long, ct_count long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = incremental.running_regions(stream, regions).writeStream.format("memory").queryName("regions").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert [tuple(r) for r in spark.table("regions").collect()] == [("s", 0, 3, 8)]


def test_stores_under_other_names(spark):
    aliases = {"locus_key": ["locus_key", "cpg_idx"], "vec": ["vec", "embedding"]}
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "cpg_idx long, embedding array<double>")
    assert {r.locus_key: r.vec for r in text.open_store(good, aliases).collect()} == {1: [1.0, 2.0], 2: [3.0, 4.0]}
    assert text.open_store(good.limit(0), aliases).count() == 0
    for row, said in (((2, [1.0, 1.0]), "repeated key"), ((None, [1.0, 1.0]), "null key"), ((3, None), "null vector"), ((3, [1.0]), "length of vector")):
        with pytest.raises(Exception, match=said):
            text.open_store(good.union(spark.createDataFrame([row], good.schema)), aliases).collect()


def test_running_summary_and_softmax(spark, tmp_path):
    counts = spark.createDataFrame([("s", i, i % 5, 4 + i) for i in range(20)], "sample_id string, locus_key long, c_count long, ct_count long")
    rows = spark.createDataFrame([(i % 2, float((i * 37) % 11 - 400 * (i % 3)), [float(i), float(-i)]) for i in range(30)], "g long, score double, vec array<double>")
    counts.repartition(3).write.parquet(str(tmp_path / "c"))
    rows.repartition(5).write.parquet(str(tmp_path / "r"))

    def run(make, source, name, mode):
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / ("c" if source is counts else "r")))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    got = run(incremental.running_summary, counts, "summaries", "complete").first()
    want = beta.sample_summary(beta.observe(counts), 20).first()
    assert (got.n_observed, got.mean_beta, got.var_beta, got.mean_coverage) == pytest.approx((want.n_observed, want.mean_beta, want.var_beta, want.mean_coverage))
    last = {}
    for r in run(lambda s: incremental.running_softmax(s, "g"), rows, "pools", "update").collect():
        last[r.g] = [v / r.s for v in r.v]  # rows come batch by batch
    pooled = {(r.g, r.dim): r.pooled for r in pooling.softmax_pool(rows, "g").collect()}
    assert {(g, i): x for g, v in last.items() for i, x in enumerate(v)} == pytest.approx(pooled)
