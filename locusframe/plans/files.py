"""Queries of the sources: the driver's tables are written as the text that a source reads, read back, and compared with SQL on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, intervals, numbering
from ..sources import shared, text
from .benchviews import view
from .registry import query, rounded


def rows_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("value")


def say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Archives, metadata and run tables

NAMES = "nm AS (SELECT c_custkey, 'GSM' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE '_' END || 'KRp' || (c_nationkey % 10) || '-' || (c_custkey % 90) || '_bsmap_meth.txt' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.gz' END AS name FROM customer)"


def member_names(spark, d):
    c = rows_of(spark, d, "customer")
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    gap, end = F.when(k % 7 == 0, "-").otherwise("_"), F.when(k % 3 == 0, "").otherwise(".gz")
    return c.select("c_custkey", say("GSM", k, gap, "KRp", nation % 10, "-", k % 90, "_bsmap_meth.txt", end).alias("name"))


@query("A2_members", f"WITH {NAMES} SELECT name, CASE WHEN c_custkey % 7 <> 0 THEN 'GSM' || c_custkey END AS sample_id, CASE WHEN c_custkey % 7 <> 0 THEN regexp_extract(name, 'KRp[0-9]') END AS batch, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 90)::INTEGER END AS number FROM nm")
def a2(spark, d):
    return member_names(spark, d).select("name", *text.member(F.col("name")))


@query("A3_soft_metadata", "SELECT 'GSM' || c_custkey AS sample, unnest(['title', 'char_age', 'char_market_segment']) AS key, unnest(['KRp' || c_nationkey || '-' || c_custkey, c_custkey::VARCHAR, c_mktsegment]) AS value FROM customer")
def a3(spark, d):
    k = F.col("c_custkey")
    record = lines(
        say("^SAMPLE = GSM", k), say("!Sample_title = KRp", F.col("c_nationkey"), "-", k), say("!Sample_characteristics_ch1 = age: ", k),
        say("!Sample_characteristics_ch1 = Market Segment: ", F.col("c_mktsegment")), "!sample_table_begin", "^PLATFORM = x", "!Sample_title = not a sample's",
    )
    path = shared.write_text(rows_of(spark, d, "customer").select(record))
    return text.soft_samples(text.numbered_lines(spark, path)).drop("file")


RUNS = "ru AS (SELECT 'R' || l_orderkey || '.' || l_linenumber AS run, 'S' || o_custkey AS sample, 'u' || l_partkey AS url, 'm' || l_suppkey AS md5, l_quantity::BIGINT AS n, l_partkey AS b1, l_suppkey AS b2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey), rr AS (SELECT sample AS sample_alias, string_agg(run, ';' ORDER BY run) AS runs, string_agg(url, ';' ORDER BY url) AS urls, string_agg(md5, ';' ORDER BY md5) AS md5, sum(n)::BIGINT AS reads, sum(b1 + b2)::BIGINT AS bytes FROM ru GROUP BY 1)"


def run_table(spark, d):
    joined = rows_of(spark, d, "lineitem").join(rows_of(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        say("R", F.col("l_orderkey"), ".", F.col("l_linenumber")).alias("run_accession"), say("S", F.col("o_custkey")).alias("sample_alias"), say("u", F.col("l_partkey")).alias("fastq_ftp"),
        say("m", F.col("l_suppkey")).alias("fastq_md5"), F.col("l_quantity").cast("long").alias("read_count"), say(F.col("l_partkey"), ";", F.col("l_suppkey")).alias("fastq_bytes"),
    )


@query("A4_run_rollup", f"WITH {RUNS} SELECT * FROM rr")
def a4(spark, d):
    return text.run_rollup(run_table(spark, d))


@query("A5_sample_table", f"WITH {RUNS} SELECT 'S' || c_custkey AS sample_id, 'KRp' || c_nationkey AS batch, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal::DOUBLE END AS age, runs, reads, bytes FROM customer JOIN rr ON 'S' || c_custkey = sample_alias")
def a5(spark, d):
    runs = run_table(spark, d)
    age = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    samples = rows_of(spark, d, "customer").select(say("S", F.col("c_custkey")).alias("sample_id"), say("KRp", F.col("c_nationkey"), "-", F.col("c_custkey")).alias("title"), age.alias("age"))
    known = samples.join(runs.select(F.col("sample_alias").alias("sample_id")), "sample_id", "left_semi")
    return text.sample_table(known, runs).select("sample_id", "batch", "age", "runs", "reads", "bytes")


@query("A6_cohort_table", "SELECT c_custkey::VARCHAR AS sample_id, c_mktsegment AS \"Cancer_stage\", CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS official_split, 'hospital_' || (c_nationkey % 4) AS batch, (c_custkey * 1000)::BIGINT AS bytes FROM customer")
def a6(spark, d):
    c = rows_of(spark, d, "customer")
    k = F.col("c_custkey").cast("string").alias("sample_id")
    people = c.select(k, F.when(F.col("c_custkey") % 3 == 0, "Test").otherwise("Training").alias("Set"), (F.col("c_nationkey") % 4).alias("Source"), F.col("c_mktsegment").alias("Cancer\n stage"), F.lit(0.5).alias("MFR score"))
    bam, sums = c.select(k, say("x.bam (", F.col("c_custkey") * 1000, " bytes)").alias("Files")), c.select(k, F.lit("x.bam.md5 (3 bytes)").alias("Files"))
    return text.cohort_table(people, bam.union(sums), ("MFR",)).select("sample_id", "Cancer_stage", "official_split", "batch", "bytes")


@query("A7_reconcile", f"WITH {NAMES}, f AS (SELECT 'GSM' || c_custkey AS id, regexp_extract(name, 'KRp[0-9]') AS batch FROM nm WHERE c_custkey % 7 <> 0), s AS (SELECT 'GSM' || c_custkey AS id, 'KRp' || (c_nationkey % 9) AS batch FROM customer WHERE c_custkey % 5 <> 0), j AS (SELECT coalesce(f.id, s.id) AS sample_id, CASE WHEN f.id IS NULL THEN 'no_file' WHEN s.id IS NULL THEN 'no_sample' WHEN f.batch <> s.batch THEN 'batch' END AS problem FROM s FULL JOIN f ON s.id = f.id) SELECT problem, sample_id FROM j WHERE problem IS NOT NULL")
def a7(spark, d):
    files = member_names(spark, d).select(*text.member(F.col("name"))).where("sample_id is not null")
    samples = rows_of(spark, d, "customer").where("c_custkey % 5 <> 0").select(say("GSM", F.col("c_custkey")).alias("sample_id"), say("KRp", F.col("c_nationkey") % 9).alias("batch"))
    return text.reconcile(samples, files)


# Sequences

LETTER = "substr('ACGT', CAST((l_orderkey * 7 + l_linenumber * 3 + CAST(l_quantity AS BIGINT)) % 4 AS INTEGER) + 1, 1)"
BASES = f"ba AS (SELECT l_partkey % 22 + 1 AS code, string_agg({LETTER}, '' ORDER BY l_orderkey, l_linenumber, l_quantity) AS seq FROM lineitem GROUP BY 1)"
CPG = BASES + ", cg AS (SELECT code, pos FROM (SELECT code, seq, unnest(range(1, length(seq))) AS pos FROM ba) WHERE seq[pos:pos + 1] = 'CG')"


def fasta(spark, d):
    """Lines of FASTA files, one for each residue of l_partkey, 60 letters to a line, in lower case on every third contig."""
    rows = rows_of(spark, d, "lineitem").select((F.col("l_partkey") % 22 + 1).alias("code"), "l_orderkey", "l_linenumber", "l_quantity", F.expr(LETTER).alias("letter"))
    placed = numbering.numbered(rows, ["code"], ["l_orderkey", "l_linenumber", "l_quantity"], "at").withColumn("line", F.expr("(at - 1) div 60 + 1"))
    sequence = placed.groupBy("code", "line").agg(F.expr("listagg(letter, '') WITHIN GROUP (ORDER BY at)").alias("value"))
    cased = F.when(F.col("code") % 3 == 0, F.lower("value")).otherwise(F.col("value"))
    heads = rows.select("code").distinct().select("code", F.lit(0).cast("long").alias("line"), say(">chr", F.col("code"), " made up").alias("value"))
    records = heads.union(sequence.select("code", "line", cased)).repartition("code").sortWithinPartitions("code", "line")
    path = shared.new_path(spark)
    records.select("value", "code").write.partitionBy("code").text(path)
    return text.placed_lines(spark, path)


AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


@query("A8_fasta", f"WITH {BASES} SELECT 'chr' || code AS contig, length(seq)::BIGINT AS length, md5(CASE WHEN code % 3 = 0 THEN lower(seq) ELSE seq END) AS digest FROM ba WHERE code <> 5")
def a8(spark, d):
    whole = text.fasta_sequences(text.fasta_lines(fasta(spark, d), [c for c in AUTOSOMES if c != "chr5"]))
    return whole.select("contig", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


@query("A10_reference_keys", f"WITH {CPG} SELECT code * 4294967296 + pos AS locus_key FROM cg")
def a10(spark, d):
    return text.reference_keys(text.fasta_lines(fasta(spark, d)), AUTOSOMES)


@query("A11_index_map", f'WITH {CPG} SELECT row_number() OVER (ORDER BY code, pos) AS "index", code, pos FROM cg')
def a11(spark, d):
    return intervals.index_map(text.reference_keys(text.fasta_lines(fasta(spark, d)), AUTOSOMES))


@query("A12_chain_blocks", """WITH h AS (SELECT p_partkey, p_partkey % 25 AS c, (p_partkey * 7) % 22 + 1 AS dst_code, floor(p_partkey / 22)::BIGINT * 500 AS ts, 1000 + p_partkey AS qs, p_partkey % 5 = 0 AS back, 100 + p_size::BIGINT AS s1 FROM part WHERE p_partkey % 25 <> 0),
b AS (SELECT *, ts AS t, qs AS q, s1 AS size FROM h UNION ALL SELECT *, ts + s1 + 20, qs + s1 + 30, 50 FROM h)
SELECT p_partkey::VARCHAR AS chain_id, c AS src_code, t AS src_start, size, dst_code, CASE WHEN back THEN 10000000 - q - size ELSE q END AS dst_start, CASE WHEN back THEN -1 ELSE 1 END AS strand FROM b""")
def a12(spark, d):
    p = rows_of(spark, d, "part")
    k, s1 = F.col("p_partkey"), F.col("p_size") + 100
    code = k % 25
    name = F.when(code == 0, "Un").when(code == 23, "X").when(code == 24, "Y").otherwise(code.cast("string"))
    start, qstart = F.expr("p_partkey div 22 * 500"), k + 1000
    head = say("chain 9 chr", name, " 90000000 + ", start, " ", start + s1 + 70, " chr", k * 7 % 22 + 1, " 10000000 ", F.when(k % 5 == 0, "-").otherwise("+"), " ", qstart, " ", qstart + s1 + 80, " ", k)
    path = shared.write_text(p.select(lines(head, say(s1, "\t20\t30"), "50", "")))
    return text.chain_blocks(text.numbered_lines(spark, path))


# Reports


@query("A13_dedup_report", "SELECT c_nationkey::INTEGER AS nation, count(*) AS total, count(*) FILTER (c_custkey % 4 = 0) AS removed, round(count(*) FILTER (c_custkey % 4 = 0) / count(*), 6) AS rate FROM customer GROUP BY 1")
def a13(spark, d):
    each = rows_of(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 4 == 0).alias("r"))
    report = lines(say("Total number of alignments analysed in x.bam:\t", F.col("n")), say("Total number duplicated alignments removed:\t", F.col("r"), " (some)"))
    return rounded(text.dedup_report(spark, shared.write_text(each.select("nation", report), "nation")).select("nation", "total", "removed", "rate"))


@query("A14_mbias_report", "SELECT o_custkey % 9 AS sample, 'CpG' AS context, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS read, (l_orderkey % 40)::INTEGER AS pos, count(*) FILTER (l_returnflag = 'R') AS n_up, count(*) FILTER (l_returnflag <> 'R') AS n_down, CASE WHEN count(*) % 3 <> 0 THEN round(100 * count(*) FILTER (l_returnflag = 'R') / count(*), 2) END AS pct, count(*) AS coverage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def a14(spark, d):
    joined = rows_of(spark, d, "lineitem").join(rows_of(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    read = F.when(F.col("l_linestatus") == "F", 1).otherwise(2)
    each = joined.groupBy((F.col("o_custkey") % 9).alias("sample"), read.alias("read"), (F.col("l_orderkey") % 40).alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("up"))
    pct = F.when(F.col("n") % 3 == 0, "").otherwise(F.round(100 * F.col("up") / F.col("n"), 2).cast("string"))
    row = F.concat_ws("\t", "pos", "up", F.col("n") - F.col("up"), pct, "n")
    section = lines(say("CpG context (R", F.col("read"), ")"), "===========", "position\tcount methylated", F.array_join(F.array_sort(F.collect_list(row)), "\n"), "")
    path = shared.write_text(each.groupBy("sample", "read").agg(section), "sample")
    found = text.mbias_report(text.numbered_lines(spark, path))
    return found.withColumn("sample", F.regexp_extract("file", "sample=([0-9]+)", 1).cast("long")).drop("file")


# Alignments

XM = "translate(substr(md5('xm|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 12), '0123456789abcdef', 'zZzZhHxX........')"
READS = f"""rd AS (SELECT l_orderkey || '-' || l_linenumber AS qname, CASE l_linenumber % 5 WHEN 0 THEN 16 WHEN 1 THEN 4 WHEN 2 THEN 99 WHEN 3 THEN 65 ELSE 0 END AS flag, l_partkey % 25 AS c, l_orderkey % 100000 AS pos, l_quantity::INTEGER AS mapq, l_linenumber % 3 AS shape, {XM} AS xm, l_orderkey % 2 AS ct FROM lineitem),
rs AS (SELECT *, CASE WHEN flag = 4 THEN 'bad_flag' WHEN mapq < 10 THEN 'low_mapq' WHEN c = 0 OR c > 22 THEN 'other_contig' WHEN flag = 65 THEN 'improper_pair' ELSE 'kept' END AS reason FROM rd)"""
DECODED = READS + """, de AS (SELECT *, xm[i + 1] AS mark, CASE shape WHEN 0 THEN i WHEN 1 THEN CASE WHEN i < 4 THEN i WHEN i >= 6 THEN i - 2 END ELSE CASE WHEN i >= 8 THEN i - 1 WHEN i >= 3 THEN i - 3 END END AS off FROM (SELECT *, unnest(range(12)) AS i FROM rs WHERE reason = 'kept')),
ca AS (SELECT qname, c * 4294967296 + pos + off + CASE WHEN ct = 0 THEN 1 ELSE 0 END AS locus_key, CASE mark WHEN 'Z' THEN 1 ELSE 0 END AS state, i::INTEGER AS read_pos, CASE WHEN flag = 16 THEN 11 - i ELSE i END::INTEGER AS from_start FROM de WHERE mark IN ('z', 'Z') AND off IS NOT NULL AND pos + off + CASE WHEN ct = 0 THEN 1 ELSE 0 END > 0)"""


def alignments(spark, d):
    """Records read from SAM text made of lineitem: plain, gapped and clipped reads, some with bad flags, low quality or other contigs."""
    k, no = F.col("l_orderkey"), F.col("l_linenumber")
    flag = F.when(no % 5 == 0, 16).when(no % 5 == 1, 4).when(no % 5 == 2, 99).when(no % 5 == 3, 65).otherwise(0)
    cigar = F.when(no % 3 == 0, "12M").when(no % 3 == 1, "4M2I6M").otherwise("3S5M2D4M")
    xm = F.translate(F.substring(F.md5(F.concat_ws("|", F.lit("xm"), k, no, "l_partkey")), 1, 12), "0123456789abcdef", "zZzZhHxX........")
    rest = say("*\t0\t0\tACGT\t*\tXM:Z:", xm, "\tXG:Z:", F.when(k % 2 == 0, "CT").otherwise("GA"))
    record = F.concat_ws("\t", say(k, "-", no), flag, say("chr", F.col("l_partkey") % 25), k % 100000 + 1, F.col("l_quantity").cast("int"), cigar, rest)
    rows = rows_of(spark, d, "lineitem").select(record.alias("value")).union(spark.range(1).select(F.lit("@HD\tVN:1.0").alias("value")))
    return text.sam_records(spark, shared.write_text(rows))


def reason() -> Column:
    return calls.alignment_reason(F.col("flag"), F.col("mapq"), F.col("code"), 10)


@query("A15_alignment_scan", f"WITH {READS} SELECT reason, count(*) AS n FROM rs GROUP BY 1")
def a15(spark, d):
    return alignments(spark, d).groupBy(reason().alias("reason")).agg(F.count("*").alias("n"))


@query("B6_decode_calls", f"WITH {DECODED} SELECT qname, locus_key, state FROM ca")
def b6(spark, d):
    return calls.decode_calls(alignments(spark, d).where(reason() == "kept")).where("locus_key is not null").select("qname", "locus_key", "state")


@query("B7_read_positions", f"WITH {DECODED} SELECT qname, locus_key, read_pos, from_start, 12 AS length FROM ca")
def b7(spark, d):
    found = calls.decode_calls(alignments(spark, d).where(reason() == "kept")).where("locus_key is not null")
    length = F.length("xm")
    return found.select("qname", "locus_key", "read_pos", calls.five_prime(F.col("read_pos"), length, F.col("flag")).alias("from_start"), length.alias("length"))


# Stores, inputs, sinks and runs


@query("A16_open_store", "SELECT vec_id AS locus_key, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def a16(spark, d):
    aliases = {"locus_key": ["locus_key", "cpg_idx", "vec_id"], "vec": ["vec", "features", "embedding"]}
    store = text.open_store(rows_of(spark, d, "embeddings"), aliases)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return store.select("locus_key", F.size("vec").cast("long").alias("dim"), F.round(total, 5).alias("total"))


@query("A17_missing_inputs", "SELECT n_nationkey::INTEGER AS nation FROM nation WHERE n_nationkey % 3 = 0")
def a17(spark, d):
    nations = rows_of(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("nation"), F.col("n_name").alias("value"))
    path = shared.write_text(nations.where("nation % 3 <> 0"), "nation")
    there = text.list_files(spark, path).withColumn("nation", F.regexp_extract("path", "nation=([0-9]+)/", 1).cast("int"))
    return text.missing_inputs(nations.select("nation"), there, "nation")


@query("A18_sinks", "SELECT unnest(['csv', 'json', 'parquet']) AS format, batch, official_split, n, total FROM (SELECT batch, official_split, count(*) AS n, sum(sample_id)::BIGINT AS total FROM v_samples GROUP BY ALL)")
def a18(spark, d):
    samples, out = view(spark, d, "v_samples"), None
    for kind in ("csv", "json", "parquet"):
        path = shared.new_path(spark)
        writer = samples.write.partitionBy("batch").format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(path)
        reader = spark.read.schema(samples.schema).option("header", True).format(kind)
        back = reader.load(path).groupBy("batch", "official_split").agg(F.count("*").alias("n"), F.sum("sample_id").alias("total")).select(F.lit(kind).alias("format"), "*")
        out = back if out is None else out.union(back)
    return out


CELLS = "ce AS (SELECT vec_id, 'arm' || (vec_id % 3) AS representation, (vec_id % 2)::INTEGER AS seed, (vec_id % 5)::INTEGER AS fold FROM embeddings)"


@query("A19_completed_runs", f"WITH {CELLS} SELECT representation, seed, fold, count(*) AS n FROM ce WHERE NOT (representation = 'arm1' AND fold = 2) GROUP BY ALL")
def a19(spark, d):
    v = F.col("vec_id")
    rows = rows_of(spark, d, "embeddings").select("vec_id", say("arm", v % 3).alias("representation"), (v % 2).alias("seed"), (v % 5).alias("fold"))
    cells = ["representation", "seed", "fold"]
    saved, marks = shared.new_path(spark), shared.new_path(spark)
    rows.write.partitionBy(*cells).parquet(saved)
    done = rows.select(*cells).distinct().where("not (representation = 'arm1' and fold = 2)")
    done.withColumn("state", F.lit("complete")).write.partitionBy(*cells).json(marks)
    found = text.completed_runs(spark.read.parquet(saved), spark.read.schema("state string, representation string, seed int, fold int").json(marks))
    return found.groupBy(*cells).agg(F.count("*").alias("n"))
