"""Text sources: methylation ratio tables, sample metadata, chain files, FASTA, reports and SAM records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import contig_code, make_key

METHRATIO = "chr string, pos long, strand string, context string, ratio double, eff_CT_count double, C_count long, CT_count long, rev_G_count string, rev_GA_count string, CI_lower double, CI_upper double"
MEMBER = r"^(GSM\d+)_(KRp\d)-(\d+)_bsmap_meth\.txt(\.gz)?$"  # fixed format of the files' names


def member(name: Column) -> list[Column]:
    """sample_id, batch and number from an archive member's name; null for other names."""
    part = lambda i, c: F.when(F.rlike(name, F.lit(MEMBER)), F.regexp_extract(name, MEMBER, i)).alias(c)
    return [part(1, "sample_id"), part(2, "batch"), part(3, "number").cast("int").alias("number")]


def read_methratio(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, batch, chr, code, pos, strand, context, c_count, ct_count) of all tables in a folder; the file's name gives sample and batch."""
    rows = spark.read.schema(METHRATIO).csv(path, sep="\t", header=True, nullValue="NA")
    sample, batch, _ = member(F.col("_metadata.file_name"))
    return rows.select(
        sample, batch, "chr", contig_code(F.col("chr")).alias("code"), "pos", "strand", "context",
        F.col("C_count").alias("c_count"), F.col("CT_count").alias("ct_count"),
    )


CHUNK = 1 << 14  # lines that follow each other and are put in order together
GROUPED = 1 << 18  # lines that a task puts in order


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size. A line's number follows from a table with a row for each split of a file."""
    rows = placed_lines(spark, path)
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(shift), ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def _apart(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """rows by keys, over more tasks than the session's if so many parts are needed."""
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _parts(lines: DataFrame) -> int:
    return lines.count() // GROUPED + 1


def _carried(column: str) -> Column:
    """In a table of chunks, what the last chunk before that has any has in column."""
    return F.last(column, ignorenulls=True).over(W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))


def soft_samples(lines: DataFrame) -> DataFrame:
    """(file, sample, key, value) from `^SAMPLE` blocks; characteristics become keys char_<name>, repeated keys keep the first."""
    parts = _parts(lines)
    block = F.when(F.startswith("line", F.lit("^")), F.when(F.startswith("line", F.lit("^SAMPLE")), F.trim(F.split_part("line", F.lit("="), F.lit(2)))).otherwise(F.lit("")))
    rows = lines.select("*", F.expr(f"line_no div {CHUNK}").alias("chunk"), block.alias("block"))
    ends = rows.where("block is not null").groupBy("file", "chunk").agg(F.max_by("block", "line_no").alias("block"))
    chunks = rows.select("file", "chunk").distinct().join(ends, ["file", "chunk"], "left").select("file", "chunk", _carried("block").alias("carried"))
    local = F.last("block", ignorenulls=True).over(W.partitionBy("file", "chunk").orderBy("line_no"))
    df = _apart(rows, parts, "file", "chunk").withColumn("local", local).join(F.broadcast(chunks), ["file", "chunk"])
    df = df.withColumn("sample", F.coalesce("local", "carried")).where("sample <> '' and line like '!Sample_%=%'").select("file", "line_no", "line", "sample")
    key = F.regexp_extract("line", "^!Sample_([^ =]+)", 1)
    value = F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1))
    df = df.withColumn("key", key).withColumn("value", value)
    inner = F.regexp_extract("value", "^([^:]+):", 1)
    is_char = F.startswith("key", F.lit("characteristics_ch1")) & (inner != "")
    name = F.concat(F.lit("char_"), F.regexp_replace(F.lower(F.trim(inner)), "[^a-z0-9]+", "_"))
    value = F.when(is_char, F.trim(F.regexp_replace("value", "^[^:]+:", ""))).otherwise(F.col("value"))
    df = df.withColumns({"value": value, "key": F.when(is_char, name).otherwise(F.col("key"))})
    return _apart(df, parts, "file", "sample", "key").groupBy("file", "sample", "key").agg(F.min_by("value", "line_no").alias("value"))


def run_rollup(runs: DataFrame) -> DataFrame:
    """Per sample: sorted run ids, urls and checksums joined by semicolons, reads summed, and bytes summed over runs and files."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ";")
    size = F.aggregate(F.split("fastq_bytes", ";"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.try_to_number(x, F.lit("9999999999999999")).cast("long"), F.lit(0).cast("long")))
    return runs.groupBy("sample_alias").agg(joined("run_accession").alias("runs"), joined("fastq_ftp").alias("urls"), joined("fastq_md5").alias("md5"), F.sum("read_count").alias("reads"), F.sum(size).alias("bytes"))


def sample_table(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """samples (sample_id, title, age as text) with their runs; batch from the title's first part, age as a number or null; a sample without runs fails."""
    joined = samples.join(run_rollup(runs), samples.sample_id == F.col("sample_alias"), "left")
    checked = F.when(F.col("sample_alias").isNotNull(), F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("no runs for sample "), F.col("sample_id"))))
    return joined.withColumn("sample_id", checked).withColumn("batch", F.regexp_extract("title", "^([A-Za-z]+[0-9]*)-", 1)).withColumn("age", F.expr("try_cast(age AS DOUBLE)")).drop("sample_alias")


def reconcile(samples: DataFrame, files: DataFrame) -> DataFrame:
    """(problem, sample_id): samples without a file, files without a sample, and batches that differ. Both have sample_id and batch."""
    both = samples.select("sample_id", F.col("batch").alias("a"), F.lit(True).alias("in_samples")).join(files.select("sample_id", F.col("batch").alias("b"), F.lit(True).alias("in_files")), "sample_id", "full_outer")
    problem = F.when(F.col("in_files").isNull(), "no_file").when(F.col("in_samples").isNull(), "no_sample").when(~F.col("a").eqNullSafe(F.col("b")), "batch")
    return both.select(problem.alias("problem"), "sample_id").where("problem is not null")


def cohort_table(patients: DataFrame, files: DataFrame, scores: tuple[str, ...] = ()) -> DataFrame:
    """Second cohort: headers' white space made `_`, columns that begin with one of scores left out, BAM rows of files only, sizes from text, Training/Test recoded, batch by hospital.

    A sample in one table only, one listed twice in a table, or a Set that is neither, fails.
    """
    renamed = patients.select(*(F.col(f"`{c}`").alias("_".join(c.split())) for c in patients.columns if not "_".join(c.split()).startswith(scores)))
    bams = files.where(F.rlike("Files", F.lit(r"\.bam(\s|$)"))).select("sample_id", F.regexp_extract("Files", r"(\d+) bytes", 1).cast("long").alias("bytes"), F.lit(True).alias("has_bam"))
    both = renamed.withColumn("listed", F.lit(True)).join(bams, "sample_id", "full_outer")
    known = F.coalesce(F.col("Set").isin("Training", "Test"), F.lit(False))
    alone = F.count("*").over(W.partitionBy("sample_id")) == 1
    wrong = F.when(F.col("listed").isNull() | F.col("has_bam").isNull(), "in one table only: ").when(~known, "unexpected set: ").when(~alone, "listed twice: ")
    both = both.withColumn("wrong", wrong)
    sample = F.when(F.col("wrong").isNull(), F.col("sample_id")).otherwise(F.raise_error(F.concat("wrong", "sample_id")))
    part = F.when(F.col("Set") == "Training", "train").when(F.col("Set") == "Test", "test")
    return both.withColumn("sample_id", sample).withColumn("official_split", part).withColumn("batch", F.concat(F.lit("hospital_"), F.col("Source"))).drop("listed", "has_bam", "wrong")


def chain_blocks(lines: DataFrame) -> DataFrame:
    """(chain_id, src_code, src_start, size, dst_code, dst_start, strand) of a chain file's ungapped blocks.

    Block starts are sums of the sizes and gaps before them in the chain. Chains of other contigs than 1-22, X and Y are left
    out. On a minus strand, dst_start is turned to the forward strand.
    """
    is_head = F.startswith("line", F.lit("chain"))
    rows = lines.select("*", F.expr(f"line_no div {CHUNK}").alias("chunk"), is_head.alias("is_head"), F.when(~is_head & F.rlike("line", F.lit(r"^\s*\d")), F.split(F.trim("line"), r"\s+")).alias("n"))
    n = lambda i: F.coalesce(F.get("n", F.lit(i)).cast("long"), F.lit(0).cast("long"))
    own = W.partitionBy("file", "chunk").orderBy("line_no")
    sums = {"t": n(0) + n(1), "q": n(0) + n(2)}
    inside = own.rowsBetween(W.unboundedPreceding, -1)
    local = _apart(rows, _parts(lines), "file", "chunk").withColumns({c: F.coalesce(F.sum(x).over(inside), F.lit(0)) for c, x in sums.items()})  # sums of the chunk's lines before
    at = F.when(F.col("is_head"), F.struct("line", "t", "q"))
    local = local.withColumn("head", F.last(at, ignorenulls=True).over(own))
    # A row for each chunk: its sums, those of all before it, and the last head of those with the file's sums before that head.
    chunks = rows.groupBy("file", "chunk").agg(*(F.sum(x).alias(c) for c, x in sums.items()))
    every = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("file", "chunk", *(F.coalesce(F.sum(c).over(every), F.lit(0)).alias(f"{c}_before") for c in sums))
    heads = local.where("is_head").groupBy("file", "chunk").agg(F.max_by("head", "line_no").alias("last"))
    joined = chunks.join(heads, ["file", "chunk"], "left")
    placed = F.when(F.col("last").isNotNull(), F.struct(F.col("last.line").alias("line"), (F.col("last.t") + F.col("t_before")).alias("t"), (F.col("last.q") + F.col("q_before")).alias("q")))
    table = joined.withColumn("placed", placed).select("file", "chunk", "t_before", "q_before", _carried("placed").alias("open"))
    body = local.where("n is not null").join(F.broadcast(table), ["file", "chunk"])
    since = lambda c: F.when(F.col("head").isNotNull(), F.col(c) - F.col(f"head.{c}")).otherwise(F.col(c) + F.col(f"{c}_before") - F.col(f"open.{c}"))
    body = body.select("n", F.split(F.coalesce("head.line", "open.line"), r"\s+").alias("f"), since("t").alias("dt"), since("q").alias("dq"))
    g = lambda i: F.get("f", F.lit(i))
    start = g(10).cast("long") + F.col("dq")
    forward = F.when(g(9) == "-", g(8).cast("long") - start - n(0)).otherwise(start)
    out = body.select(
        g(12).alias("chain_id"), contig_code(g(2)).alias("src_code"), (g(5).cast("long") + F.col("dt")).alias("src_start"), n(0).alias("size"), contig_code(g(7)).alias("dst_code"), forward.alias("dst_start"),
        F.when(g(9) == "-", -1).otherwise(1).alias("strand"),
    )
    return out.where("src_code is not null and dst_code is not null")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, line) of text files of any size. A block is one split of a file; ids put its lines in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")
    )


def fasta_lines(lines: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(contig, offset, line) of the sequence lines of FASTA files, from placed_lines; offset: letters of the contig before.

    Splits of a file are worked on apart. Where a contig goes on over splits, its name and length so far come from a table
    with a row or a few for each split. wanted keeps those contigs alone.
    """
    own = W.partitionBy("file", "block").orderBy("id")
    head = F.when(F.startswith("line", F.lit(">")), F.regexp_extract("line", r"^>(\S*)", 1))
    df = lines.withColumn("head", head).withColumn("local", F.last("head", ignorenulls=True).over(own))
    ends = df.groupBy("file", "block").agg(F.max(F.when(F.col("head").isNotNull(), F.struct("id", "head"))).alias("end"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("end.head", ignorenulls=True).over(before).alias("carried"))
    rows = df.where(F.col("head").isNull() & (F.col("line") != "")).join(carried, ["file", "block"])
    rows = rows.withColumn("contig", F.coalesce("local", "carried")).where("contig is not null")
    if wanted is not None:
        rows = rows.where(F.col("contig").isin(wanted))
    held = rows.groupBy("file", "block", "contig").agg(F.sum(F.length("line")).alias("held"))
    earlier = W.partitionBy("contig").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    shift = held.select("file", "block", "contig", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("shift"))
    inside = W.partitionBy("file", "block", "contig").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.length("line")).over(inside), F.lit(0)))
    return rows.join(shift, ["file", "block", "contig"]).select("contig", (F.col("shift") + F.col("inside")).alias("offset"), "line")


def fasta_sequences(lines: DataFrame) -> DataFrame:
    """(contig, sequence) from fasta_lines, for contigs that fit into a string."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("contig").agg(whole.alias("sequence"))


def motif_positions(lines: DataFrame, by: str, motif: str, chunk: int = 1 << 20) -> DataFrame:
    """(by, pos): 1-based places of a motif in the lines of a sequence, any case, also across line ends.

    lines: by, line and offset, the letters before (as fasta_lines gives), or line_no, from which offsets are summed up. Lines
    are taken in runs of about `chunk` letters (or of as many lines as that makes of 256 letters); the letters that a motif
    may need beyond a run come from a table with a row for each run, so no window holds a whole sequence.
    """
    need = len(motif) - 1
    by_offset = "offset" in lines.columns
    place = "offset" if by_offset else "line_no"
    runs = lines.where(F.col("line") != "").select(by, place, "line", F.floor(F.col(place) / (chunk if by_offset else -(-chunk // 256))).alias("run"))
    order = W.partitionBy(by, "run").orderBy(place)
    rows = runs.withColumn("at", F.row_number().over(order)).withColumn("inside", F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A line has a letter at least, so a run's first lines, as many as the motif needs letters, hold what the run before may need.
    first = F.when(F.col("at") <= need, F.struct("at", "line"))
    heads = rows.groupBy(by, "run").agg(F.array_sort(F.collect_list(first)).alias("first"), F.sum(F.length("line")).alias("held"))
    along = W.partitionBy(by).orderBy("run")  # a row for each run
    head = F.substring(F.array_join(F.transform("first", lambda x: x["line"]), ""), 1, need)
    next_letters = F.concat(F.lit(""), *(F.coalesce(F.lead("head", i).over(along), F.lit("")) for i in range(1, need + 1)))
    before = F.coalesce(F.sum("held").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    beside = heads.withColumn("head", head).select(by, "run", F.substring(next_letters, 1, need).alias("beyond"), before.alias("before"))
    # A following line may be shorter than the rest of a motif, so as many lines as it has letters are put behind.
    behind = F.concat(F.lit(""), *(F.coalesce(F.lead("line", i).over(order), F.lit("")) for i in range(1, need + 1)))
    rows = rows.withColumn("behind", behind).join(beside, [by, "run"])
    offset = F.col("offset") if by_offset else F.col("before") + F.col("inside")
    behind = F.concat("behind", "beyond")
    lines = rows
    text = F.lower(F.concat("line", F.substring(behind, 1, need)))
    # Cut before every match, also of matches that overlap: a piece starts at one, the first only if the line does. Their
    # lengths give the places, in one pass over the line.
    pieces = F.split(text, rf"(?=\Q{motif.lower()}\E)")

    def step(acc: Column, piece: Column) -> Column:
        own = F.when((acc["at"] > 1) | F.startswith(text, F.lit(motif.lower())), F.array(acc["at"])).otherwise(F.array().cast("array<int>"))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["found"], own).alias("found"))

    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    found = F.filter(F.aggregate(pieces, zero, step, lambda acc: acc["found"]), lambda i: i <= F.length("line"))
    df = lines.select(by, offset.alias("offset"), found.alias("found"))
    return df.select(by, "offset", F.explode("found").alias("at")).select(by, (F.col("offset") + F.col("at")).alias("pos"))


def reference_keys(lines: DataFrame, contigs: list[str], motif: str = "CG") -> DataFrame:
    """locus_key of every place of motif on the wanted contigs, from fasta_lines; a contig without any sequence fails."""
    seen = {r[0] for r in lines.where(F.col("contig").isin(contigs)).select("contig").distinct().collect()}  # at most the wanted names
    if missing := sorted(set(contigs) - seen):
        raise ValueError(f"contigs without a sequence: {missing}")
    found = motif_positions(lines.where(F.col("contig").isin(contigs)), "contig", motif)
    return found.select(make_key(contig_code(F.col("contig")), F.col("pos")).alias("locus_key"))


def mbias_report(lines: DataFrame) -> DataFrame:
    """(file, context, read, pos, n_up, n_down, pct, coverage) from sections headed like `CpG context (R1)`; a blank percentage is null."""
    order = W.partitionBy("file").orderBy("line_no")
    head = F.when(F.rlike("line", F.lit(r"^\S+ context")), F.col("line"))
    df = lines.withColumn("head", F.last(head, ignorenulls=True).over(order)).where(F.rlike("line", F.lit(r"^\d+\t")))
    c = F.split("line", "\t")
    v = lambda i: F.get(c, F.lit(i))
    read = F.regexp_extract("head", r"\(R(\d)\)", 1)
    return df.select(
        "file", F.regexp_extract("head", r"^(\S+)", 1).alias("context"), F.when(read == "", 1).otherwise(F.expr(r"try_cast(regexp_extract(head, '\\(R([0-9])\\)', 1) AS INT)")).alias("read"),
        v(0).cast("int").alias("pos"), v(1).cast("long").alias("n_up"), v(2).cast("long").alias("n_down"), F.when(F.trim(v(3)) != "", F.trim(v(3))).cast("double").alias("pct"), v(4).cast("long").alias("coverage"),
    )


def dedup_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, total, removed, rate and folder columns) from reports that name the alignments analysed and the duplicates removed."""
    whole = spark.read.text(path, wholetext=True)
    number = lambda p: F.expr(f"try_cast(regexp_extract(value, r'{p}', 1) AS BIGINT)")
    df = whole.select(*whole.drop("value").columns, F.col("_metadata.file_name").alias("file"), number(r"Total number of alignments analysed[^:]*:\s*(\d+)").alias("total"), number(r"Total number duplicated alignments removed:\s*(\d+)").alias("removed"))
    return df.withColumn("rate", F.try_divide("removed", "total"))


def sam_records(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of SAM text: qname, flag, rname, code, pos (0-based), mapq, cigar and the tags XM and XG; sample_id is the file's name."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")))
    c = F.split("value", "\t")
    v = lambda i: F.get(c, F.lit(i))
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:Z:([^\t]*)", 1)
    return rows.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.sam(\.gz)?$", "").alias("sample_id"), v(0).alias("qname"), v(1).cast("int").alias("flag"), v(2).alias("rname"), contig_code(v(2)).alias("code"),
        (v(3).cast("long") - 1).alias("pos"), v(4).cast("int").alias("mapq"), v(5).alias("cigar"), tag("XM").alias("xm"), tag("XG").alias("xg"),
    )


def resolve_columns(store: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """store's columns under the wanted names, each by the first alias present; a missing or doubtful one fails."""
    picked: list[Column] = []
    for name, options in aliases.items():
        found = [c for c in options if c in store.columns]
        if len(found) != 1:
            raise ValueError(f"{name}: {len(found)} of the columns {options} in {store.columns}")
        picked.append(F.col(found[0]).alias(name))
    return store.select(*picked)


def open_store(store: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(locus_key, vec) of a vector table whatever its columns are called; a repeated or null key, a null vector or vectors of different lengths fail."""
    found = resolve_columns(store, aliases)
    size = found.select(F.size("vec").alias("n")).head(1)
    grouped = found.groupBy("locus_key").agg(F.count("*").alias("k"), F.first("vec").alias("vec"))
    wrong = F.when(F.col("locus_key").isNull(), "null key").when(F.col("k") > 1, "repeated key").when(F.col("vec").isNull(), "null vector").when(F.size("vec") != (size[0][0] if size else 0), "length of vector")
    key = F.when(wrong.isNull(), F.col("locus_key")).otherwise(F.raise_error(F.concat(F.lit("store: "), wrong)).cast("long"))
    return grouped.select(key.alias("locus_key"), "vec")


def missing_inputs(expected: DataFrame, listing: DataFrame, name: str = "file_name") -> DataFrame:
    """Rows of expected whose file is not in listing; listed files without bytes count as missing."""
    return expected.join(listing.where("length > 0").select(name).distinct(), name, "left_anti")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, length) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def completed_runs(predictions: DataFrame, markers: DataFrame, cell: tuple[str, ...] = ("representation", "seed", "fold")) -> DataFrame:
    """The predictions of runs whose marker is there; both tables carry the run's columns, as folders representation=/seed=/fold= give them."""
    return predictions.join(markers.select(*cell).distinct(), list(cell), "left_semi")
