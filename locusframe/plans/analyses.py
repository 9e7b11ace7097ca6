"""Queries of vectors, shards, splits on disk, group tests, features and fold loops."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.loci import draw, make_key, random_positions
from ..operators import beta, calls, intervals, metrics, models, numbering, pooling, represent, splits
from ..sources import shared
from .benchviews import view
from .files import BASES, LETTER
from .registry import FOLDS, OBS, RB, STATUS, chain_status, embedding_store, labelled, observations, predictions, query, rounded, seeded_hash, selected_features, split_table, values, with_regions

# Vectors made from keys

LOCI = "(SELECT DISTINCT locus_key FROM v_obs)"
WHOLE = "18446744073709551616::UHUGEINT"  # 2^64


def mixed(x: str, name: str, source: str, keep: str) -> str:
    """CTEs that add `name`, the 64-bit mix of expression x over source, to the columns keep."""
    inc, one, two = (f"'{v}'::UHUGEINT" for v in represent.SPLITMIX)
    return f"""{name}_a AS (SELECT {keep}, ({x} + {inc}) % {WHOLE} AS z FROM {source}), {name}_b AS (SELECT {keep}, (xor(z, z >> 30) * {one}) % {WHOLE} AS z FROM {name}_a),
{name}_c AS (SELECT {keep}, (xor(z, z >> 27) * {two}) % {WHOLE} AS z FROM {name}_b), {name} AS (SELECT {keep}, xor(z, z >> 31) AS {name}_x FROM {name}_c)"""


UNIFORM = f"lc AS (SELECT locus_key::UHUGEINT AS k FROM {LOCI}), " + mixed("17::UHUGEINT", "sd", "(SELECT 1 AS one)", "one") + ", " + mixed("xor(k, (SELECT sd_x FROM sd))", "ba", "lc", "k")
SLOTS = UNIFORM + ", sl AS MATERIALIZED (SELECT k, j, (ba_x + j::UHUGEINT) % " + WHOLE + " AS slot FROM ba CROSS JOIN (SELECT unnest(range(32)) AS j)), " + mixed("slot", "mx", "sl", "k, j") + ", un AS MATERIALIZED (SELECT k, j, ((mx_x >> 11)::DOUBLE + 0.5) / 9007199254740992 AS u FROM mx)"


@query("B10_unit_uniform", f"WITH {UNIFORM} SELECT k::BIGINT AS locus_key, round(((ba_x >> 11)::DOUBLE + 0.5) / 9007199254740992, 9) AS u FROM ba")
def b10(spark, d):
    loci = view(spark, d, "v_obs").select("locus_key").distinct()
    return represent.locus_uniform(loci, 17).select("locus_key", F.round("u", 9).alias("u"))


@query("B11_random_vectors", f"WITH {SLOTS} SELECT a.k::BIGINT AS locus_key, a.j::INTEGER AS dim, round((sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u))::FLOAT::DOUBLE, 4) AS x FROM un a JOIN un b ON a.k = b.k AND b.j = a.j + 16 WHERE a.j < 16")
def b11(spark, d):
    found = represent.random_vectors(view(spark, d, "v_obs").select("locus_key").distinct(), 16, 17)
    return found.select("locus_key", F.posexplode("vec").alias("dim", "x")).select("locus_key", "dim", F.round(F.col("x").cast("double"), 4).alias("x"))


PERIODS = "[" + ", ".join(repr(16.0 * (2.7e8 / 16.0) ** (i / 3)) for i in range(4)) + "]"


@query("B12_position_vectors", f"SELECT locus_key, (i - 1)::INTEGER AS dim, round(CASE WHEN i <= 24 THEN CASE WHEN locus_key // 4294967296 = i THEN 1 ELSE 0 END WHEN i <= 28 THEN sin(locus_key % 4294967296 * 2 * pi() / {PERIODS}[i - 24]) ELSE cos(locus_key % 4294967296 * 2 * pi() / {PERIODS}[i - 28]) END, 6) AS x FROM (SELECT locus_key, unnest(range(1, 33)) AS i FROM {LOCI})")
def b12(spark, d):
    loci = view(spark, d, "v_obs").select("locus_key").distinct()
    return rounded(loci.select("locus_key", F.posexplode(represent.position_vector(F.col("locus_key"), 32)).alias("dim", "x")))


@query("B13_empty_vectors", f"SELECT locus_key, 0 AS dim FROM {LOCI}")
def b13(spark, d):
    return represent.empty_vectors(view(spark, d, "v_obs").select("locus_key").distinct()).select("locus_key", F.size("vec").alias("dim"))


@query("B14_covers", f"WITH m AS (SELECT locus_key FROM {LOCI} WHERE locus_key % 11 = 0) SELECT (SELECT count(*) FROM m) AS n, (SELECT string_agg(locus_key, ',' ORDER BY locus_key) FROM (SELECT * FROM m ORDER BY locus_key LIMIT 5)) AS first")
def b14(spark, d):
    loci = view(spark, d, "v_obs").select("locus_key").distinct()
    return intervals.missing_summary(loci, loci.where("locus_key % 11 <> 0"))


@query("B17_narrowed", "SELECT vec_id AS locus_key, (i - 1)::INTEGER AS dim, round((embedding[i]::DOUBLE / 3)::FLOAT::DOUBLE, 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)")
def b17(spark, d):
    third = F.transform("vec", lambda x: (x.cast("double") / 3).cast("float").cast("double"))
    return rounded(embedding_store(spark, d).select("locus_key", F.posexplode(third).alias("dim", "x")))


@query("B19_batch_task", "SELECT batch AS label, diagnosis AS tissue_label, right(batch, 1)::INTEGER AS label_idx, count(*) AS n FROM v_samples GROUP BY ALL")
def b19(spark, d):
    return splits.task_samples(labelled(spark, d), by_batch=True).groupBy("label", "tissue_label", "label_idx").agg(F.count("*").alias("n"))


@query("H6_unpacked_bits", "SELECT doc_id, lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT), 32, '0')[1:29] AS bits FROM documents")
def h6(spark, d):
    packed = F.unhex(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(represent.unpack_bits(packed, 29), "").alias("bits"))


@query("H8_position_cosine", f"WITH n AS (SELECT locus_key, lead(locus_key) OVER (PARTITION BY locus_key // 4294967296 ORDER BY locus_key) - locus_key AS gap FROM {LOCI}) SELECT locus_key, round((1 + list_sum([cos(gap * 2 * pi() / p) for p in {PERIODS}])) / 5, 6) AS cosine FROM n WHERE gap IS NOT NULL")
def h8(spark, d):
    loci = view(spark, d, "v_obs").select("locus_key").distinct()
    following = F.lead("locus_key").over(W.partitionBy(F.shiftright("locus_key", 32)).orderBy("locus_key"))
    both = loci.withColumn("next", following).where("next is not null")
    vec = lambda k: represent.position_vector(F.col(k), 32)
    return rounded(both.select("locus_key", represent.cosine(vec("locus_key"), vec("next")).alias("cosine")))


# Stores


@query("C10_resorted_calls", f"WITH {STATUS}, po AS (SELECT l_orderkey AS fragment_id, l_linenumber AS line, (l_partkey % 22 + 1) * 4294967296 + (l_orderkey * 37) % 46000 + 1 AS locus_key FROM lineitem) SELECT fragment_id, target AS locus_key, row_number() OVER (PARTITION BY fragment_id ORDER BY target)::INTEGER AS rank FROM po JOIN sta USING (locus_key) WHERE status = 'kept'")
def c10(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    own = rows.select(F.col("l_orderkey").alias("fragment_id"), make_key(F.col("l_partkey") % 22 + 1, F.col("l_orderkey") * 37 % 46000 + 1).alias("locus_key"))
    return calls.by_lifted_position(own, chain_status(spark, d), ["fragment_id"]).select("fragment_id", "locus_key", "rank")


@query("C19_shard_report", f"WITH b AS (SELECT * FROM {LOCI} WHERE locus_key % 3 <> 0), e AS (SELECT * FROM {LOCI} WHERE locus_key % 3 <> 1 AND locus_key % 7 <> 0), p AS (SELECT locus_key, count(*) AS k FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY 1), r AS (SELECT * FROM {LOCI} WHERE locus_key % 5 <> 0) SELECT (SELECT count(*) FROM b) AS n_base, (SELECT count(*) FROM e) AS n_extension, (SELECT count(*) FROM p WHERE k > 1) AS repeated, (SELECT count(*) FROM r WHERE locus_key NOT IN (SELECT locus_key FROM p)) AS missing, (SELECT count(*) FROM p WHERE locus_key NOT IN (SELECT locus_key FROM r)) AS unexpected")
def c19(spark, d):
    loci = view(spark, d, "v_obs").select("locus_key").distinct()
    return intervals.shard_report(loci.where("locus_key % 3 <> 0"), loci.where("locus_key % 3 <> 1 and locus_key % 7 <> 0"), loci.where("locus_key % 5 <> 0"))


@query("C19_merged_shards", f"SELECT locus_key, locus_key % 3 = 0 AS extension FROM {LOCI}")
def c19b(spark, d):
    loci = view(spark, d, "v_obs").select("locus_key").distinct().withColumn("extension", F.col("locus_key") % 3 == 0)
    return intervals.merge_shards(loci.where("not extension"), loci.where("extension"))


@query("H4_materialise", f"WITH a AS (SELECT vec_id AS k, row_number() OVER (ORDER BY {seeded_hash('17', 'vec_id')}, vec_id) AS at_, row_number() OVER (ORDER BY {seeded_hash('17-source', 'vec_id')}, vec_id) AS bt FROM embeddings) SELECT a.k AS locus_key, round(list_sum(e.embedding::DOUBLE[]), 5) AS total FROM a JOIN a b ON a.at_ = b.bt JOIN embeddings e ON e.vec_id = b.k")
def h4(spark, d):
    store, path = embedding_store(spark, d), shared.new_path(spark)
    loci = store.select("locus_key")
    represent.materialise(store, loci, path, shuffle_seed=17)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return represent.load_materialised(loci, path).select("locus_key", F.round(total, 5).alias("total"))


@query("H5_block_svd")
def h5(spark, d):
    """Sixteen bits of a hash beside each vector, on contigs by the key's residue."""
    e = embedding_store(spark, d)
    bits = represent.unpack_bits(F.unhex(F.substring(F.md5(F.col("locus_key").cast("string")), 1, 4)), 16)
    keyed = e.select(((F.col("locus_key") % 22 + 1) * (1 << 32) + F.col("locus_key")).alias("locus_key"), bits.alias("bits"), "vec")
    found, _ = represent.block_svd(keyed, 8, 2000, 17)
    return found.select("locus_key", F.posexplode("vec").alias("dim", "x"))


def turned(df, key="locus_key"):
    """(key, length, next): each vector's square and its product with the following one's, which no rotation of the axes changes."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    following = df.select((F.col(key) - 1).alias(key), F.col("vec").alias("after"))
    return df.join(following, key, "left").select(key, F.round(dot("vec", "vec"), 6).alias("length"), F.round(dot("vec", "after"), 6).alias("next"))


@query("H1_projection_products", f"""WITH fi AS (SELECT * FROM embeddings ORDER BY {seeded_hash('17', 'vec_id')}, vec_id LIMIT 2000), mo AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, var_pop(embedding[i]::DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM fi) GROUP BY 1),
me AS (SELECT list(m ORDER BY i) AS m, 64 / sum(v) AS f FROM mo), ce AS (SELECT vec_id, f, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE - m[i]) AS x FROM embeddings, me)
SELECT a.vec_id AS locus_key, round(list_inner_product(a.x, a.x) * a.f, 6) AS length, round(list_inner_product(a.x, b.x) * a.f, 6) AS next FROM ce a LEFT JOIN ce b ON b.vec_id = a.vec_id + 1""")
def h1p(spark, d):
    """All 64 axes: products of projected vectors are those of the centred ones, times the common scale."""
    store = embedding_store(spark, d)
    mean, axes, _ = represent.principal_axes(store, 64, 2000, 17)
    return turned(represent.by_matrix(store, axes, mean))


BLOCKS = f"""bk AS (SELECT vec_id, (vec_id % 22 + 1) * 4294967296 + vec_id AS k, embedding, lpad(bin(('0x' || substr(md5(vec_id::VARCHAR), 1, 4))::BIGINT), 16, '0') AS bits FROM embeddings),
bq AS (SELECT k // 4294967296 AS code, round(count(*) * 2000 / sum(count(*)) OVER ()) AS quota FROM bk GROUP BY 1),
bf AS (SELECT * FROM (SELECT bk.*, quota, row_number() OVER (PARTITION BY k // 4294967296 ORDER BY {seeded_hash('17', 'k')}, k) AS rn FROM bk JOIN bq ON k // 4294967296 = code) WHERE rn <= quota),
bs AS (SELECT 1 / greatest(sqrt(avg(length(replace(bits, '0', '')) / 16)), 1e-8) AS scale FROM bf), bm AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m, CASE WHEN stddev_pop(embedding[i]::DOUBLE) < 1e-6 THEN 1 ELSE stddev_pop(embedding[i]::DOUBLE) END AS s FROM (SELECT *, unnest(range(1, 65)) AS i FROM bf) GROUP BY 1)),
bx AS (SELECT vec_id, k, list_transform(range(1, 81), lambda i: CASE WHEN i <= 16 THEN CASE WHEN bits[i] = '1' THEN scale ELSE 0 END ELSE (embedding[i - 16]::DOUBLE - m[i - 16]) / s[i - 16] END) AS x FROM bk, bs, bm)"""


@query("H5_block_products", f"WITH {BLOCKS} SELECT a.k AS locus_key, round(list_inner_product(a.x, a.x), 6) AS length, round(list_inner_product(a.x, b.x), 6) AS next FROM bx a LEFT JOIN bx b ON b.k = a.k + 22 AND a.k // 4294967296 = b.k // 4294967296")
def h5p(spark, d):
    """All 80 axes: products of projected rows are those of the combined ones."""
    e = embedding_store(spark, d)
    bits = represent.unpack_bits(F.unhex(F.substring(F.md5(F.col("locus_key").cast("string")), 1, 4)), 16)
    keyed = e.select(((F.col("locus_key") % 22 + 1) * (1 << 32) + F.col("locus_key")).alias("locus_key"), bits.alias("bits"), "vec")
    found, _ = represent.block_svd(keyed, 80, 2000, 17)
    dense = found.withColumn("locus_key", F.col("locus_key").bitwiseAND(F.lit((1 << 32) - 1)))
    following = dense.select((F.col("locus_key") - 22).alias("locus_key"), F.col("vec").alias("after"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = dense.join(following, "locus_key", "left")
    key = ((F.col("locus_key") % 22 + 1) * (1 << 32) + F.col("locus_key")).alias("locus_key")
    return both.select(key, F.round(dot("vec", "vec"), 6).alias("length"), F.round(dot("vec", "after"), 6).alias("next"))


@query("F4_random_positions", f"WITH {BASES}, ln AS (SELECT code, length(seq) AS length, coalesce(sum(length(seq)) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ba), w AS (SELECT sum(length) AS whole FROM ln), s AS (SELECT ((({seeded_hash('17-high', 'id')}) * 1048576 + ({seeded_hash('17-low', 'id')}) % 1048576) % whole)::BIGINT AS x FROM (SELECT unnest(range(5000)) AS id), w) SELECT DISTINCT code * 4294967296 + (x - before)::BIGINT + 1 AS locus_key FROM s JOIN ln ON x >= before AND x < before + length")
def f4(spark, d):
    lengths = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_partkey") % 22 + 1).alias("code")).agg(F.count(F.expr(LETTER)).alias("length"))
    return random_positions(lengths, 5000, 17)


@query("F6_smallest_samples", "SELECT sample_id, count(*) AS n FROM v_calls GROUP BY 1 ORDER BY n, sample_id LIMIT 10")
def f6(spark, d):
    return view(spark, d, "v_calls").groupBy("sample_id").agg(F.count("*").alias("n")).orderBy("n", "sample_id").limit(10)


# Splits and samples


@query("G7_split_manifest", f"WITH {FOLDS} SELECT fold, split, label, count(*) AS n, bit_xor(('0x' || substr(h, 1, 8))::BIGINT) AS print, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS total FROM (SELECT *, md5('|' || fold || '|' || patient_id || '|' || split) AS h FROM sp) GROUP BY ALL")
def g7(spark, d):
    path = shared.new_path(spark)
    table = split_table(spark, d)
    splits.keep_splits(table, path)
    return splits.manifest(splits.keep_splits(table, path))


@query("G8_label_guard", "SELECT official_split AS split, CASE WHEN official_split <> 'test' THEN diagnosis END AS label, count(*) AS n FROM v_samples GROUP BY ALL")
def g8(spark, d):
    samples = labelled(spark, d).select("sample_id", "label", F.col("official_split").alias("split"))
    return splits.guarded(samples, ["label"]).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("G10_task_samples", "WITH s AS (SELECT *, CASE WHEN sample_id % 97 > 3 AND diagnosis = 'MACHINERY' THEN 'B0' ELSE batch END AS b FROM v_samples WHERE diagnosis <> 'FURNITURE'), k AS (SELECT diagnosis FROM (SELECT diagnosis, b, count(DISTINCT patient_id) AS n FROM s GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2 AND min(n) >= 8) SELECT sample_id, diagnosis AS label, (dense_rank() OVER (ORDER BY diagnosis) - 1)::INTEGER AS label_idx FROM s WHERE diagnosis IN (SELECT diagnosis FROM k)")
def g10(spark, d):
    planted = F.when((F.col("sample_id") % 97 > 3) & (F.col("diagnosis") == "MACHINERY"), "B0").otherwise(F.col("batch"))
    return splits.task_samples(labelled(spark, d).withColumn("batch", planted), ("FURNITURE",), 8).select("sample_id", "label", "label_idx")


@query("D2_summary_features", f"WITH {OBS} SELECT row_number() OVER (ORDER BY {seeded_hash('17', 'c.sample_id')}, c.sample_id) AS place, c.sample_id, n_observed, mean_beta FROM v_samples c LEFT JOIN (SELECT sample_id, count(*) AS n_observed, round(avg(beta), 6) AS mean_beta FROM ob GROUP BY 1) s ON c.sample_id = s.sample_id")
def d2(spark, d):
    drawn = view(spark, d, "v_samples").select("sample_id", draw("17", F.col("sample_id")).alias("drawn"))
    samples = numbering.numbered(drawn, [], ["drawn", "sample_id"], "place").drop("drawn")
    return rounded(beta.summary_features(beta.sample_summary(observations(spark, d)), samples, ["n_observed", "mean_beta"]))


# Group tests

SHAPES = "sh AS (SELECT sample_id, mate AS read, avg(CASE WHEN locus_key // 5 % 40 < 10 THEN 100 * state END) - median(100 * state) AS dev FROM v_calls GROUP BY ALL), sb AS (SELECT read, batch, round(dev, 9) AS dev FROM sh JOIN v_samples USING (sample_id) WHERE dev IS NOT NULL)"


def shapes(spark, d):
    """(read, batch, dev) of each sample: mean percentage of the first ten positions minus the median over all."""
    pct = 100 * F.col("state")
    head = F.avg(F.when(F.expr("locus_key div 5 % 40 < 10"), pct))
    each = view(spark, d, "v_calls").groupBy("sample_id", F.col("mate").alias("read")).agg((head - F.median(pct)).alias("dev")).where("dev is not null")
    return each.join(view(spark, d, "v_samples").select("sample_id", "batch"), "sample_id").select("read", "batch", F.round("dev", 9).alias("dev"))


@query("D37_batch_shapes", f"WITH {SHAPES}, k AS (SELECT *, rank() OVER (PARTITION BY read ORDER BY dev) + (count(*) OVER (PARTITION BY read, dev) - 1) / 2 AS r FROM sb), t AS (SELECT read, sum(c::DOUBLE * c * c - c) AS t FROM (SELECT read, dev, count(*) AS c FROM sb GROUP BY ALL) GROUP BY 1), g AS (SELECT read, count(*) FILTER (batch = 'B0') AS n1, count(*) FILTER (batch <> 'B0') AS n2, avg(dev) FILTER (batch = 'B0') AS mean1, avg(dev) FILTER (batch <> 'B0') AS mean2, sum(r) FILTER (batch = 'B0') AS s FROM k GROUP BY 1), u AS (SELECT g.*, s - n1 * (n1 + 1) / 2 AS u, t, (n1 + n2)::DOUBLE AS n FROM g JOIN t ON g.read = t.read) SELECT read, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(u, 6) AS u, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))), 6) AS z FROM u")
def d37(spark, d):
    return rounded(metrics.grouped_mann_whitney(shapes(spark, d), ["read"], "batch", "dev", "B0"))


@query("D37_batch_shapes_p")
def d37b(spark, d):
    return rounded(metrics.with_normal_p(metrics.grouped_mann_whitney(shapes(spark, d), ["read"], "batch", "dev", "B0")))


@query("D31_spearman_p")
def d31p(spark, d):
    return rounded(metrics.spearman_p(metrics.spearman(metrics.predicted(predictions(spark, d), ["arm"]), "conf", "sample_id", ["arm"])))


@query("D32_rank_tests_p")
def d32p(spark, d):
    s = view(spark, d, "v_samples")
    groups = metrics.with_chi2_p(metrics.rank_tests(s.select("diagnosis", "age"), "diagnosis", "age")).select(F.lit("kruskal_wallis").alias("test"), F.col("h").alias("statistic"), "p")
    two = metrics.with_normal_p(metrics.mann_whitney(s.select("batch", "age"), "batch", "age", "B0")).select(F.lit("mann_whitney"), "z", "p")
    return rounded(groups.union(two))


@query("D32_within_strata", "WITH k AS (SELECT diagnosis, batch, age, rank() OVER (PARTITION BY diagnosis ORDER BY age) + (count(*) OVER (PARTITION BY diagnosis, age) - 1) / 2 AS r FROM v_samples), g AS (SELECT diagnosis, count(*) FILTER (batch = 'B0') AS n1, count(*) FILTER (batch <> 'B0') AS n2, sum(r) FILTER (batch = 'B0') AS s FROM k GROUP BY 1) SELECT diagnosis, n1, n2, round(s - n1 * (n1 + 1) / 2, 6) AS u FROM g")
def d32s(spark, d):
    return rounded(metrics.grouped_mann_whitney(view(spark, d, "v_samples").select("diagnosis", "batch", "age"), ["diagnosis"], "batch", "age", "B0").select("diagnosis", "n1", "n2", "u"))


# Pooling weights and features


@query("I1_pool_weights", "WITH h AS (SELECT vec_id, label AS bag, (i - 1)::INTEGER AS head, 5 * embedding[i]::DOUBLE AS s FROM (SELECT *, unnest(range(1, 4)) AS i FROM embeddings)) SELECT vec_id, bag, head, round(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), 6) AS weight FROM h WINDOW w AS (PARTITION BY bag, head)")
def i1w(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    heads = F.transform(F.slice("embedding", 1, 3), lambda x: 5 * x.cast("double"))  # a score for each of three heads
    rows = e.select("vec_id", F.col("label").alias("bag"), F.posexplode(heads).alias("head", "score"))
    return rounded(pooling.pool_weights(rows, ["bag", "head"]).select("vec_id", "bag", "head", "weight"))


@query("K1_balanced_weights", "SELECT sample_id, round(count(*) OVER () / (5 * count(*) OVER (PARTITION BY diagnosis)), 6) AS weight FROM v_samples")
def k1(spark, d):
    return rounded(models.balanced_weights(labelled(spark, d)).select("sample_id", "weight"))


@query("K2_imputed_regions", f"WITH {RB}, jf AS (SELECT rb.*, official_split = 'train' AS fit FROM rb JOIN v_samples USING (sample_id)), rg2 AS (SELECT region_id FROM jf WHERE fit GROUP BY 1 HAVING count(DISTINCT sample_id) >= 0.1 * (SELECT count(*) FROM v_samples WHERE official_split = 'train')), md AS (SELECT region_id, median(region_beta) AS fill FROM jf WHERE fit GROUP BY 1) SELECT s.sample_id, g.region_id, round(coalesce(rb.region_beta, md.fill), 6) AS region_beta FROM v_samples s CROSS JOIN rg2 g LEFT JOIN rb ON rb.sample_id = s.sample_id AND rb.region_id = g.region_id LEFT JOIN md ON md.region_id = g.region_id")
def k2(spark, d):
    region, samples = values(spark, d), view(spark, d, "v_samples")
    fit = samples.where("official_split = 'train'")
    seen = beta.observed_regions(region.join(fit.select("sample_id"), "sample_id"), fit.count(), 0.1)
    return rounded(beta.impute_medians(region, fit, samples, seen))


SUMMARY = ("n_observed", "mean_beta", "var_beta", "mean_coverage")


@query("K6_fold_loop")
def k6(spark, d):
    """Five folds of the summary baseline: every sample is predicted once, by the model of the fold that did not see it."""
    summary = shared.kept(beta.sample_summary(observations(spark, d)))

    def features(fit, placed):
        each = F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in SUMMARY))
        long = placed.select("sample_id").join(summary, "sample_id", "left").select("sample_id", F.inline(each))
        return models.assemble(long, "sample_id", "name", "value")

    samples = labelled(spark, d).select("sample_id", "patient_id", "label", "label_idx")
    return models.fold_loop(features, samples, shared.kept(split_table(spark, d)))


@query("K6_region_folds")
def k6r(spark, d):
    """Two seeds of three folds of K3: regions are tested, selected and filled on each fold's own fit samples."""
    samples = labelled(spark, d)
    people = splits.patients(samples, ["label", "batch"])
    own = with_regions(spark, d, samples.select("sample_id", "patient_id", "label", "label_idx"))
    first, second = (models.fold_loop(selected_features, own, shared.kept(splits.kfold_splits(people, 3, 20, seed))).select(F.lit(seed).alias("seed"), "*") for seed in (17, 42))
    return first.union(second)
