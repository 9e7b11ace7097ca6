"""Queries that run as streams: input arrives in two parts, the stream stops between them and goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beta
from ..sources import shared
from ..streaming import incremental
from .benchviews import view
from .registry import OBS, POOL, RB, pooled_rows, query, rounded


HELD = 1 << 19  # rows that a task writes for a stream, or whose sums it keeps
STORE = {  # the sums lie on the executors' disks, within so many MB of an executor's memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "512",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # a look-up for every row that is put
}


def tasks(spark: SparkSession, rows: int) -> int:
    """As many as rows need, at least the session's number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // HELD + 1)


def taken_up_again(parts: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str, files: int = 4, at_once: int = 2) -> DataFrame:
    """What a stream over parts, which arrive one after another, writes to its sink, with the number of each micro-batch as `batch`.

    Every part is some files, at_once of which make a batch. When a part is done the stream ends; the next part starts it
    again from the checkpoint, with the sums that it had. A batch that is run again replaces what it has written.

    A large part has more files, and as many more make a batch; the sums lie in as many tasks as the rows of all parts need.
    """
    spark = parts[0].sparkSession
    source, checkpoint, sink = (shared.new_path(spark) for _ in range(3))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    sizes = [part.count() for part in parts]
    store = STORE | {"spark.sql.shuffle.partitions": str(tasks(spark, sum(sizes)))}
    for part, size in zip(parts, sizes):
        more = size // (HELD * files) + 1
        part.repartition(files * more).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", at_once * more).parquet(source)
        with shared.settings(spark, store):
            running = make(stream).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            running.awaitTermination()
    return spark.read.parquet(sink)


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    updates = updates.repartition(tasks(updates.sparkSession, updates.count()), *keys)  # counted in the files' footers
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


@query("S1_running_regions", f"WITH {RB} SELECT sample_id, region_id, round(region_beta, 6) AS region_beta FROM rb")
def s1(spark, d):
    """D3 as a stream of counts: half of the loci, then the others."""
    counts = shared.kept(view(spark, d, "v_obs"))
    regions = shared.kept(beta.candidate_regions(counts, 150))
    halves = [counts.where("locus_key % 2 = 0"), counts.where("locus_key % 2 <> 0")]
    found = newest(taken_up_again(halves, lambda s: incremental.running_regions(s, regions), "update"), ["sample_id", "region_id"])
    return rounded(found.select("sample_id", "region_id", (F.col("weighted") / F.col("coverage")).alias("region_beta")))


@query("S1_running_summary", f"WITH {OBS} SELECT sample_id, count(*) AS n_observed, round(avg(beta), 6) AS mean_beta, round(var_pop(beta), 6) AS var_beta, round(avg(coverage), 6) AS mean_coverage FROM ob GROUP BY sample_id")
def s1s(spark, d):
    """D1 as a stream, but for its medians."""
    counts = shared.kept(view(spark, d, "v_obs"))
    halves = [counts.where("locus_key % 2 = 0"), counts.where("locus_key % 2 <> 0")]
    return rounded(newest(taken_up_again(halves, incremental.running_summary, "update"), ["sample_id"]))


@query("S2_running_pool", POOL)
def s2(spark, d):
    """I1 as a stream of vectors: a group's state is its largest score and two sums."""
    rows = pooled_rows(spark, d)
    halves = [rows.where("vec_id % 2 = 0").drop("vec_id"), rows.where("vec_id % 2 <> 0").drop("vec_id")]
    found = newest(taken_up_again(halves, lambda s: incremental.running_softmax(s, "bag"), "update"), ["bag"])
    apart = found.select("bag", "s", F.posexplode("v").alias("dim", "x"))
    return rounded(apart.select("bag", "dim", (F.col("x") / F.col("s")).alias("pooled")))


@query("S3_closed_sessions", """WITH s AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS s FROM v_events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s), g AS (SELECT user_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) + 1800000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, session)
SELECT user_id, first_us, end_us, n, total FROM g WHERE end_us <= (SELECT max(epoch_us(ts)) FROM v_events) - 3600000000""")
def s3(spark, d):
    """E1_sessions as a stream in the order of time: sessions that an hour has passed since."""
    events = view(spark, d, "v_events").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    cut = events.agg(F.percentile_approx(micros, 0.5)).first()[0] or 0
    halves = [events.where(micros <= cut), events.where(micros > cut)]
    found = taken_up_again(halves, incremental.event_sessions, "append", files=1)
    return found.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 4).alias("total"))
