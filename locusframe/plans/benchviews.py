"""Views of the driver's tables in the shapes the operators expect, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_samples": "SELECT c_custkey AS sample_id, c_custkey AS patient_id, c_mktsegment AS diagnosis, concat('B', CAST(c_nationkey % 2 AS VARCHAR(9))) AS batch, CASE WHEN c_custkey % 10 < 7 THEN 'train' ELSE 'test' END AS official_split, c_acctbal AS age FROM {customer}",
    "v_obs": "SELECT o_custkey AS sample_id, (l_partkey % 22 + 1) * 4294967296 + 1000 + CAST(floor(l_partkey / 22) AS BIGINT) * 60 + CAST(floor(l_partkey / 220) AS BIGINT) * 400 AS locus_key, CAST(sum(CAST(floor(l_quantity * l_discount * 10 + 1e-9) AS BIGINT)) AS BIGINT) AS c_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ct_count FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "v_calls": "SELECT o_custkey AS sample_id, l_orderkey AS fragment_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS mate, (o_custkey % 22 + 1) * 4294967296 + 10000 + l_orderkey * 40 + l_linenumber * 5 AS locus_key, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS state FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "v_reads": "SELECT o_custkey AS sample_id, l_orderkey AS fragment_id, 1 + l_linenumber % 2 AS mate, (o_custkey % 22 + 1) * 4294967296 + 10000 + l_orderkey * 40 + CAST(floor(l_linenumber / 2) AS BIGINT) * 5 AS locus_key, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS state, l_partkey % 50 AS read_pos, 52 + l_suppkey % 9 AS read_len FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "v_chain": "SELECT p_partkey AS block_id, p_partkey % 22 + 1 AS src_code, CAST(floor(p_partkey / 22) AS BIGINT) * 500 AS src_start, 300 + CAST(p_size AS BIGINT) * 6 AS size, (p_partkey * 7) % 22 + 1 AS dst_code, 1000000 + CAST(floor(p_partkey / 22) AS BIGINT) * 450 AS dst_start, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END AS strand FROM {part}",
    "v_points": "SELECT DISTINCT (l_partkey % 22 + 1) * 4294967296 + (l_orderkey * 37) % 46000 + 1 AS locus_key FROM {lineitem}",
    "v_methratio": "SELECT o_custkey AS sample_id, l_partkey % 24 + 1 AS code, CAST(100 + l_orderkey * 8 + l_linenumber AS BIGINT) AS pos, '+' AS strand, CASE WHEN l_returnflag = 'N' THEN 'CHG' ELSE 'CG' END AS context, CAST(floor(l_quantity * l_discount * 10 + 1e-9) AS BIGINT) AS c_count, CAST(l_quantity AS BIGINT) AS ct_count FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "v_events": "SELECT user_id, ts, value FROM {events}",
}


GROUPED = 1 << 18  # rows of lineitem that a task of a view joins, sorts and groups
ORDER = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the tables in sf_dir.

    Where lineitem meets orders, what groups by fragment goes on in the join's tasks, so these become more as the tables grow:
    a task holds GROUPED rows, whatever the session's number of shuffle partitions, which is kept if it is enough.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    if tables.keys() == ORDER.keys():
        parts = tables["lineitem"].count() // GROUPED + 1  # counted in the files' footers
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            tables = {t: rows.repartition(parts, ORDER[t]) for t, rows in tables.items()}
    return spark.sql(VIEWS[name], **tables)


def with_views(sql: str) -> str:
    """sql with the views it names as leading common table expressions, for DuckDB."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({VIEWS[n].format(**{t: t for t in tables_of(n)})})" for n in named]
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {', '.join(heads)}, {sql[5:]}" if heads else sql
    return f"WITH {', '.join(heads)} {sql}" if heads else sql
