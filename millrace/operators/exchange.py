"""Partitioning and map-side writing: which row goes to which partition, in what order, buffer and batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.folds import fold_sorted
from millrace.plans.registry import query
from millrace.sources.tables import PARTITIONS_SQL, batches, key_counts, pmod, read_table, records

MAX_PARTITION_ID = (1 << 24) - 1
SORT_MODE_PARTITIONS = 2000


def partition_id(key: Column, n: int) -> Column:
    """Partition of an integer key: its value modulo n, never negative."""
    return F.pmod(key, F.lit(n)).cast("int")


def legal_partition(pid: Column, n: int) -> Column:
    return pid.isNotNull() & (pid >= 0) & (pid < n) & (pid <= MAX_PARTITION_ID)


def checked_partitions(df: DataFrame, column: str, n: int) -> DataFrame:
    """df, failing the job at the first row whose partition id is outside 0..n-1."""
    legal = legal_partition(F.col(column), n)
    return df.where(F.assert_true(legal, F.concat(F.lit("Illegal partition for "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).isNull())


def to_all_partitions(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each partition."""
    return df.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def write_mode(partitions: Column) -> Column:
    return F.when(partitions > SORT_MODE_PARTITIONS, F.lit("SORT")).otherwise(F.lit("HASH"))


def map_side_combined(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and count by key; Spark combines within each map task before the exchange."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def sorted_runs(df: DataFrame, pid: str, order: list[str], n: int) -> DataFrame:
    """df dealt to n partitions by pid, each sorted by pid and order: one exchange, one local sort."""
    return df.repartition(n, pid).sortWithinPartitions(pid, *order)


def flushes(df: DataFrame, keys: list[str], order: list[str], size: str, capacity: int) -> DataFrame:
    """df with flush_id and giant: a buffer is flushed when the next record does not fit; larger records bypass it."""

    def step(state, row):
        flush, used = state
        n = row[size]
        if n > capacity:
            return (flush, used), (None, True)
        if used + n > capacity:
            flush, used = flush + 1, 0
        return (flush, used + n), (flush, False)

    return fold_sorted(df, keys, order, lambda: (0, 0), step, "flush_id int, giant boolean")


def packed(df: DataFrame, keys: list[str], order: list[str], subpartition: str, size: str, capacity: int, header: int) -> DataFrame:
    """df with buffer_id: neighbours of one subpartition share a buffer while their bytes, less one header, fit."""

    def step(state, row):
        buffer, sub, used = state
        n = row[size]
        if n == 0:
            return state, (None,)
        if sub is None or row[subpartition] != sub or used + n - header > capacity:
            return (buffer + 1, row[subpartition], n), (buffer + 1,)
        return (buffer, sub, used + n - header), (buffer,)

    return fold_sorted(df, keys, order, lambda: (-1, None, 0), step, "buffer_id int")


@query("op01_partition_by_key", "SELECT CAST(l_orderkey % 8 AS INT) AS pid, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def op01(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    return line.groupBy(partition_id(F.col("l_orderkey"), 8).alias("pid")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


@query("op02_partition_id_pass_through", "SELECT CAST(o_custkey % 8 AS INT) AS pid, count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM orders GROUP BY 1")
def op02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that carry their partition id are dealt by it, without hashing it again."""
    dealt = read_table(spark, sf_dir, "orders").select(partition_id(F.col("o_custkey"), 8).alias("pid")).repartitionById(8, "pid")
    placed = dealt.select("pid", F.spark_partition_id().alias("at"))
    return placed.groupBy("pid").agg(F.count("*").alias("n"), F.sum((F.col("at") != F.col("pid")).cast("long")).alias("misplaced"))


@query("op03_partition_check", "SELECT CASE WHEN l_linenumber BETWEEN 0 AND 4 THEN 'legal' ELSE 'Illegal partition' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1")
def op03(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(legal_partition(F.col("l_linenumber"), 5), "legal").otherwise("Illegal partition").alias("verdict")
    return read_table(spark, sf_dir, "lineitem").groupBy(verdict).agg(F.count("*").alias("n"))


@query("op04_broadcast_partition", "SELECT n_nationkey, n_name, CAST(p.range AS INT) AS pid FROM nation, range(4) p")
def op04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_all_partitions(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 4)


@query("op05_emit_to_subpartition", "SELECT CAST(user_id % 6 AS INT) AS target, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def op05(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(partition_id(F.col("user_id"), 6).alias("target"), "event_type")
    return events.repartition("target").groupBy("target", "event_type").agg(F.count("*").alias("n"))


@query("op06_one_to_one_edge", "SELECT o_orderkey, o_custkey * 2 AS doubled FROM orders")
def op06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer i feeds consumer i: a narrow dependency, so no exchange."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("doubled"))


@query("op07_round_robin", "SELECT c_custkey, c_mktsegment FROM customer")
def op07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(8)


@query("op09_partition_range_read", "SELECT pid, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM batches WHERE pid >= 2 AND pid < 5 GROUP BY 1")
def op09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).where("pid >= 2 and pid < 5").groupBy("pid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    "op010_hash_writer_buffers",
    """WITH RECURSIVE r AS (SELECT map_id, pid, size, row_number() OVER (PARTITION BY map_id, pid ORDER BY attempt_id, seq) AS i FROM records),
    f AS (SELECT map_id, pid, i, size, size > 4000 AS giant, CASE WHEN size > 4000 THEN NULL ELSE 0 END AS flush_id, 0 AS flush, CASE WHEN size > 4000 THEN 0 ELSE size END AS used FROM r WHERE i = 1
      UNION ALL SELECT r.map_id, r.pid, r.i, r.size, r.size > 4000, CASE WHEN r.size > 4000 THEN NULL WHEN f.used + r.size > 4000 THEN f.flush + 1 ELSE f.flush END,
        CASE WHEN r.size <= 4000 AND f.used + r.size > 4000 THEN f.flush + 1 ELSE f.flush END,
        CASE WHEN r.size > 4000 THEN f.used WHEN f.used + r.size > 4000 THEN r.size ELSE f.used + r.size END
      FROM f JOIN r ON r.map_id = f.map_id AND r.pid = f.pid AND r.i = f.i + 1)
    SELECT map_id, pid, flush_id, giant, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2, 3, 4""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flushes(records(spark, sf_dir), ["map_id", "pid"], ["attempt_id", "seq"], "size", 4000)
    return out.groupBy("map_id", "pid", "flush_id", "giant").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("op11_giant_records", "SELECT map_id, pid, key, size FROM records WHERE size > 4800")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("size > 4800").select("map_id", "pid", "key", "size")


@query("op12_sort_writer", "SELECT map_id, pid, key, CAST(row_number() OVER (PARTITION BY map_id ORDER BY pid, attempt_id, seq) AS INT) AS place FROM records")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a map task in the order a sort writer emits them: partition by partition, arrivals in order."""
    place = F.row_number().over(Window.partitionBy("map_id").orderBy("pid", "attempt_id", "seq")).alias("place")
    return records(spark, sf_dir).select("map_id", "pid", "key", place)


@query("op13_partition_id_limit", "SELECT p AS pid, p BETWEEN 0 AND 16777215 AS fits FROM (SELECT o_orderkey * 5000 - 100 AS p FROM orders)")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 5000 - 100).alias("pid")).withColumn("fits", F.col("pid").between(0, MAX_PARTITION_ID))


@query("op14_write_mode", "SELECT CASE WHEN p_size * 100 > 2000 THEN 'SORT' ELSE 'HASH' END AS mode, count(*) AS n FROM part GROUP BY 1")
def op14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").groupBy(write_mode(F.col("p_size") * 100).alias("mode")).agg(F.count("*").alias("n"))


@query("op16_map_side_combine", "SELECT map_id, key, CAST(sum(size) AS BIGINT) AS total, count(*) AS n FROM records GROUP BY 1, 2")
def op16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_side_combined(records(spark, sf_dir), ["map_id", "key"], "size")


@query("op17_sorted_runs", "SELECT pid, key, size, CAST(row_number() OVER (PARTITION BY pid ORDER BY key, size) AS INT) AS place FROM records")
def op17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window needs what sorted_runs leaves behind, so there is one exchange and one sort."""
    runs = sorted_runs(records(spark, sf_dir).select("pid", "key", "size"), "pid", ["key", "size"], key_counts(spark, sf_dir)[1])
    return runs.select("pid", "key", "size", F.row_number().over(Window.partitionBy("pid").orderBy("key", "size")).alias("place"))


@query("op18_partition_counters", "SELECT pid, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT key) AS n_keys FROM records GROUP BY 1")
def op18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.countDistinct("key").alias("n_keys"))


@query("op19_unordered_writer", "SELECT CAST(o_custkey % 8 AS INT) AS pid, o_orderkey FROM orders")
def op19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(partition_id(F.col("o_custkey"), 8).alias("pid"), "o_orderkey").repartition(8, "pid")


@query("op20_ordered_output", f"SELECT CAST(o_custkey % {PARTITIONS_SQL} AS INT) AS pid, o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey % {PARTITIONS_SQL} ORDER BY o_custkey, o_orderkey) AS INT) AS place FROM orders")
def op20(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = key_counts(spark, sf_dir)[1]
    runs = sorted_runs(read_table(spark, sf_dir, "orders").select(partition_id(F.col("o_custkey"), n).alias("pid"), "o_custkey", "o_orderkey"), "pid", ["o_custkey", "o_orderkey"], n)
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("o_custkey", "o_orderkey")))


@query("op21_sort_buffer", f"SELECT map_id, pid, seq, CAST(row_number() OVER (PARTITION BY map_id ORDER BY (pid + map_id) % {PARTITIONS_SQL}, attempt_id, seq) AS INT) AS place FROM records")
def op21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read order rotates over the subpartitions, starting at another one in each map task."""
    order = Window.partitionBy("map_id").orderBy(pmod(F.col("pid") + F.col("map_id"), key_counts(spark, sf_dir)[1]), "attempt_id", "seq")
    return records(spark, sf_dir).select("map_id", "pid", "seq", F.row_number().over(order).alias("place"))


@query(
    "op22_buffer_packing",
    """WITH RECURSIVE r AS (SELECT map_id, pid, size, row_number() OVER (PARTITION BY map_id ORDER BY pid, attempt_id, batch_id) AS i FROM batches),
    f AS (SELECT map_id, pid, i, size, 0 AS buffer_id, size AS used FROM r WHERE i = 1
      UNION ALL SELECT r.map_id, r.pid, r.i, r.size, CASE WHEN r.pid <> f.pid OR f.used + r.size - 16 > 60000 THEN f.buffer_id + 1 ELSE f.buffer_id END, CASE WHEN r.pid <> f.pid OR f.used + r.size - 16 > 60000 THEN r.size ELSE f.used + r.size - 16 END
      FROM f JOIN r ON r.map_id = f.map_id AND r.i = f.i + 1)
    SELECT map_id, pid, buffer_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2, 3""",
)
def op22(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(batches(spark, sf_dir), ["map_id"], ["pid", "attempt_id", "batch_id"], "pid", "size", 60000, 16)
    return out.groupBy("map_id", "pid", "buffer_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("op23_map_output_sizes", "SELECT map_id, pid, CAST(sum(size) AS BIGINT) AS size FROM records GROUP BY 1, 2")
def op23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each partition that a map task wrote to; partitions without bytes are left out, as there may be very many."""
    return records(spark, sf_dir).groupBy("map_id", "pid").agg(F.sum("size").alias("size"))
