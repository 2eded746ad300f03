"""The read side: exactly-once batches, map ranges, chunk boundaries, skew splits, merged inputs and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.folds import fold_sorted
from millrace.operators.commit import WINNERS_SQL, read_once, winners
from millrace.plans.registry import query
from millrace.sources.tables import batches, key_counts, locations, mapper_ends, pmod, read_table, records, sent_batches


def in_map_range(map_id: Column, start: int, end: int | None) -> Column:
    """start <= map_id < end; no end means all."""
    return (map_id >= start) & (F.lit(True) if end is None else map_id < end)


def may_hold(map_ids: Column, start: int, end: int) -> Column:
    """Whether a location may hold map tasks of [start, end); one without a bitmap is never skipped."""
    return map_ids.isNull() | F.exists(map_ids, lambda m: (m >= start) & (m < end))


def chunk_flags(df: DataFrame, keys: list[str], order: list[str], size: str, chunk: int, rule: str) -> DataFrame:
    """df with chunk_id and offset, by one of three boundary rules.

    writer: a chunk ends with the write that brings it to `chunk` bytes; disk: a block starts a chunk if the last boundary is
    `chunk` bytes or more before it; memory: if more than `chunk` bytes.
    """

    def step(state, row):
        n, offset, last = state
        if rule == "writer":
            after = offset + row[size]
            following = (n + 1, after, after) if after - last >= chunk else (n, after, last)
            return following, (n, offset)
        gap = offset - last
        if gap >= chunk if rule == "disk" else gap > chunk:
            n, last = n + 1, offset
        return (n, offset + row[size], last), (n, offset)

    return fold_sorted(df, keys, order, lambda: (0, 0, 0), step, "chunk_id int, offset long")


def compacted(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """df with group_id: neighbouring blocks are joined while their bytes stay within the limit."""

    def step(state, row):
        group, used = state
        group, used = (group, used + row[size]) if used is not None and used + row[size] <= limit else (group + 1, row[size])
        return (group, used), (group,)

    return fold_sorted(df, keys, order, lambda: (-1, None), step, "group_id int")


def skew_split(chunks: DataFrame, keys: list[str], order: list[str], size: str, subs: int) -> DataFrame:
    """chunks with sub: the sub-reader of each, by the end of the chunk in the partition's bytes.

    With step = total // subs, sub i takes ends in (step * i, step * (i + 1)] and the last one the rest; a leading chunk of no
    bytes goes to none.
    """
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = chunks.withColumns({"end_at": F.sum(size).over(running), "step": F.floor(F.sum(size).over(whole) / subs)})
    sub = F.when(F.col("step") == 0, F.lit(subs - 1)).otherwise(F.least(F.lit(subs - 1), F.ceil(F.col("end_at") / F.col("step")) - 1))
    return sized.withColumn("sub", F.when(F.col("end_at") > 0, sub.cast("int"))).drop("step")


def is_skew_read(enabled: bool, start: Column, end: Column) -> Column:
    """A skew-split read names the number of sub-readers as start and its own index as end."""
    return F.lit(enabled) & (start > end)


@query("op51_exactly_once", f"SELECT s.pid, s.map_id, s.attempt_id, s.batch_id, s.size FROM (SELECT DISTINCT pid, map_id, attempt_id, batch_id, size FROM sent_batches) s JOIN {WINNERS_SQL} w ON s.map_id = w.map_id AND s.attempt_id = w.attempt_id WHERE (s.batch_id + s.map_id) % 11 <> 4")
def op51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losing attempts, failed batches and repeats are dropped, in that order."""
    sent = sent_batches(spark, sf_dir)
    failed = sent.where(pmod(F.col("batch_id") + F.col("map_id"), 11) == 4)
    won = winners(mapper_ends(spark, sf_dir), ["map_id"], "end_ts", "end_seq")
    return read_once(sent, won, failed).select("pid", "map_id", "attempt_id", "batch_id", "size")


@query("op52_map_range_read", "SELECT pid, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM batches WHERE map_id >= 4 AND map_id < 9 GROUP BY 1")
def op52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).where(in_map_range(F.col("map_id"), 4, 9)).groupBy("pid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("op53_location_bitmaps", "SELECT unique_id, len(map_ids) AS maps FROM locations WHERE epoch % 5 = 0 OR len(list_filter(map_ids, lambda m: m >= 14 AND m < 16)) > 0")
def op53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations without a bitmap (every fifth epoch) are read whatever the range."""
    bitmap = F.when(pmod("epoch", 5) != 0, F.col("map_ids"))
    return locations(spark, sf_dir).where(may_hold(bitmap, 14, 16)).select("unique_id", F.size("map_ids").cast("long").alias("maps"))


@query("op54_sort_by_map", "SELECT pid, map_id, attempt_id, batch_id, size, CAST(coalesce(sum(size) OVER (PARTITION BY pid ORDER BY map_id, attempt_id, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM batches")
def op54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in map order with their offsets in the sorted file."""
    before = Window.partitionBy("pid").orderBy("map_id", "attempt_id", "batch_id").rowsBetween(Window.unboundedPreceding, -1)
    return batches(spark, sf_dir).select("pid", "map_id", "attempt_id", "batch_id", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("new_offset"))


@query(
    "op54b_block_compaction",
    """WITH RECURSIVE r AS (SELECT pid, map_id, size, row_number() OVER (PARTITION BY pid, map_id ORDER BY attempt_id, batch_id) AS i FROM batches),
    f AS (SELECT pid, map_id, i, size, 0 AS group_id, size AS used FROM r WHERE i = 1
      UNION ALL SELECT r.pid, r.map_id, r.i, r.size, CASE WHEN f.used + r.size <= 80000 THEN f.group_id ELSE f.group_id + 1 END, CASE WHEN f.used + r.size <= 80000 THEN f.used + r.size ELSE r.size END FROM f JOIN r ON r.pid = f.pid AND r.map_id = f.map_id AND r.i = f.i + 1)
    SELECT pid, map_id, group_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2, 3""",
)
def op54b(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compacted(batches(spark, sf_dir), ["pid", "map_id"], ["attempt_id", "batch_id"], "size", 80_000)
    return out.groupBy("pid", "map_id", "group_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def chunk_sql(rule: str) -> str:
    over = {"writer": "", "disk": "f.off + f.size - f.last >= 100000", "memory": "f.off + f.size - f.last > 100000"}[rule]
    test = "f.off + f.size - f.last >= 100000" if rule == "writer" else over
    return f"""WITH RECURSIVE r AS (SELECT pid, size, row_number() OVER (PARTITION BY pid ORDER BY map_id, attempt_id, batch_id) AS i FROM batches),
    f AS (SELECT pid, i, size, 0 AS chunk_id, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS last FROM r WHERE i = 1
      UNION ALL SELECT r.pid, r.i, r.size, CASE WHEN {test} THEN f.chunk_id + 1 ELSE f.chunk_id END, f.off + f.size, CASE WHEN {test} THEN f.off + f.size ELSE f.last END FROM f JOIN r ON r.pid = f.pid AND r.i = f.i + 1)
    SELECT pid, chunk_id, min(off) AS begins, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2"""


def chunk_query(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    out = chunk_flags(batches(spark, sf_dir), ["pid"], ["map_id", "attempt_id", "batch_id"], "size", 100_000, rule)
    return out.groupBy("pid", "chunk_id").agg(F.min("offset").alias("begins"), F.sum("size").alias("bytes"))


@query("op55_writer_chunks", chunk_sql("writer"))
def op55(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_query(spark, sf_dir, "writer")


@query("op56_disk_chunks", chunk_sql("disk"))
def op56(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_query(spark, sf_dir, "disk")


@query("op57_memory_chunks", chunk_sql("memory"))
def op57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_query(spark, sf_dir, "memory")


@query(
    "op58_skew_split",
    """SELECT pid, sub, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(unique_id) AS first_id, max(unique_id) AS last_id FROM (
      SELECT pid, unique_id, size, CAST(least(2, CAST(ceil(e / s) AS BIGINT) - 1) AS INT) AS sub FROM (
        SELECT pid, unique_id, size, CAST(sum(size) OVER (PARTITION BY pid ORDER BY unique_id) AS DOUBLE) AS e, CAST(sum(size) OVER (PARTITION BY pid) AS BIGINT) // 3 AS s FROM locations)) GROUP BY 1, 2""",
)
def op58(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = skew_split(locations(spark, sf_dir), ["pid"], ["unique_id"], "size", 3)
    return out.groupBy("pid", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("unique_id").alias("first_id"), F.max("unique_id").alias("last_id"))


@query("op59_skew_mode", "SELECT o_custkey % 7 > o_orderkey % 5 AS skew, count(*) AS n FROM orders GROUP BY 1")
def op59(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy(is_skew_read(True, pmod("o_custkey", 7), pmod("o_orderkey", 5)).alias("skew")).agg(F.count("*").alias("n"))


@query("op61_replica_preference", "SELECT unique_id, attempt, CASE WHEN attempt % 2 = 1 AND epoch % 3 <> 0 THEN 'REPLICA' ELSE 'PRIMARY' END AS read_from FROM locations, (VALUES (0), (1), (2)) a(attempt)")
def op61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd attempts read the replica, where there is one (not in every third epoch)."""
    tries = locations(spark, sf_dir).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return tries.select("unique_id", "attempt", F.when((pmod("attempt", 2) == 1) & (pmod("epoch", 3) != 0), "REPLICA").otherwise("PRIMARY").alias("read_from"))


@query("op62_read_side_combine", "SELECT key, CAST(sum(t) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n FROM (SELECT map_id, key, sum(size) AS t, count(*) AS n FROM records GROUP BY 1, 2) GROUP BY 1")
def op62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combiners of the map side are merged: sums of sums."""
    combined = records(spark, sf_dir).groupBy("map_id", "key").agg(F.sum("size").alias("t"), F.count("*").alias("c"))
    return combined.groupBy("key").agg(F.sum("t").alias("total"), F.sum("c").alias("n"))


@query("op63_read_side_sort", "SELECT pid, key, CAST(sum(size) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY pid ORDER BY key) AS INT) AS place FROM records GROUP BY 1, 2")
def op63(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = records(spark, sf_dir).groupBy("pid", "key").agg(F.sum("size").alias("total"))
    return combined.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("key")))


@query("op64_plain_read", "SELECT map_id, pid, key, size FROM records")
def op64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions, as they are."""
    return records(spark, sf_dir).select("map_id", "pid", "key", "size")


@query("op65_open_streams", "SELECT worker, count(*) AS n, array_to_string(list_sort(list(unique_id)), ',') AS ids FROM locations GROUP BY 1")
def op65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a worker, naming all its locations."""
    grouped = locations(spark, sf_dir).groupBy("worker").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("unique_id")), ",").alias("ids"))
    return grouped


@query("op67_merged_runs", "SELECT pid, key, map_id, size, CAST(row_number() OVER (PARTITION BY pid ORDER BY key, map_id, attempt_id, seq) AS INT) AS place FROM records")
def op67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of all map tasks' sorted runs of a partition."""
    order = Window.partitionBy("pid").orderBy("key", "map_id", "attempt_id", "seq")
    return records(spark, sf_dir).select("pid", "key", "map_id", "size", F.row_number().over(order).alias("place"))


@query("op68_ordered_grouped", "SELECT pid, key, array_to_string(list_sort(list(size)), ',') AS sizes FROM records GROUP BY 1, 2")
def op68(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values grouped by key over all attempts' inputs, whatever their size."""
    grouped = records(spark, sf_dir).groupBy("pid", "key").agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    return grouped.select("pid", "key", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


@query("op69_concatenated_inputs", "SELECT c_custkey AS k, 'customer' AS side FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part")
def op69(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [read_table(spark, sf_dir, t).select(F.col(k).alias("k"), F.lit(t).alias("side")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


@query("op70_unordered_input", "SELECT pid, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM records GROUP BY 1")
def op70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


REGIONS_SQL = "(SELECT map_id, batch_id AS region, pid AS subpartition, CAST(sum(size) AS BIGINT) AS size FROM batches WHERE attempt_id = 0 GROUP BY 1, 2, 3)"


def region_index(rows: DataFrame) -> DataFrame:
    """Index of a map task's file: offset of each (region, subpartition); a region starts where the one before it ends."""
    order = Window.partitionBy("map_id").orderBy("region", "subpartition").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0)))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).where("attempt_id = 0").groupBy("map_id", F.col("batch_id").alias("region"), F.col("pid").alias("subpartition")).agg(F.sum("size").alias("size"))


@query("op71_region_read", f"SELECT * FROM (SELECT map_id, region, subpartition, size, CAST(coalesce(sum(size) OVER (PARTITION BY map_id ORDER BY region, subpartition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM {REGIONS_SQL}) WHERE subpartition BETWEEN 2 AND 4 AND size > 0")
def op71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inclusive subpartition range, region by region, empty entries skipped."""
    return region_index(regions(spark, sf_dir)).where("subpartition between 2 and 4 and size > 0").select("map_id", "region", "subpartition", "size", "offset")


@query("op72_segment_read", f"SELECT r.map_id, r.region AS segment, r.subpartition FROM {REGIONS_SQL} r WHERE r.region = (r.subpartition * 3) % 5")
def op72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a queue is sent only if it is the segment that its subpartition requires."""
    required = spark.range(key_counts(spark, sf_dir)[1]).select(F.col("id").cast("int").alias("subpartition"), pmod(F.col("id") * 3, 5).cast("int").alias("segment"))
    return regions(spark, sf_dir).withColumnRenamed("region", "segment").join(F.broadcast(required), ["subpartition", "segment"]).select("map_id", "segment", "subpartition")


@query("op73_input_gate", "SELECT pid AS channel, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM batches GROUP BY 1")
def op73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partition streams read as one."""
    return batches(spark, sf_dir).groupBy(F.col("pid").alias("channel")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("op90_read_metrics", f"SELECT s.pid, count(*) AS seen, count(DISTINCT (s.map_id, s.batch_id)) AS kept, CAST(sum(s.size) AS BIGINT) AS bytes_read, CAST(sum(s.size * s.copy) AS BIGINT) AS bytes_repeated FROM sent_batches s JOIN {WINNERS_SQL} w ON s.map_id = w.map_id AND s.attempt_id = w.attempt_id GROUP BY 1")
def op90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes read and bytes of repeats, for each partition."""
    won = winners(mapper_ends(spark, sf_dir), ["map_id"], "end_ts", "end_seq")
    seen = sent_batches(spark, sf_dir).join(won, ["map_id", "attempt_id"], "left_semi")
    once = seen.groupBy("pid", "map_id", "batch_id").agg(F.count("*").alias("c"), F.sum("size").alias("s"), F.min("size").alias("one"))
    return once.groupBy("pid").agg(F.sum("c").alias("seen"), F.count("*").alias("kept"), F.sum("s").alias("bytes_read"), F.sum(F.col("s") - F.col("one")).alias("bytes_repeated"))
