"""Integrity: what was written against what readers saw, and whether the ranges they read complete a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.checksum import combined_crc, crc_of
from millrace.plans.registry import query
from millrace.sources.tables import batches, pmod, read_table, records, sent_batches


def commit_metadata(df: DataFrame, keys: list[str], size: str, crc: str) -> DataFrame:
    """Bytes and commutative checksum of each key: one partial aggregate, whatever order the batches come in."""
    return df.groupBy(*keys).agg(F.sum(size).alias("bytes"), combined_crc(F.col(crc)).alias("crc"))


def compared(written: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """For each key, whether readers saw what was written; a side without the key does not match."""
    w, s = (side.select(key, F.struct("bytes", "crc").alias(name)) for side, name in ((written, "w"), (seen, "s")))
    return w.join(s, key, "full_outer").select(key, F.col("w").eqNullSafe(F.col("s")).alias("matches"))


def range_verdicts(ranges: DataFrame, keys: list[str], mappers: int) -> DataFrame:
    """Validation of map ranges [start, finish) with (bytes, crc): overlap, mismatch, waiting or complete.

    A range that is repeated must repeat its metadata; different ranges must not overlap; ranges that cover all map tasks
    complete the partition.
    """
    each = ranges.groupBy(*keys, "start", "finish").agg(F.countDistinct("bytes", "crc").alias("kinds"), F.min("bytes").alias("bytes"))
    order = Window.partitionBy(*keys).orderBy("start", "finish")
    marked = each.withColumn("cut", F.coalesce(F.lead("start").over(order) < F.col("finish"), F.lit(False)))
    summed = marked.groupBy(*keys).agg(F.bool_or("cut").alias("overlap"), F.max("kinds").alias("kinds"), F.sum(F.col("finish") - F.col("start")).alias("covered"))
    verdict = F.when(F.col("overlap"), "overlap").when(F.col("kinds") > 1, "mismatch").when(F.col("covered") == mappers, "complete").otherwise("waiting for more data")
    return summed.select(*keys, "covered", verdict.alias("verdict"))


def sub_verdicts(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Validation of skew-split reads (sub, subs, bytes, crc): every sub-index seen, each always with the same metadata."""
    each = reads.groupBy(*keys, "sub").agg(F.countDistinct("bytes", "crc").alias("kinds"), F.max("subs").alias("subs"))
    summed = each.groupBy(*keys).agg(F.max("kinds").alias("kinds"), F.count("*").alias("seen"), F.max("subs").alias("subs"))
    verdict = F.when(F.col("kinds") > 1, "mismatch").when(F.col("seen") == F.col("subs"), "complete").otherwise("waiting for more data")
    return summed.select(*keys, "seen", verdict.alias("verdict"))


LANES = "(" + " + ".join(f"(CAST(sum((x >> {8 * i}) & 255) AS BIGINT) % 256) * {1 << 8 * i}" for i in range(4)) + ")"


@query("op82_commutative_checksum", f"SELECT pid, CAST({LANES} AS BIGINT) AS combined FROM (SELECT pid, (key * 2654435761 + size) % 4294967296 AS x FROM records) GROUP BY 1")
def op82(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = records(spark, sf_dir).select("pid", pmod(F.col("key") * 2654435761 + F.col("size"), 4294967296).alias("x"))
    return values.groupBy("pid").agg(combined_crc(F.col("x")).alias("combined"))


@query("op82b_crc_of_names")
def op82b(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    return nation.groupBy("n_regionkey").agg(combined_crc(crc_of(F.col("n_name"))).alias("crc"), F.sum(F.octet_length("n_name")).alias("bytes"))


@query(
    "op83_commit_metadata",
    "SELECT pid, pid % 3 <> 1 OR bool_and(batch_id % 9 <> 8) AS matches FROM batches GROUP BY 1",
)
def op83(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third partition's readers missed each ninth batch, if there is one."""
    rows = batches(spark, sf_dir).withColumn("x", pmod(F.col("size") * 2654435761 + F.col("batch_id"), 4294967296))
    seen = rows.where((pmod("pid", 3) != 1) | (pmod("batch_id", 9) != 8))
    return compared(commit_metadata(rows, ["pid"], "size", "x"), commit_metadata(seen, ["pid"], "size", "x"), "pid")


RANGES_SQL = "(SELECT pid, CAST(r.range * 4 AS INT) AS start, CAST(r.range * 4 + CASE WHEN pid = 2 AND r.range = 1 THEN 6 ELSE 4 END AS INT) AS finish, CAST(pid * 100 + CASE WHEN pid = 5 THEN copy ELSE 0 END AS BIGINT) AS bytes, CAST(pid AS BIGINT) AS crc FROM (SELECT DISTINCT pid FROM batches), range(4) r, (VALUES (0), (1)) c(copy) WHERE NOT (pid = 3 AND r.range = 2))"


def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranges a partition, each read twice: partition 2 overlaps, 3 misses one, 5's second read differs."""
    parts = batches(spark, sf_dir).select("pid").distinct()
    spread = parts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1)))).where("not (pid = 3 and r = 2)")
    finish = F.col("r") * 4 + F.when((F.col("pid") == 2) & (F.col("r") == 1), 6).otherwise(4)
    return spread.select("pid", (F.col("r") * 4).alias("start"), finish.alias("finish"), (F.col("pid") * 100 + F.when(F.col("pid") == 5, F.col("copy")).otherwise(0)).cast("long").alias("bytes"), F.col("pid").cast("long").alias("crc"))


@query(
    "op84_range_completeness",
    f"""WITH e AS (SELECT pid, start, finish, count(DISTINCT (bytes, crc)) AS kinds FROM {RANGES_SQL} GROUP BY 1, 2, 3), m AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY pid ORDER BY start, finish) < finish, false) AS cut FROM e)
    SELECT pid, CAST(sum(finish - start) AS BIGINT) AS covered, CASE WHEN bool_or(cut) THEN 'overlap' WHEN max(kinds) > 1 THEN 'mismatch' WHEN sum(finish - start) = 16 THEN 'complete' ELSE 'waiting for more data' END AS verdict FROM m GROUP BY 1""",
)
def op84(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_verdicts(read_ranges(spark, sf_dir), ["pid"], 16)


SUBS_SQL = "(SELECT pid, CAST(map_id % 4 AS INT) AS sub, CASE WHEN pid = 6 THEN 5 ELSE 4 END AS subs, CASE WHEN pid = 1 THEN size ELSE 0 END AS bytes, CAST(pid AS BIGINT) AS crc FROM batches)"


def sub_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(spark, sf_dir)
    return rows.select("pid", pmod("map_id", 4).cast("int").alias("sub"), F.when(F.col("pid") == 6, 5).otherwise(4).alias("subs"), F.when(F.col("pid") == 1, F.col("size")).otherwise(0).cast("long").alias("bytes"), F.col("pid").cast("long").alias("crc"))


@query(
    "op85_sub_partition_completeness",
    f"SELECT pid, count(*) AS seen, CASE WHEN max(kinds) > 1 THEN 'mismatch' WHEN count(*) = max(subs) THEN 'complete' ELSE 'waiting for more data' END AS verdict FROM (SELECT pid, sub, count(DISTINCT (bytes, crc)) AS kinds, max(subs) AS subs FROM {SUBS_SQL} GROUP BY 1, 2) GROUP BY 1",
)
def op85(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub_verdicts(sub_reads(spark, sf_dir), ["pid"])


@query(
    "op86_validator_dispatch",
    f"""WITH e AS (SELECT pid, start, finish, count(DISTINCT (bytes, crc)) AS kinds FROM {RANGES_SQL} GROUP BY 1, 2, 3), m AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY pid ORDER BY start, finish) < finish, false) AS cut FROM e),
    a AS (SELECT pid, 'ranges' AS mode, CASE WHEN bool_or(cut) THEN 'overlap' WHEN max(kinds) > 1 THEN 'mismatch' WHEN sum(finish - start) = 16 THEN 'complete' ELSE 'waiting for more data' END AS verdict FROM m GROUP BY 1),
    b AS (SELECT pid, 'subs' AS mode, CASE WHEN max(kinds) > 1 THEN 'mismatch' WHEN count(*) = max(subs) THEN 'complete' ELSE 'waiting for more data' END AS verdict FROM (SELECT pid, sub, count(DISTINCT (bytes, crc)) AS kinds, max(subs) AS subs FROM {SUBS_SQL} GROUP BY 1, 2) GROUP BY 1)
    SELECT * FROM a WHERE pid % 2 = 0 UNION ALL SELECT * FROM b WHERE pid % 2 = 1""",
)
def op86(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd partitions are read in skew-split mode, even ones by map range."""
    ranges = range_verdicts(read_ranges(spark, sf_dir).where("pid % 2 = 0"), ["pid"], 16).select("pid", F.lit("ranges").alias("mode"), "verdict")
    return ranges.unionByName(sub_verdicts(sub_reads(spark, sf_dir).where("pid % 2 = 1"), ["pid"]).select("pid", F.lit("subs").alias("mode"), "verdict"))


@query("op87_stream_integrity", f"SELECT pid, map_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST({LANES} AS BIGINT) AS crc FROM (SELECT *, (size * 31 + batch_id) % 4294967296 AS x FROM batches) GROUP BY 1, 2")
def op87(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and checksum of each stream of one map task's subpartition, reported once at its end."""
    rows = batches(spark, sf_dir).withColumn("x", pmod(F.col("size") * 31 + F.col("batch_id"), 4294967296))
    return rows.groupBy("pid", "map_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), combined_crc(F.col("x")).alias("crc"))


@query("op89_encrypted_round_trip", "SELECT n_nationkey, n_name AS plain FROM nation")
def op89(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values encrypted and decrypted again are unchanged."""
    key = F.lit("0123456789abcdef")
    sealed = read_table(spark, sf_dir, "nation").select("n_nationkey", F.aes_encrypt("n_name", key).alias("sealed"))
    return sealed.select("n_nationkey", F.aes_decrypt("sealed", key).cast("string").alias("plain"))
