"""The read-only views of the control plane, each a SELECT over the control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources.tables import consumption, disks, locations, pmod, push_events, read_table, workers


@query("api01_workers", "SELECT w.worker, rack, load, CAST(sum(slots) AS BIGINT) AS slots, CAST(count(*) FILTER (usable) AS BIGINT) AS usable_disks FROM workers w JOIN disks d ON w.worker = d.worker GROUP BY 1, 2, 3")
def worker_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers with the slots of their disks."""
    summed = disks(spark, sf_dir).groupBy("worker").agg(F.sum("slots").alias("slots"), F.count_if("usable").alias("usable_disks"))
    return workers(spark, sf_dir).join(summed, "worker").select("worker", "rack", "load", "slots", "usable_disks")


@query("api02_topology", "SELECT rack, count(*) AS n, array_to_string(list_sort(list(worker)), ',') AS members FROM workers GROUP BY 1")
def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = workers(spark, sf_dir).groupBy("rack").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("worker")).alias("members"))
    return grouped.select("rack", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("api03_applications", "SELECT o_custkey AS app, count(*) AS heartbeats, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1")
def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("app")).agg(F.count("*").alias("heartbeats"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


@query("api04_shuffles", "SELECT pid AS shuffle, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(epoch) AS last_epoch, count(DISTINCT worker) AS n_workers FROM locations GROUP BY 1")
def shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations(spark, sf_dir).groupBy(F.col("pid").alias("shuffle")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("epoch").alias("last_epoch"), F.countDistinct("worker").alias("n_workers"))


@query("api05_users_over_quota", "SELECT tenant, user, CAST(sum(disk_bytes) AS BIGINT) AS disk_bytes, sum(disk_bytes) >= 60000000 AS over FROM consumption GROUP BY 1, 2")
def users_over_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption(spark, sf_dir).groupBy("tenant", "user").agg(F.sum("disk_bytes").alias("disk_bytes")).withColumn("over", F.col("disk_bytes") >= 60_000_000)


@query("api06_worker_events", "SELECT user_id % 40 AS worker, kind, count(*) AS n, max(hour) AS last_hour FROM push_events GROUP BY 1, 2")
def worker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return push_events(spark, sf_dir).groupBy(pmod("user_id", 40).alias("worker"), "kind").agg(F.count("*").alias("n"), F.max("hour").alias("last_hour"))
