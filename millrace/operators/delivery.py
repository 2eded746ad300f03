"""Around the exchange: order of partitions, requests in flight, fair queues, failures and reruns, plain encoding, metric files and configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.columnar import DICTIONARY_SQL, coded_sizes
from millrace.plans.registry import query
from millrace.sources.tables import batches, pmod, push_events, read_csv, read_json, read_table, work_folder


def randomized(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """df with place: the items of a key in an order that differs from key to key, and is the same in every run."""
    seed = F.md5(F.concat_ws("-", *(F.col(k).cast("string") for k in (*keys, item))).cast("binary"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(seed)) - 1)


@query("op08_randomized_order", "SELECT map_id, pid, CAST(row_number() OVER (PARTITION BY map_id ORDER BY md5(map_id || '-' || pid)) - 1 AS INT) AS place FROM (SELECT DISTINCT map_id, pid FROM batches)")
def op08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tasks visit partitions in different orders, so that they don't all write to one worker at a time."""
    return randomized(batches(spark, sf_dir).select("map_id", "pid").distinct(), ["map_id"], "pid")


#: Requests in flight that a map task may have in all and to one target, and the longest time to an answer.
MOST_IN_FLIGHT, MOST_TO_TARGET, LONGEST = 6, 3, 10


@query(
    "op32_in_flight_limit",
    "WITH r AS (SELECT map_id, pid % 4 AS target, size, row_number() OVER (PARTITION BY map_id ORDER BY attempt_id, pid, batch_id) AS i FROM batches), a AS (SELECT *, i + 3 + (size // 100) % 8 AS answered FROM r), c AS (SELECT map_id, target, "
    + " + ".join(f"CASE WHEN coalesce(lag(answered, {k}) OVER w, 0) > i THEN 1 ELSE 0 END" for k in range(1, LONGEST + 1)) + " AS all_open, "
    + " + ".join(f"CASE WHEN coalesce(lag(answered, {k}) OVER w, 0) > i AND lag(target, {k}) OVER w = target THEN 1 ELSE 0 END" for k in range(1, LONGEST + 1))
    + f" AS own_open FROM a WINDOW w AS (PARTITION BY map_id ORDER BY i)) SELECT map_id, all_open >= {MOST_IN_FLIGHT} OR own_open >= {MOST_TO_TARGET} AS waits, count(*) AS n, CAST(max(all_open) AS INT) AS most FROM c GROUP BY 1, 2",
)
def op32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push waits while too many requests, in all or to its target, have no answer; each is answered 3 to 10 pushes later."""
    sent = batches(spark, sf_dir).select("map_id", pmod("pid", 4).alias("target"), "size", F.row_number().over(Window.partitionBy("map_id").orderBy("attempt_id", "pid", "batch_id")).alias("i"))
    timed = sent.withColumn("answered", F.col("i") + 3 + F.pmod(F.floor(F.col("size") / 100), F.lit(8)))
    w = Window.partitionBy("map_id").orderBy("i")
    is_open = [F.coalesce(F.lag("answered", k).over(w), F.lit(0)) > F.col("i") for k in range(1, LONGEST + 1)]
    own = [o & (F.lag("target", k).over(w) == F.col("target")) for k, o in enumerate(is_open, 1)]
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    counted = timed.withColumns({"all_open": count(is_open), "own_open": count(own)})
    waits = (F.col("all_open") >= MOST_IN_FLIGHT) | (F.col("own_open") >= MOST_TO_TARGET)
    return counted.groupBy("map_id", waits.alias("waits")).agg(F.count("*").alias("n"), F.max("all_open").alias("most"))


def taken(queue: DataFrame, keys: list[str], target: str, order: list[str], room: Column) -> DataFrame:
    """The queue with taken: whether a task's target still has room when those of the target before it are served."""
    return queue.withColumn("taken", F.row_number().over(Window.partitionBy(*keys, target).orderBy(*order)) <= room)


@query("op34_push_queue_fairness", "SELECT map_id, pid, taken, count(*) AS n FROM (SELECT map_id, pid, row_number() OVER (PARTITION BY map_id, pid ORDER BY attempt_id, batch_id) <= 2 + (map_id + pid) % 5 AS taken FROM batches) GROUP BY 1, 2, 3")
def op34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose worker has room are taken in order, the others stay without holding up the queue."""
    out = taken(batches(spark, sf_dir), ["map_id"], "pid", ["attempt_id", "batch_id"], 2 + pmod(F.col("map_id") + F.col("pid"), 5))
    return out.groupBy("map_id", "pid", "taken").agg(F.count("*").alias("n"))


FAILED_SQL = "(map_id * 31 + batch_id * 17 + pid) % 41 = 0"


def failed() -> Column:
    return pmod(F.col("map_id") * 31 + F.col("batch_id") * 17 + F.col("pid"), 41) == 0


@query(
    "op46_fetch_failures",
    f"SELECT b.pid AS shuffle_id, r.reports, r.first_report, count(DISTINCT b.map_id) AS reruns FROM batches b JOIN (SELECT pid, count(*) AS reports, min(map_id * 100000 + batch_id) AS first_report FROM batches WHERE {FAILED_SQL} GROUP BY 1) r ON r.pid = b.pid GROUP BY 1, 2, 3",
)
def op46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reported shuffle is given up once, however often it is reported, and all map outputs of it are computed again."""
    rows = batches(spark, sf_dir)
    report = F.when(failed(), F.col("map_id") * 100000 + F.col("batch_id"))
    summed = rows.groupBy("pid").agg(F.count(report).alias("reports"), F.min(report).alias("first_report"), F.countDistinct("map_id").alias("reruns"))
    return summed.where("reports > 0").withColumnRenamed("pid", "shuffle_id")


@query("op47_barrier_failures", f"SELECT pid AS stage, attempt_id, bool_or({FAILED_SQL}) AS failed, CASE WHEN bool_or({FAILED_SQL}) THEN count(DISTINCT map_id) ELSE 0 END AS reruns FROM batches GROUP BY 1, 2")
def op47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failed task of a barrier stage fails its attempt, and all tasks run again."""
    summed = batches(spark, sf_dir).groupBy(F.col("pid").alias("stage"), "attempt_id").agg(F.max(failed()).alias("failed"), F.countDistinct("map_id").alias("tasks"))
    return summed.select("stage", "attempt_id", "failed", F.when(F.col("failed"), F.col("tasks")).otherwise(0).alias("reruns"))


EXCLUDED_FOR = 20


@query(
    "op60_fetch_retry",
    f"SELECT pid, excluded, CASE WHEN excluded THEN 'REPLICA' ELSE 'PRIMARY' END AS first_copy, count(*) AS n, count(*) FILTER (failed) AS swaps FROM (SELECT pid, failed, coalesce(max(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY t RANGE BETWEEN {EXCLUDED_FOR} PRECEDING AND 1 PRECEDING), 0) = 1 AS excluded FROM (SELECT pid, batch_id * 100 + map_id AS t, {FAILED_SQL} AS failed FROM batches WHERE attempt_id = 0)) GROUP BY 1, 2, 3",
)
def op60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker that failed within the last time units is passed over for its peer; a failed fetch swaps the copies."""
    fetches = batches(spark, sf_dir).where("attempt_id = 0").select("pid", (F.col("batch_id") * 100 + F.col("map_id")).alias("t"), failed().alias("failed"))
    recent = Window.partitionBy("pid").orderBy("t").rangeBetween(-EXCLUDED_FOR, -1)
    seen = fetches.withColumn("excluded", F.coalesce(F.max("failed").over(recent), F.lit(False)))
    return seen.groupBy("pid", "excluded", F.when(F.col("excluded"), "REPLICA").otherwise("PRIMARY").alias("first_copy")).agg(F.count("*").alias("n"), F.count_if("failed").alias("swaps"))


@query(
    "op76_pass_through",
    f"WITH {DICTIONARY_SQL}, s AS (SELECT pid, count(*) AS d FROM c GROUP BY 1), e AS (SELECT r.pid, count(*) AS n, max(d) AS d FROM r JOIN s ON s.pid = r.pid GROUP BY 1) SELECT pid, CASE WHEN d <= 300 AND 4 + 8 * d + 2 * n < 8 * n THEN 1 ELSE 0 END AS type_id, CASE WHEN d <= 300 AND 4 + 8 * d + 2 * n < 8 * n THEN 4 + 8 * d + 2 * n ELSE 8 * n END AS bytes FROM e",
)
def op76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are copied (type 0) where a dictionary (type 1) overflowed or takes no fewer bytes."""
    sized = coded_sizes(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"), F.max("overflow").alias("overflow"), F.max("code").alias("last"))
    coded = 4 + 8 * (F.col("last") + 1) + 2 * F.col("n")
    better = ~F.col("overflow") & (coded < 8 * F.col("n"))
    return sized.select("pid", F.when(better, 1).otherwise(0).alias("type_id"), F.when(better, coded).otherwise(8 * F.col("n")).cast("long").alias("bytes"))


METRICS = "kind string, name string, value long"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = push_events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))
    return counted.select("kind", F.explode(F.create_map(F.lit("count"), "count", F.lit("bytes"), "bytes")).alias("name", "value"))


def exposition(rows: DataFrame) -> DataFrame:
    """Lines of the text format that scrapers read: name{label} value."""
    return rows.select(F.format_string('push_%s{kind="%s"} %d', "name", "kind", "value").alias("value"))


@query("op124_metric_files", "SELECT kind, name, value, sink FROM (SELECT kind, 'count' AS name, count(*) AS value FROM push_events GROUP BY 1 UNION ALL SELECT kind, 'bytes', CAST(sum(bytes) AS BIGINT) FROM push_events GROUP BY 1), (VALUES ('csv'), ('json'), ('text')) s(sink)")
def op124(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as CSV, as JSON and as lines for scrapers, and read again."""
    folder, rows = work_folder(spark), metrics(spark, sf_dir)
    rows.write.option("header", True).csv(f"{folder}/csv")
    rows.write.json(f"{folder}/json")
    exposition(rows).write.text(f"{folder}/text")
    parsed = spark.read.text(f"{folder}/text").select(*(F.regexp_extract("value", r'^push_(\w+)\{kind="(.*)"\} (-?\d+)$', i).alias(c) for i, c in ((2, "kind"), (1, "name"), (3, "value"))))
    found = {"csv": read_csv(spark, f"{folder}/csv", METRICS), "json": read_json(spark, f"{folder}/json", METRICS), "text": parsed.withColumn("value", F.col("value").cast("long"))}
    out = None
    for sink, df in found.items():
        df = df.select("kind", "name", "value", F.lit(sink).alias("sink"))
        out = df if out is None else out.unionByName(df)
    return out


@query("op126_config_store", "SELECT n_nationkey AS tenant, 'quota.' || n_regionkey AS name, CAST(n_nationkey * 1000 AS VARCHAR) AS value FROM nation")
def op126(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of tenants, kept as lines of JSON and read as the table that op117_config_resolution resolves."""
    folder = work_folder(spark)
    settings = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant"), F.concat(F.lit("quota."), F.col("n_regionkey")).alias("name"), (F.col("n_nationkey") * 1000).cast("string").alias("value"))
    settings.write.json(f"{folder}/config")
    return read_json(spark, f"{folder}/config", "tenant int, name string, value string")
