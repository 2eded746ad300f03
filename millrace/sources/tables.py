"""Tables: reading the star schema, and the exchange model derived from it with integer arithmetic.

Each model function returns a DataFrame; MODEL_SQL states the same relation in ANSI SQL, so a query's SQL can be written
over the model's names.  Orderings name every column that could break a tie, as (l_orderkey, l_linenumber) is not unique.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BATCH_RECORDS = 10
#: Map tasks and partitions of the model grow with the records, so that no map task and no partition does.
LEAST_MAPS, ROWS_A_MAP = 16, 500_000
LEAST_PARTITIONS, ROWS_A_PARTITION = 8, 1_000_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """CSV with a given schema: inference would read the input twice."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table over JDBC, read in `parts` ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def key_counts(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Map tasks and partitions for the rows of lineitem."""
    return counts_for(read_table(spark, sf_dir, "lineitem"))


def counts_for(line: DataFrame) -> tuple[int, int]:
    """key_counts of a table that is read already; Parquet footers answer the count."""
    n = line.count()
    return max(LEAST_MAPS, -(-n // ROWS_A_MAP)), max(LEAST_PARTITIONS, -(-n // ROWS_A_PARTITION))


def work_folder(spark: SparkSession) -> str:
    """A new folder for checkpoints and results, in the one that spark.checkpoint.dir names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "millrace-work")
    return f"{base}/work-{uuid.uuid4().hex}"


def pmod(column: Column | str, n: int) -> Column:
    return F.pmod(F.col(column) if isinstance(column, str) else column, F.lit(n))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle records: map_id, attempt_id, pid, key, seq (order of arrival within the three) and size."""
    line = read_table(spark, sf_dir, "lineitem")
    maps, partitions = counts_for(line)
    arrival = Window.partitionBy("map_id", "attempt_id", "pid").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size")
    return line.select(
        pmod("l_orderkey", maps).cast("int").alias("map_id"), pmod("l_linenumber", 2).cast("int").alias("attempt_id"), pmod("l_partkey", partitions).cast("int").alias("pid"),
        F.col("l_partkey").alias("key"), (F.col("l_quantity").cast("long") * 100).alias("size"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    ).select("map_id", "attempt_id", "pid", "key", F.row_number().over(arrival).alias("seq"), "size")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of up to BATCH_RECORDS records, each sent once: map_id, attempt_id, pid, batch_id, n, size."""
    batch = F.floor((F.col("seq") - 1) / BATCH_RECORDS).cast("int").alias("batch_id")
    return records(spark, sf_dir).groupBy("map_id", "attempt_id", "pid", batch).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def sent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batches with every fifth batch of a writer sent twice: copy is 0, or 1 for the repeat."""
    copies = F.when(pmod("batch_id", 5) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return batches(spark, sf_dir).withColumn("copy", F.explode(copies))


def mapper_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of finished attempts: map_id, attempt_id, end_ts, end_seq (breaks ties)."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(pmod("o_custkey", key_counts(spark, sf_dir)[0]).cast("int").alias("map_id"), pmod("o_orderkey", 3).cast("int").alias("attempt_id"), F.col("o_orderdate").alias("end_ts"), F.col("o_orderkey").alias("end_seq"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed pieces of partitions: pid, epoch, unique_id (pid-epoch), worker, size, map ids."""
    return (
        batches(spark, sf_dir)
        .groupBy("pid", pmod("batch_id", 12).cast("int").alias("epoch"))
        .agg(F.sum("size").alias("size"), F.array_sort(F.collect_set("map_id")).alias("map_ids"))
        .withColumn("unique_id", F.concat_ws("-", F.col("pid").cast("string"), F.col("epoch").cast("string")))
        .withColumn("worker", pmod(F.col("pid") * 7 + F.col("epoch"), 5).cast("int"))
    )


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """worker, rack, load (whole currency units of the account balance)."""
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.col("s_nationkey").alias("rack"), F.floor("s_acctbal").cast("long").alias("load"))


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disks a worker: worker, disk, flush, fetch, active, slots, usable."""
    spread = workers(spark, sf_dir).withColumn("disk", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return spread.select(
        "worker", "disk", (F.col("worker") * 7 + F.col("disk") * 3).alias("__x"), "load",
    ).select(
        "worker", "disk", pmod("__x", 50).cast("long").alias("flush"), pmod(F.col("__x") * 3 + 1, 40).cast("long").alias("fetch"),
        pmod(F.col("__x") + 5, 11).cast("long").alias("active"), (pmod("__x", 9) + 1).cast("long").alias("slots"), (pmod("__x", 13) != 0).alias("usable"),
    )


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources by tenant, user and app: disk_bytes, disk_files, hdfs_bytes, hdfs_files."""
    orders, customer, nation = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    spent = orders.groupBy(F.col("o_custkey").alias("app")).agg(F.sum(F.col("o_totalprice").cast("long")).alias("disk_bytes"), F.count("*").alias("disk_files"), F.sum(pmod("o_orderkey", 100)).cast("long").alias("hdfs_bytes"))
    owned = spent.join(customer.select("c_custkey", "c_nationkey"), spent.app == F.col("c_custkey")).join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    return owned.select(F.col("n_regionkey").alias("tenant"), F.col("c_nationkey").alias("user"), "app", "disk_bytes", "disk_files", "hdfs_bytes", pmod("disk_files", 3).cast("long").alias("hdfs_files"))


def push_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes pushed by users: event_id, user_id, hour (hours since the epoch), ts, bytes, kind."""
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long").alias("hour"), "ts", F.round(F.col("value") * 100).cast("long").alias("bytes"), F.col("event_type").alias("kind"))


#: key_counts in SQL.
MAPS_SQL = f"(SELECT greatest({LEAST_MAPS}, (count(*) + {ROWS_A_MAP - 1}) // {ROWS_A_MAP}) FROM lineitem)"
PARTITIONS_SQL = f"(SELECT greatest({LEAST_PARTITIONS}, (count(*) + {ROWS_A_PARTITION - 1}) // {ROWS_A_PARTITION}) FROM lineitem)"

#: The same relations in SQL, each over the tables and the ones before it.
MODEL_SQL = {
    "records": f"""SELECT map_id, attempt_id, pid, key, CAST(row_number() OVER (PARTITION BY map_id, attempt_id, pid ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, size) AS INT) AS seq, size
      FROM (SELECT CAST(l_orderkey % {MAPS_SQL} AS INT) AS map_id, CAST(l_linenumber % 2 AS INT) AS attempt_id, CAST(l_partkey % {PARTITIONS_SQL} AS INT) AS pid, l_partkey AS key, CAST(trunc(l_quantity) AS BIGINT) * 100 AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""",
    "batches": "SELECT map_id, attempt_id, pid, CAST((seq - 1) // 10 AS INT) AS batch_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM records GROUP BY ALL",
    "sent_batches": "SELECT batches.*, 0 AS copy FROM batches UNION ALL SELECT batches.*, 1 AS copy FROM batches WHERE batch_id % 5 = 0",
    "mapper_ends": f"SELECT CAST(o_custkey % {MAPS_SQL} AS INT) AS map_id, CAST(o_orderkey % 3 AS INT) AS attempt_id, o_orderdate AS end_ts, o_orderkey AS end_seq FROM orders",
    "locations": "SELECT pid, epoch, size, map_ids, pid || '-' || epoch AS unique_id, (pid * 7 + epoch) % 5 AS worker FROM (SELECT pid, CAST(batch_id % 12 AS INT) AS epoch, CAST(sum(size) AS BIGINT) AS size, list_sort(list(DISTINCT map_id)) AS map_ids FROM batches GROUP BY 1, 2)",
    "workers": "SELECT s_suppkey AS worker, s_nationkey AS rack, CAST(floor(s_acctbal) AS BIGINT) AS load FROM supplier",
    "disks": "SELECT worker, disk, x % 50 AS flush, (x * 3 + 1) % 40 AS fetch, (x + 5) % 11 AS active, x % 9 + 1 AS slots, x % 13 <> 0 AS usable FROM (SELECT worker, disk, worker * 7 + disk * 3 AS x FROM workers, (VALUES (0), (1)) d(disk))",
    "consumption": "SELECT n_regionkey AS tenant, c_nationkey AS user, app, disk_bytes, disk_files, hdfs_bytes, disk_files % 3 AS hdfs_files FROM (SELECT o_custkey AS app, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS disk_bytes, count(*) AS disk_files, CAST(sum(o_orderkey % 100) AS BIGINT) AS hdfs_bytes FROM orders GROUP BY 1) JOIN customer ON c_custkey = app JOIN nation ON n_nationkey = c_nationkey",
    "push_events": "SELECT event_id, user_id, epoch_us(ts) // 3600000000 AS hour, ts, CAST(round(value * 100) AS BIGINT) AS bytes, event_type AS kind FROM events",
}


def over_model(sql: str, recursive: bool = False) -> str:
    """sql with the model's relations that it uses, and those that they use, in front as common table expressions."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in MODEL_SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(body)
                if name not in used:
                    used.append(name)

    need(sql)
    head = ", ".join(f'"{n}" AS ({MODEL_SQL[n]})' for n in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH "):
        body = body[5:].lstrip()
        if body.upper().startswith("RECURSIVE "):
            recursive, body = True, body[10:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"
