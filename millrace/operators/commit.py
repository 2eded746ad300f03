"""Commit algebra: which attempt counts, when a stage is complete, what is lost, and which locations a partition has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.registry import query
from millrace.sources.tables import MAPS_SQL, batches, key_counts, locations, mapper_ends, pmod, read_table, sent_batches


def winners(ends: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first attempt of each map task to report its end; a partial aggregate, so no sort and no hot window."""
    return ends.groupBy(*keys).agg(F.min_by("attempt_id", F.struct(*order)).alias("attempt_id"))


def lost(primaries: DataFrame, replicas: DataFrame | None, key: str) -> DataFrame:
    """Ids whose data is lost: a failed primary without replication, an id that failed on both sides with it."""
    return primaries.select(key).distinct() if replicas is None else primaries.select(key).distinct().join(replicas.select(key).distinct(), key, "left_semi")


def committed(primaries: DataFrame, replicas: DataFrame) -> DataFrame:
    """Locations by unique_id: peers where both sides committed, the replica in the primary's place where it alone did."""
    p = primaries.select("unique_id", F.col("worker").alias("primary_worker"))
    r = replicas.select("unique_id", F.col("worker").alias("replica_worker"))
    both = p.join(r, "unique_id", "full_outer")
    return both.select("unique_id", F.coalesce("primary_worker", "replica_worker").alias("worker"), F.when(F.col("primary_worker").isNotNull(), F.col("replica_worker")).alias("peer"), F.col("primary_worker").isNull().alias("promoted"))


WINNERS_SQL = "(SELECT map_id, arg_min(attempt_id, (end_ts, end_seq)) AS attempt_id FROM mapper_ends GROUP BY map_id)"


@query("op36_first_attempt_wins", f"SELECT * FROM {WINNERS_SQL}")
def op36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(mapper_ends(spark, sf_dir), ["map_id"], "end_ts", "end_seq")


@query("op37_stage_complete", f"SELECT attempt_id AS stage, count(DISTINCT map_id) AS ended, count(DISTINCT map_id) = {MAPS_SQL} AS complete FROM mapper_ends WHERE map_id <> 3 OR attempt_id <> 2 GROUP BY 1")
def op37(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = mapper_ends(spark, sf_dir).where("map_id <> 3 or attempt_id <> 2").groupBy(F.col("attempt_id").alias("stage")).agg(F.countDistinct("map_id").alias("ended"))
    return ended.withColumn("complete", F.col("ended") == key_counts(spark, sf_dir)[0])


@query("op38_final_commit", "SELECT pid, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(epoch) AS last_epoch, bool_and(epoch <> 11) AS clean FROM locations GROUP BY 1")
def op38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a final commit collects of each partition; an empty result of the unclean ones marks it failed."""
    return locations(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("epoch").alias("last_epoch"), F.every(F.col("epoch") != 11).alias("clean"))


@query("op39_data_loss", "SELECT unique_id, 'unreplicated' AS mode FROM locations WHERE epoch % 4 = 1 UNION ALL SELECT unique_id, 'replicated' FROM locations WHERE epoch % 4 = 1 AND pid % 3 = 0")
def op39(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = locations(spark, sf_dir)
    failed_primary, failed_replica = places.where("epoch % 4 = 1"), places.where("pid % 3 = 0")
    alone = lost(failed_primary, None, "unique_id").withColumn("mode", F.lit("unreplicated"))
    return alone.unionByName(lost(failed_primary, failed_replica, "unique_id").withColumn("mode", F.lit("replicated")))


@query(
    "op40_committed_locations",
    "SELECT unique_id, CASE WHEN epoch % 4 = 1 THEN (worker + 1) % 5 ELSE worker END AS worker, CASE WHEN epoch % 4 <> 1 AND pid % 3 <> 0 THEN (worker + 1) % 5 END AS peer, epoch % 4 = 1 AS promoted FROM locations WHERE epoch % 4 <> 1 OR pid % 3 <> 0",
)
def op40(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = locations(spark, sf_dir)
    return committed(places.where("epoch % 4 <> 1"), places.where("pid % 3 <> 0").withColumn("worker", pmod(F.col("worker") + 1, 5).cast("int")))


@query("op41_map_partition_commit", "SELECT map_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, NOT bool_or(batch_id = 7 AND map_id % 5 = 0) AS success FROM batches GROUP BY 1")
def op41(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost_here = (F.col("batch_id") == 7) & (pmod("map_id", 5) == 0)
    return batches(spark, sf_dir).groupBy("map_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), (~F.bool_or(lost_here)).alias("success"))


@query("op42_unhandled_locations", "SELECT unique_id FROM locations WHERE NOT (epoch < 6 AND pid <> 2)")
def op42(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = locations(spark, sf_dir)
    handled = requested.where("epoch < 6 and pid <> 2").select("unique_id")
    return requested.join(handled, "unique_id", "left_anti").select("unique_id")


@query("op43_commit_once_per_epoch", "SELECT shuffle, epoch, min(o_orderkey) AS reply FROM (SELECT o_custkey % 20 AS shuffle, o_orderkey % 6 AS epoch, o_orderkey FROM orders) GROUP BY 1, 2")
def op43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated commit of an epoch gets the first one's reply."""
    asked = read_table(spark, sf_dir, "orders").select(pmod("o_custkey", 20).alias("shuffle"), pmod("o_orderkey", 6).alias("epoch"), "o_orderkey")
    return asked.groupBy("shuffle", "epoch").agg(F.min("o_orderkey").alias("reply"))


@query("op44_reserve_slots", "SELECT pid, bool_and(worker <> 4) AS reserved, CAST(count(*) FILTER (worker = 4) AS BIGINT) AS refused FROM locations GROUP BY 1")
def op44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All or nothing: one writer that can't be made destroys the rest."""
    return locations(spark, sf_dir).groupBy("pid").agg(F.every(F.col("worker") != 4).alias("reserved"), F.count_if(F.col("worker") == 4).alias("refused"))


def shuffle_ids(asks: DataFrame) -> DataFrame:
    """Shuffle id of each writer's stage attempt: a determinate stage that is neither barrier nor skew-split keeps the first id.

    asks: app_shuffle, stage_attempt, determinate, barrier.  A new id is the number of ids the app shuffle has before it.
    """
    order = Window.partitionBy("app_shuffle").orderBy("stage_attempt")
    attempts = asks.groupBy("app_shuffle", "stage_attempt").agg(F.min(F.col("determinate").cast("int")).alias("d"), F.max(F.col("barrier").cast("int")).alias("b"))
    fresh = F.when((F.row_number().over(order) == 1) | (F.col("d") == 0) | (F.col("b") == 1), 1).otherwise(0)
    return attempts.withColumn("fresh", fresh).withColumn("shuffle_id", (F.sum("fresh").over(order) - 1).cast("int")).select("app_shuffle", "stage_attempt", (F.col("fresh") == 1).alias("is_new"), "shuffle_id")


@query(
    "op45_shuffle_ids",
    """WITH a AS (SELECT o_custkey % 50 AS app_shuffle, CAST(o_orderkey % 5 AS INT) AS stage_attempt, min(CAST(o_custkey % 50 <> 7 AS INT)) AS d, max(CAST(o_custkey % 50 % 10 = 3 AS INT)) AS b FROM orders GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY app_shuffle ORDER BY stage_attempt) = 1 OR d = 0 OR b = 1 THEN 1 ELSE 0 END AS fresh FROM a)
    SELECT app_shuffle, stage_attempt, fresh = 1 AS is_new, CAST(sum(fresh) OVER (PARTITION BY app_shuffle ORDER BY stage_attempt) - 1 AS INT) AS shuffle_id FROM f""",
)
def op45(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = read_table(spark, sf_dir, "orders").select(pmod("o_custkey", 50).alias("app_shuffle"), pmod("o_orderkey", 5).cast("int").alias("stage_attempt"))
    return shuffle_ids(asks.withColumns({"determinate": F.col("app_shuffle") != 7, "barrier": pmod("app_shuffle", 10) == 3}))


@query(
    "op45b_reader_shuffle_id",
    "SELECT app_shuffle, max(stage_attempt) AS shuffle_id FROM (SELECT o_custkey % 50 AS app_shuffle, CAST(o_orderkey % 5 AS INT) AS stage_attempt, count(DISTINCT o_custkey % 3) AS ended FROM orders GROUP BY 1, 2) WHERE ended = 3 GROUP BY 1",
)
def op45b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader takes the latest id whose map tasks have all ended; a shuffle without one is to be rerun and has no row."""
    ended = read_table(spark, sf_dir, "orders").groupBy(pmod("o_custkey", 50).alias("app_shuffle"), pmod("o_orderkey", 5).cast("int").alias("stage_attempt")).agg(F.countDistinct(pmod("o_custkey", 3)).alias("ended"))
    return ended.where("ended = 3").groupBy("app_shuffle").agg(F.max("stage_attempt").alias("shuffle_id"))


@query("op48_expired_shuffles", "SELECT o_custkey AS app, max(o_orderdate) AS unregistered FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-01-01 00:00:00'")
def op48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles whose time since unregistering, at a stated now, exceeds the delay."""
    last = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("app")).agg(F.max("o_orderdate").alias("unregistered"))
    return last.where(F.col("unregistered") < F.to_timestamp(F.lit("1998-01-01 00:00:00")))


@query("op49_release_by_worker", "SELECT worker, count(*) AS n, array_to_string(list_sort(list(unique_id)), ',') AS released FROM locations WHERE epoch % 2 = 0 GROUP BY 1")
def op49(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = locations(spark, sf_dir).where("epoch % 2 = 0").groupBy("worker").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("unique_id")).alias("ids"))
    return grouped.select("worker", "n", F.array_join("ids", ",").alias("released"))


@query(
    "op50_open_partition",
    f"SELECT s.pid, count(*) AS n, CAST(sum(s.size) AS BIGINT) AS bytes FROM (SELECT DISTINCT map_id, attempt_id, pid, batch_id, size FROM sent_batches) s JOIN {WINNERS_SQL} w ON s.map_id = w.map_id AND s.attempt_id = w.attempt_id GROUP BY 1",
)
def op50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of each partition gets: winning attempts only, each batch once."""
    read = read_once(sent_batches(spark, sf_dir), winners(mapper_ends(spark, sf_dir), ["map_id"], "end_ts", "end_seq"))
    return read.groupBy("pid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def read_once(sent: DataFrame, won: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Batches of winning attempts, without failed ones, each (pid, map, batch) once.

    The winners are one row a map task; Spark broadcasts them when they are small and shuffles by map task when not.
    """
    kept = sent.join(won, ["map_id", "attempt_id"], "left_semi")
    if failed is not None:
        kept = kept.join(failed.select("pid", "map_id", "attempt_id", "batch_id").distinct(), ["pid", "map_id", "attempt_id", "batch_id"], "left_anti")
    return kept.dropDuplicates(["pid", "map_id", "batch_id"])
