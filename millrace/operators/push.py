"""Pushing batches: numbering, merging, splitting, replication, congestion windows and failed batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.folds import fold_sorted
from millrace.plans.registry import query
from millrace.sources.tables import PARTITIONS_SQL, batches, key_counts, locations, mapper_ends, pmod, push_events, records, sent_batches


def merged_requests(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """df with request_id: batches for one pair of workers wait until their bytes reach the limit; the rest go last."""

    def step(state, row):
        request, waiting = state
        waiting += row[size]
        return (request + 1, 0) if waiting >= limit else (request, waiting), (request,)

    return fold_sorted(df, keys, order, lambda: (0, 0), step, "request_id int")


def split_status(length: Column, primary: Column, disk_full: Column, memory_full: Column, soft: bool, minimum: int, threshold: int, maximum: int) -> Column:
    """NO_SPLIT, SOFT_SPLIT (written, the client moves on) or HARD_SPLIT (not written, sent again) for a file's length."""
    over = primary & (length > threshold)
    soft_split = over & F.lit(soft) & (length < maximum)
    return F.when(memory_full, "HARD_SPLIT").when(disk_full & (length > minimum), "HARD_SPLIT").when(soft_split, "SOFT_SPLIT").when(over, "HARD_SPLIT").otherwise("NO_SPLIT")


def file_lengths(df: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """df with length: the bytes of the file before each write."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("length", F.coalesce(F.sum(size).over(before), F.lit(0)))


def split_epochs(df: DataFrame, keys: list[str], order: list[str], size: str, threshold: int) -> DataFrame:
    """df with epoch: a write that finds the file over the threshold opens the next location, which starts empty."""

    def step(state, row):
        epoch, length = state
        if length > threshold:
            epoch, length = epoch + 1, 0
        return (epoch, length + row[size]), (epoch,)

    return fold_sorted(df, keys, order, lambda: (0, 0), step, "epoch int")


def answered_requests(df: DataFrame, keys: list[str], order: list[str], epoch: str, tick: str) -> DataFrame:
    """Requests for a partition's next location, each with outcome and answer (the epoch that it is given).

    Requests that arrive in one tick are handled together at its end, by one new epoch.  A request joins one that waits; else,
    if a newer epoch than its own is known, it is answered with that at once; else it opens a new request.
    """

    def step(state, row):
        latest, waiting = state
        if waiting is not None and waiting != row[tick]:
            latest, waiting = latest + 1, None
        if waiting is not None:
            return (latest, waiting), ("joined", latest + 1)
        if latest > row[epoch]:
            return (latest, None), ("known", latest)
        return (latest, row[tick]), ("opened", latest + 1)

    return fold_sorted(df, keys, order, lambda: (0, None), step, "outcome string, answer int")


def congestion_windows(df: DataFrame, keys: list[str], order: list[str], congested: str, most: int, initial_sleep: int = 1000, longest_sleep: int = 5000) -> DataFrame:
    """df with cwnd, threshold and sleep_ms after each reply.

    The window starts at 1 and grows by one a success below the threshold and by one a full window at or above it; congestion
    halves it (1 at least) and makes that the threshold.  There is no pause at a window of `most` or more, and a shorter one
    the larger the window; at a window of 1 each congestion that could not halve it adds a second, up to the longest.
    """

    def step(state, row):
        window, threshold, successes, repeats = state
        if row[congested]:
            repeats += window <= 1
            window = max(1, window // 2)
            threshold, successes = window, 0
        else:
            repeats = 0
            if window < threshold:
                window += 1
            else:
                successes += 1
                if successes >= window:
                    window, successes = window + 1, 0
        sleep = initial_sleep - 60 * window
        sleep = 0 if window >= most else min(longest_sleep, sleep + 1000 * repeats) if window == 1 else max(0, sleep)
        return (window, threshold, successes, repeats), (window, threshold, sleep)

    return fold_sorted(df, keys, order, lambda: (1, most, 0, 0), step, "cwnd int, threshold int, sleep_ms int")


def replicated(df: DataFrame) -> DataFrame:
    return df.withColumn("mode", F.explode(F.array(F.lit("PRIMARY"), F.lit("REPLICA"))))


@query("op24_batch_numbers", "SELECT map_id, attempt_id, pid, batch_id, CAST(row_number() OVER (PARTITION BY map_id, attempt_id ORDER BY pid, batch_id) - 1 AS INT) AS push_id FROM batches")
def op24(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("map_id", "attempt_id").orderBy("pid", "batch_id")
    return batches(spark, sf_dir).select("map_id", "attempt_id", "pid", "batch_id", (F.row_number().over(order) - 1).alias("push_id"))


@query(
    "op25_merged_requests",
    f"""WITH RECURSIVE r AS (SELECT pid % ({PARTITIONS_SQL} // 2) AS target, size, row_number() OVER (PARTITION BY pid % ({PARTITIONS_SQL} // 2) ORDER BY map_id, attempt_id, pid, batch_id) AS i FROM batches),
    f AS (SELECT target, i, size, 0 AS request_id, CASE WHEN size >= 65536 THEN 1 ELSE 0 END AS following, CASE WHEN size >= 65536 THEN 0 ELSE size END AS waiting FROM r WHERE i = 1
      UNION ALL SELECT r.target, r.i, r.size, f.following, CASE WHEN f.waiting + r.size >= 65536 THEN f.following + 1 ELSE f.following END, CASE WHEN f.waiting + r.size >= 65536 THEN 0 ELSE f.waiting + r.size END
      FROM f JOIN r ON r.target = f.target AND r.i = f.i + 1)
    SELECT target, request_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""",
)
def op25(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = batches(spark, sf_dir).withColumn("target", pmod("pid", key_counts(spark, sf_dir)[1] // 2).cast("int"))
    out = merged_requests(queued, ["target"], ["map_id", "attempt_id", "pid", "batch_id"], "size", 65536)
    return out.groupBy("target", "request_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


SPLIT_SQL = """SELECT pid, mode, status, count(*) AS n FROM (SELECT pid, mode, CASE WHEN pid = 7 AND length > 1000000 THEN 'HARD_SPLIT' WHEN pid = 6 AND length > 20000 THEN 'HARD_SPLIT'
      WHEN mode = 'PRIMARY' AND length > 100000 AND length < 400000 THEN 'SOFT_SPLIT' WHEN mode = 'PRIMARY' AND length > 100000 THEN 'HARD_SPLIT' ELSE 'NO_SPLIT' END AS status
    FROM (SELECT pid, coalesce(sum(size) OVER (PARTITION BY pid ORDER BY map_id, attempt_id, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS length FROM batches), (VALUES ('PRIMARY'), ('REPLICA')) m(mode)) GROUP BY 1, 2, 3"""


@query("op26_partition_split", SPLIT_SQL)
def op26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition 7 has memory files only, partition 6 a full disk."""
    sized = replicated(file_lengths(batches(spark, sf_dir), ["pid"], ["map_id", "attempt_id", "batch_id"], "size"))
    status = split_status(F.col("length"), F.col("mode") == "PRIMARY", F.col("pid") == 6, (F.col("pid") == 7) & (F.col("length") > 1_000_000), True, 20_000, 100_000, 400_000)
    return sized.groupBy("pid", "mode", status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "op27_split_epochs",
    """WITH RECURSIVE r AS (SELECT pid, size, row_number() OVER (PARTITION BY pid ORDER BY map_id, attempt_id, batch_id) AS i FROM batches),
    f AS (SELECT pid, i, size, 0 AS epoch, size AS length FROM r WHERE i = 1
      UNION ALL SELECT r.pid, r.i, r.size, CASE WHEN f.length > 200000 THEN f.epoch + 1 ELSE f.epoch END, CASE WHEN f.length > 200000 THEN r.size ELSE f.length + r.size END FROM f JOIN r ON r.pid = f.pid AND r.i = f.i + 1)
    SELECT pid, epoch, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""",
)
def op27(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = split_epochs(batches(spark, sf_dir), ["pid"], ["map_id", "attempt_id", "batch_id"], "size", 200_000)
    return out.groupBy("pid", "epoch").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    "op27b_split_requests",
    """WITH RECURSIVE r AS (SELECT pid, batch_id // 3 AS epoch, batch_id // 2 AS tick, row_number() OVER (PARTITION BY pid ORDER BY batch_id, map_id, attempt_id) AS i FROM batches WHERE (map_id + batch_id) % 3 = 0),
    f AS (SELECT pid, i, 0 AS latest, tick AS waiting, 'opened' AS outcome, 1 AS answer FROM r WHERE i = 1
      UNION ALL SELECT pid, i, latest, CASE WHEN joins THEN waiting WHEN latest > epoch THEN -1 ELSE tick END, CASE WHEN joins THEN 'joined' WHEN latest > epoch THEN 'known' ELSE 'opened' END, CASE WHEN NOT joins AND latest > epoch THEN latest ELSE latest + 1 END
      FROM (SELECT r.pid, r.i, r.epoch, r.tick, f.waiting, f.waiting = r.tick AS joins, f.latest + CASE WHEN f.waiting >= 0 AND f.waiting <> r.tick THEN 1 ELSE 0 END AS latest FROM f JOIN r ON r.pid = f.pid AND r.i = f.i + 1))
    SELECT pid, outcome, answer, count(*) AS n FROM f GROUP BY 1, 2, 3""",
)
def op27b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third push of a map task finds its partition split."""
    asked = batches(spark, sf_dir).where(pmod(F.col("map_id") + F.col("batch_id"), 3) == 0)
    timed = asked.select("pid", "map_id", "attempt_id", "batch_id", F.floor(F.col("batch_id") / 3).cast("int").alias("epoch"), F.floor(F.col("batch_id") / 2).cast("int").alias("tick"))
    out = answered_requests(timed, ["pid"], ["batch_id", "map_id", "attempt_id"], "epoch", "tick")
    return out.groupBy("pid", "outcome", "answer").agg(F.count("*").alias("n"))


@query("op28_revive_batching", "SELECT DISTINCT map_id AS shuffle_id, pid FROM records WHERE size > 4500")
def op28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("size > 4500").select(F.col("map_id").alias("shuffle_id"), "pid").dropDuplicates(["shuffle_id", "pid"])


@query("op29_resend_hard_splits", "SELECT map_id, attempt_id, pid, batch_id FROM batches WHERE (pid + batch_id) % 7 = 3")
def op29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a merged request's per-batch replies only the hard splits are sent again."""
    reply = F.when(pmod(F.col("pid") + F.col("batch_id"), 7) == 3, "HARD_SPLIT").when(pmod(F.col("pid") + F.col("batch_id"), 7) == 2, "SOFT_SPLIT").otherwise("SUCCESS")
    return batches(spark, sf_dir).withColumn("status", reply).where("status = 'HARD_SPLIT'").select("map_id", "attempt_id", "pid", "batch_id")


@query("op30_replication", "SELECT unique_id, size, mode, CASE WHEN mode = 'PRIMARY' THEN worker ELSE (worker + 1) % 5 END AS worker FROM locations, (VALUES ('PRIMARY'), ('REPLICA')) m(mode)")
def op30(spark: SparkSession, sf_dir: str) -> DataFrame:
    peer = F.when(F.col("mode") == "PRIMARY", F.col("worker")).otherwise(pmod(F.col("worker") + 1, 5)).cast("int")
    return replicated(locations(spark, sf_dir)).select("unique_id", "size", "mode", peer.alias("worker"))


@query("op31_push_to_ended_map", "SELECT map_id, attempt_id, count(*) AS n FROM sent_batches WHERE map_id NOT IN (SELECT map_id FROM mapper_ends WHERE attempt_id = 1 AND map_id < 8) GROUP BY 1, 2")
def op31(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = mapper_ends(spark, sf_dir).where("attempt_id = 1 and map_id < 8").select("map_id").distinct()
    return sent_batches(spark, sf_dir).join(ended, "map_id", "left_anti").groupBy("map_id", "attempt_id").agg(F.count("*").alias("n"))


@query(
    "op33_slow_start",
    """WITH RECURSIVE r AS (SELECT user_id, kind = 'error' OR bytes > 45000 AS congested, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM push_events),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 1 AS w, 16 AS t, 0 AS s, 0 AS rep FROM (SELECT DISTINCT user_id FROM push_events)
      UNION ALL SELECT r.user_id, r.i,
        CASE WHEN congested THEN greatest(1, w // 2) WHEN w < t THEN w + 1 WHEN s + 1 >= w THEN w + 1 ELSE w END,
        CASE WHEN congested THEN greatest(1, w // 2) ELSE t END,
        CASE WHEN congested THEN 0 WHEN w < t THEN s WHEN s + 1 >= w THEN 0 ELSE s + 1 END,
        CASE WHEN congested AND w <= 1 THEN rep + 1 WHEN congested THEN rep ELSE 0 END
      FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
    SELECT user_id, CAST(i AS INT) AS i, w AS cwnd, t AS threshold, CAST(CASE WHEN w >= 16 THEN 0 WHEN w = 1 THEN least(5000, 940 + 1000 * rep) ELSE greatest(0, 1000 - 60 * w) END AS INT) AS sleep_ms FROM f WHERE i > 0""",
)
def op33(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = push_events(spark, sf_dir).select("user_id", "event_id", ((F.col("kind") == "error") | (F.col("bytes") > 45000)).alias("congested"))
    numbered = events.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return congestion_windows(numbered, ["user_id"], ["event_id"], "congested", 16).select("user_id", "i", "cwnd", "threshold", "sleep_ms")


@query("op35_failed_batches", "SELECT pid, map_id, attempt_id, array_to_string(list_sort(list(DISTINCT batch_id)), ',') AS failed FROM sent_batches WHERE (batch_id + map_id) % 3 = 0 GROUP BY 1, 2, 3")
def op35(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = sent_batches(spark, sf_dir).where(pmod(F.col("batch_id") + F.col("map_id"), 3) == 0)
    sets = failed.groupBy("pid", "map_id", "attempt_id").agg(F.array_sort(F.collect_set("batch_id")).alias("ids"))
    return sets.select("pid", "map_id", "attempt_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("failed"))
