"""Control plane: slot allocation, worker sets, quotas, rates and hysteresis, fallback, metrics and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.registry import query
from millrace.sources.tables import consumption, disks, locations, pmod, push_events, read_table, workers

DIMENSIONS = ("disk_bytes", "disk_files", "hdfs_bytes", "hdfs_files")


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with idx from 0 and n; for control tables (workers, disks), which are small whatever the data."""
    return df.withColumns({"idx": F.row_number().over(Window.orderBy(*order)) - 1, "n": F.count("*").over(Window.partitionBy())})


def round_robin(partitions: DataFrame, ring: DataFrame, primary_start: int, replica_start: int) -> DataFrame:
    """primary and replica worker of each partition, last to first, on a ring of workers (worker, idx, n) from given starts.

    The replica's index also advances by one a partition; where it would meet the primary, it takes the next worker.
    """
    turn = partitions.withColumn("turn", F.row_number().over(Window.orderBy(F.col("pid").desc())) - 1)
    placed = turn.withColumn("n", F.lit(ring.count()))
    p, r = pmod_col(F.col("turn") + primary_start, F.col("n")), pmod_col(F.col("turn") + replica_start, F.col("n"))
    slots = placed.withColumns({"p": p, "r": F.when(r == p, pmod_col(r + 1, F.col("n"))).otherwise(r)})
    a, b = (ring.select(F.col("idx").alias(k), F.col("worker").alias(name)) for k, name in (("p", "primary_worker"), ("r", "replica_worker")))
    return slots.join(a, "p").join(b, "r").select("pid", "primary_worker", "replica_worker")


def pmod_col(a: Column, n: Column) -> Column:
    return F.pmod(a, n).cast("int")


def disk_groups(ring: DataFrame, cost: Column, groups: int) -> DataFrame:
    """Disks in consecutive groups of ceil(n / groups) by ascending cost; the last may be short."""
    ordered = numbered(ring.withColumn("cost", cost), "cost", "worker", "disk")
    return ordered.withColumn("grp", F.floor(F.col("idx") / F.ceil(F.col("n") / groups)).cast("int"))


def group_shares(used: list[int], groups: int, gradient: float) -> dict[int, float]:
    """Share of slots of each non-empty group: (1 + gradient) to the power of its distance from the slowest, normalised."""
    weight = {g: (1 + gradient) ** (groups - 1 - g) for g in used}
    return {g: w / sum(weight.values()) for g, w in weight.items()}


def group_allocations(shares: dict[int, float], capacity: dict[int, int], wanted: int) -> dict[int, int]:
    """Slots of each group: the share of all that is wanted, rounded up; what a group can't hold is carried to the next."""
    out, carry, left = {}, 0, wanted
    for g in sorted(shares):
        ask = min(left, -(-int(round(shares[g] * wanted * 1e9)) // 10**9) + carry)
        out[g] = min(ask, capacity[g])
        carry, left = ask - out[g], left - out[g]
    return out


def exceeds(quota: dict[str, int], used=F.col) -> Column:
    """Whether any dimension is at or over its quota."""
    out = F.lit(False)
    for d, q in quota.items():
        out = out | (used(d) >= q)
    return out


def expired_apps(apps: DataFrame, keys: list[str], quota: dict[str, int]) -> DataFrame:
    """apps with expired: the largest first, while what remains without those before still exceeds the quota."""
    order = Window.partitionBy(*keys).orderBy(*(F.col(d).desc() for d in DIMENSIONS), "app")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    remains = {f"__{d}": F.sum(d).over(whole) - F.coalesce(F.sum(d).over(before), F.lit(0)) for d in DIMENSIONS}
    return apps.withColumns(remains).withColumn("expired", exceeds(quota, lambda d: F.col(f"__{d}"))).drop(*remains)


def forward_filled(state: Column, keys: list[str], order: list[str], first: Column) -> Column:
    """The last decided state, or `first` before any: hysteresis as a running last value."""
    return F.coalesce(F.last(state, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), first)


@query("op91_offer_slots", "SELECT p.range AS pid, s.worker FROM range(12) p JOIN (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS idx, count(*) OVER () AS n FROM workers) s ON s.idx = (11 - p.range + 3) % s.n")
def op91(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = numbered(workers(spark, sf_dir).select("worker"), "worker")
    placed = round_robin(spark.range(12).select(F.col("id").alias("pid")), ring, 3, 3)
    return placed.select("pid", F.col("primary_worker").alias("worker"))


@query(
    "op92_round_robin_slots",
    """WITH w AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT worker FROM disks WHERE usable)),
    t AS (SELECT range AS pid, 99 - range AS turn FROM range(100)),
    s AS (SELECT pid, (turn + 5) % n AS p, CASE WHEN (turn + 5) % n = (turn + 2) % n THEN (turn + 3) % n ELSE (turn + 2) % n END AS r FROM t, (SELECT max(n) AS n FROM w))
    SELECT pid, a.worker AS primary_worker, b.worker AS replica_worker FROM s JOIN w a ON a.idx = p JOIN w b ON b.idx = r""",
)
def op92(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = numbered(disks(spark, sf_dir).where("usable").select("worker").distinct(), "worker")
    return round_robin(spark.range(100).select(F.col("id").alias("pid")), ring, 5, 2)


COST_SQL = 'flush * 1 + "fetch" * 2 + active * 3'


@query(
    "op93_load_aware_groups",
    f"SELECT worker, disk, cost, CAST(idx // CAST(ceil(n / 5.0) AS BIGINT) AS INT) AS grp FROM (SELECT worker, disk, {COST_SQL} AS cost, row_number() OVER (ORDER BY {COST_SQL}, worker, disk) - 1 AS idx, count(*) OVER () AS n FROM disks WHERE usable)",
)
def op93(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("flush") + F.col("fetch") * 2 + F.col("active") * 3
    return disk_groups(disks(spark, sf_dir).where("usable"), cost, 5).select("worker", "disk", "cost", "grp")


@query("op93b_load_aware_allocations")
def op93b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each group for 1,000 partitions; the groups are a parameter, so a handful of rows is folded here."""
    cost = F.col("flush") + F.col("fetch") * 2 + F.col("active") * 3
    rows = disk_groups(disks(spark, sf_dir).where("usable"), cost, 5).groupBy("grp").agg(F.sum("slots").alias("slots")).orderBy("grp").collect()
    given = group_allocations(group_shares([r.grp for r in rows], 5, 0.1), {r.grp: r.slots for r in rows}, 1000)
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({g}, {n})" for g, n in given.items()) + " AS t(grp, slots)")


@query(
    "op94_constraint_relaxation",
    """WITH p AS (SELECT range AS pid FROM range(60)), w AS (SELECT worker, rack, load FROM workers),
    t1 AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS i FROM w WHERE load > 8000), t2 AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS i FROM w WHERE load > 4000 AND load <= 8000),
    t3 AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS i FROM w),
    a AS (SELECT pid, worker, 1 AS pass FROM p JOIN t1 ON pid = i), b AS (SELECT pid, worker, 2 AS pass FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS k FROM p WHERE pid NOT IN (SELECT pid FROM a)) JOIN t2 ON k = i),
    c AS (SELECT pid, worker, 3 AS pass FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS k FROM p WHERE pid NOT IN (SELECT pid FROM a) AND pid NOT IN (SELECT pid FROM b)) JOIN t3 ON k % (SELECT count(*) FROM t3) = i)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def op94(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions left by one pass go to the next, wider one: preferred workers, then the next, then all in turn."""
    left = spark.range(60).select(F.col("id").alias("pid"))
    every = workers(spark, sf_dir)
    out = None
    for number, (ring, cyclic) in enumerate(((every.where("load > 8000"), False), (every.where("load > 4000 and load <= 8000"), False), (every, True)), 1):
        ring = numbered(ring.select("worker"), "worker")
        turn = left.withColumn("k", F.row_number().over(Window.orderBy("pid")) - 1)
        if cyclic:
            turn = turn.withColumn("k", F.pmod("k", F.lit(ring.count())))
        placed = turn.join(ring, F.col("k") == F.col("idx")).select("pid", "worker", F.lit(number).alias("pass"))
        left = left.join(placed.select("pid"), "pid", "left_anti")
        out = placed if out is None else out.unionByName(placed)
    return out


@query(
    "op95_interruption_ranking",
    "SELECT worker, notice, CASE WHEN notice IS NULL THEN 0 WHEN rn <= floor(0.5 * n) THEN 1 ELSE 2 END AS tier FROM (SELECT worker, notice, row_number() OVER (PARTITION BY notice IS NULL ORDER BY notice DESC, worker) AS rn, count(*) FILTER (notice IS NOT NULL) OVER () AS n FROM (SELECT worker, CASE WHEN load % 3 <> 0 THEN load END AS notice FROM workers))",
)
def op95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers without notice first, then the half with the latest notices, then the rest."""
    noticed = workers(spark, sf_dir).select("worker", F.when(pmod("load", 3) != 0, F.col("load")).alias("notice"))
    late = F.row_number().over(Window.partitionBy(F.col("notice").isNull()).orderBy(F.col("notice").desc(), "worker"))
    n = F.count("notice").over(Window.partitionBy())
    return noticed.select("worker", "notice", F.when(F.col("notice").isNull(), 0).when(late <= F.floor(n * 0.5), 1).otherwise(2).alias("tier"))


@query("op96_rack_aware_order", "SELECT worker, CAST(row_number() OVER (ORDER BY round, size DESC, rack) AS INT) AS place FROM (SELECT worker, rack, row_number() OVER (PARTITION BY rack ORDER BY worker) AS round, count(*) OVER (PARTITION BY rack) AS size FROM workers)")
def op96(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worker of each rack a round, larger racks first."""
    ranked = workers(spark, sf_dir).withColumns({"round": F.row_number().over(Window.partitionBy("rack").orderBy("worker")), "size": F.count("*").over(Window.partitionBy("rack"))})
    return ranked.select("worker", F.row_number().over(Window.orderBy("round", F.col("size").desc(), "rack")).alias("place"))


@query("op97_worker_window", "SELECT worker FROM (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS idx, count(*) OVER () AS n FROM workers) WHERE ((idx - 90) % n + n) % n < least(20, n)")
def op97(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = numbered(workers(spark, sf_dir).select("worker"), "worker")
    return ring.where(F.pmod(F.col("idx") - 90, F.col("n")) < F.least(F.lit(20), F.col("n"))).select("worker")


def tagged(tags: DataFrame, expression: str) -> DataFrame:
    """Workers with all tags of a comma-separated list; no list means all workers."""
    wanted = sorted({t.strip() for t in expression.split(",") if t.strip()})
    if not wanted:
        return tags.select("worker").distinct()
    return tags.where(F.col("tag").isin(wanted)).groupBy("worker").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(wanted)).select("worker")


@query("op98_tag_filter", "SELECT worker FROM workers WHERE worker % 2 = 0 AND worker % 3 = 0")
def op98(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = workers(spark, sf_dir).select("worker", F.explode(F.array_compact(F.array(F.when(pmod("worker", 2) == 0, "even"), F.when(pmod("worker", 3) == 0, "third"), F.lit("any")))).alias("tag"))
    return tagged(tags, "even, third")


@query("op99_slots_per_disk", "SELECT worker, pid % 2 AS disk, count(*) AS slots FROM locations GROUP BY 1, 2")
def op99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations(spark, sf_dir).groupBy("worker", pmod("pid", 2).cast("int").alias("disk")).agg(F.count("*").alias("slots"))


@query("op100_partition_size_estimate", "SELECT user, CAST(greatest(100000, least(500000, sum(disk_bytes) // sum(disk_files))) AS BIGINT) AS estimate FROM consumption GROUP BY 1")
def op100(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.floor(F.sum("disk_bytes") / F.sum("disk_files"))
    bounded = F.when(F.sum("disk_files") > 0, F.greatest(F.lit(100_000), F.least(F.lit(500_000), mean))).otherwise(F.lit(200_000))
    return consumption(spark, sf_dir).groupBy("user").agg(bounded.cast("long").alias("estimate"))


@query("op101_quota_roll_up", "SELECT grouping_id(tenant, user) AS level, tenant, user, " + ", ".join(f"CAST(sum({d}) AS BIGINT) AS {d}" for d in DIMENSIONS) + " FROM consumption GROUP BY ROLLUP (tenant, user)")
def op101(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption(spark, sf_dir).rollup("tenant", "user").agg(F.grouping_id().cast("long").alias("level"), *(F.sum(d).alias(d) for d in DIMENSIONS)).select("level", "tenant", "user", *DIMENSIONS)


QUOTA = {"disk_bytes": 40_000_000, "disk_files": 300, "hdfs_bytes": 20_000, "hdfs_files": 1_000_000}


@query(
    "op102_quota_expiry",
    "SELECT tenant, user, app, " + " OR ".join(f"r_{d} >= {q}" for d, q in QUOTA.items()) + " AS expired FROM (SELECT tenant, user, app, "
    + ", ".join(f"sum({d}) OVER (PARTITION BY tenant, user) - coalesce(sum({d}) OVER (PARTITION BY tenant, user ORDER BY {', '.join(f'{x} DESC' for x in DIMENSIONS)}, app ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r_{d}" for d in DIMENSIONS) + " FROM consumption)",
)
def op102(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expired_apps(consumption(spark, sf_dir), ["tenant", "user"], QUOTA).select("tenant", "user", "app", "expired")


@query("op103_merged_consumption", "SELECT app, CAST(sum(disk_bytes) AS BIGINT) AS disk_bytes, CAST(sum(disk_files) AS BIGINT) AS disk_files FROM (SELECT app, disk_bytes, disk_files FROM consumption UNION ALL SELECT app, 10, 1 FROM consumption WHERE app % 2 = 0) GROUP BY 1")
def op103(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports of consumption by app, added."""
    first = consumption(spark, sf_dir).select("app", "disk_bytes", "disk_files")
    second = first.where("app % 2 = 0").select("app", F.lit(10).cast("long").alias("disk_bytes"), F.lit(1).cast("long").alias("disk_files"))
    return first.unionByName(second).groupBy("app").agg(F.sum("disk_bytes").alias("disk_bytes"), F.sum("disk_files").alias("disk_files"))


def sliding_rates(events: DataFrame, keys: list[str], bucket: str, value: str, width: int) -> DataFrame:
    """Bytes a bucket over the last `width` buckets, counting the empty ones between the first and last live bucket."""
    summed = events.groupBy(*keys, bucket).agg(F.sum(value).alias("v"))
    live = Window.partitionBy(*keys).orderBy(bucket).rangeBetween(-(width - 1), 0)
    return summed.withColumns({"total": F.sum("v").over(live), "buckets": F.col(bucket) - F.min(bucket).over(live) + 1}).select(*keys, bucket, "total", F.floor(F.col("total") / F.col("buckets")).alias("rate"))


RATE_SQL = """(SELECT user_id, hour, total, total // buckets AS rate FROM (SELECT user_id, hour, CAST(sum(v) OVER w AS BIGINT) AS total, hour - min(hour) OVER w + 1 AS buckets FROM (SELECT user_id, hour, sum(bytes) AS v FROM push_events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)))"""


@query("op104_sliding_rate", f"SELECT * FROM {RATE_SQL}")
def op104(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_rates(push_events(spark, sf_dir), ["user_id"], "hour", "bytes", 24)


#: High and low marks of a user's rate, of the worker's rate and of its pending bytes.
USER_MARKS, WORKER_MARKS, PENDING_MARKS = (15_000, 6_000), (85_000, 70_000), (95_000, 50_000)


def worker_state(events: DataFrame, hour: str, user: str, size: str, pending: Column, width: int) -> DataFrame:
    """hour, mean (the worker's rate a user seen so far) and over: whether the worker is congested, with hysteresis.

    It is once its rate or its pending bytes pass the high mark, until both are below the low ones.  One row an hour.
    """
    hourly = sliding_rates(events.withColumn("__all", F.lit(0)), ["__all"], hour, size, width)
    waiting = events.groupBy(hour).agg(F.sum(pending).alias("pending"))
    fresh = events.groupBy(user).agg(F.min(hour).alias(hour)).groupBy(hour).agg(F.count("*").alias("fresh"))
    rows = hourly.join(waiting, hour).join(fresh, hour, "left")
    users = F.sum(F.coalesce("fresh", F.lit(0))).over(Window.orderBy(hour).rowsBetween(Window.unboundedPreceding, 0))
    on = (F.col("pending") > PENDING_MARKS[0]) | (F.col("rate") > WORKER_MARKS[0])
    off = (F.col("pending") < PENDING_MARKS[1]) & (F.col("rate") < WORKER_MARKS[1])
    over = forward_filled(F.when(off, F.lit(False)).when(on, F.lit(True)), [], [hour], F.lit(False))
    return rows.select(hour, F.floor(F.col("rate") / users).alias("mean"), over.alias("over"))


WORKER_SQL = f"""(SELECT hour, rate // users AS mean, coalesce(last_value(CASE WHEN pending < {PENDING_MARKS[1]} AND rate < {WORKER_MARKS[1]} THEN false WHEN pending > {PENDING_MARKS[0]} OR rate > {WORKER_MARKS[0]} THEN true END IGNORE NULLS) OVER (ORDER BY hour), false) AS over_mark
    FROM (SELECT h.hour, total // buckets AS rate, pending, sum(coalesce(fresh, 0)) OVER (ORDER BY h.hour) AS users
      FROM (SELECT hour, sum(v) OVER w AS total, hour - min(hour) OVER w + 1 AS buckets, pending FROM (SELECT hour, sum(bytes) AS v, sum(CASE WHEN event_id % 7 < 5 THEN bytes ELSE 0 END) AS pending FROM push_events GROUP BY 1) WINDOW w AS (ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)) h
      LEFT JOIN (SELECT hour, count(*) AS fresh FROM (SELECT user_id, min(hour) AS hour FROM push_events GROUP BY 1) GROUP BY 1) f ON f.hour = h.hour))"""


@query(
    "op105_congestion_decision",
    f"""SELECT user_id, hour, early OR coalesce(last_value(CASE WHEN early THEN NULL WHEN rate > {USER_MARKS[0]} THEN true WHEN rate < {USER_MARKS[1]} THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour), false) AS congested
    FROM (SELECT r.user_id, r.hour, r.rate, w.over_mark AND r.rate > w.mean AS early FROM {RATE_SQL} r JOIN {WORKER_SQL} w ON w.hour = r.hour)""",
)
def op105(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A congested worker stops users above the mean rate; else a user is stopped above the high mark, until below the low one.

    What the worker's congestion decides leaves the user's own state as it was.
    """
    events = push_events(spark, sf_dir)
    state = worker_state(events, "hour", "user_id", "bytes", F.when(pmod("event_id", 7) < 5, F.col("bytes")).otherwise(0), 24)
    rates = sliding_rates(events, ["user_id"], "hour", "bytes", 24).join(state, "hour").withColumn("early", F.col("over") & (F.col("rate") > F.col("mean")))
    own = F.when(~F.col("early"), F.when(F.col("rate") > USER_MARKS[0], F.lit(True)).when(F.col("rate") < USER_MARKS[1], F.lit(False)))
    return rates.select("user_id", "hour", (F.col("early") | forward_filled(own, ["user_id"], ["hour"], F.lit(False))).alias("congested"))


@query("op106_inactive_users", "SELECT user_id, max(hour) AS last_hour FROM push_events GROUP BY 1 HAVING (SELECT max(hour) FROM push_events) - max(hour) >= 12")
def op106(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = push_events(spark, sf_dir).groupBy("user_id").agg(F.max("hour").alias("last_hour"))
    now = last.agg(F.max("last_hour")).scalar()
    return last.where(now - F.col("last_hour") >= 12)


@query("op107_lost_workers", "SELECT user_id % 40 AS worker, max(hour) AS heartbeat FROM push_events GROUP BY 1 HAVING (SELECT max(hour) FROM push_events) - max(hour) > 3")
def op107(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = push_events(spark, sf_dir).groupBy(pmod("user_id", 40).alias("worker")).agg(F.max("hour").alias("heartbeat"))
    now = beats.agg(F.max("heartbeat")).scalar()
    return beats.where(now - F.col("heartbeat") > 3)


@query("op108_lost_apps", "SELECT o_custkey AS app, max(o_orderdate) AS heartbeat, count(*) AS shuffles FROM orders GROUP BY 1 HAVING max(o_orderdate) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY")
def op108(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("app")).agg(F.max("o_orderdate").alias("heartbeat"), F.count("*").alias("shuffles"))
    now = beats.agg(F.max("heartbeat")).scalar()
    return beats.where(F.col("heartbeat") < now - F.expr("INTERVAL 400 DAY"))


@query("op109_available_workers", "SELECT worker FROM workers WHERE worker % 5 <> 0 AND worker % 7 <> 1 AND load >= 0 AND rack <> 3")
def op109(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All workers without the excluded, shut down, lost and decommissioned."""
    every = workers(spark, sf_dir)
    out = every.select("worker")
    for gone in (every.where("worker % 5 = 0"), every.where("worker % 7 = 1"), every.where("load < 0"), every.where("rack = 3")):
        out = out.join(gone.select("worker"), "worker", "left_anti")
    return out


def fallback(forced: Column, partitions: Column, over_quota: Column, available: Column, most: int) -> Column:
    """The first policy that asks for the built-in exchange, or NONE."""
    return F.coalesce(F.when(forced, "FORCE"), F.when(partitions > most, "PARTITIONS"), F.when(over_quota, "QUOTA"), F.when(~available, "WORKERS"), F.lit("NONE"))


FALLBACK_SQL = "CASE WHEN p_partkey % 17 = 0 THEN 'FORCE' WHEN p_size * 10 > 400 THEN 'PARTITIONS' WHEN p_partkey % 5 = 0 THEN 'QUOTA' WHEN p_partkey % 3 = 0 THEN 'WORKERS' ELSE 'NONE' END"


def part_policy() -> Column:
    return fallback(pmod("p_partkey", 17) == 0, F.col("p_size") * 10, pmod("p_partkey", 5) == 0, pmod("p_partkey", 3) != 0, 400)


@query("op110_fallback_policy", f"SELECT p_partkey, {FALLBACK_SQL} AS policy FROM part")
def op110(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", part_policy().alias("policy"))


@query("op111_fallback_counts", f"SELECT {FALLBACK_SQL} AS policy, count(*) AS n FROM part GROUP BY 1")
def op111(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").groupBy(part_policy().alias("policy")).agg(F.count("*").alias("n"))


@query(
    "op112_serving_state",
    """SELECT user_id, event_id, CASE WHEN bytes > 45000 THEN 'PUSH_AND_REPLICATE_PAUSED' WHEN bytes > 35000 THEN 'PUSH_PAUSED' WHEN bytes < 20000 THEN 'NONE_PAUSED'
      WHEN coalesce(last_value(CASE WHEN bytes > 35000 THEN true WHEN bytes < 20000 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 'PUSH_PAUSED' ELSE 'NONE_PAUSED' END AS state FROM push_events""",
)
def op112(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the resume mark and the pause mark a paused worker stays paused."""
    used = F.col("bytes")
    paused = forward_filled(F.when(used > 35_000, F.lit(True)).when(used < 20_000, F.lit(False)), ["user_id"], ["event_id"], F.lit(False))
    state = F.when(used > 45_000, "PUSH_AND_REPLICATE_PAUSED").when(used > 35_000, "PUSH_PAUSED").when(used < 20_000, "NONE_PAUSED").when(paused, "PUSH_PAUSED").otherwise("NONE_PAUSED")
    return push_events(spark, sf_dir).select("user_id", "event_id", state.alias("state"))


TIERS = ("MEMORY", "SSD", "HDD", "HDFS")


def created_tier(own: Column, usable: Column, order: tuple[str, ...] = TIERS) -> Column:
    """The first usable tier from MEMORY, if that is in the order, else from the location's own; null if none."""
    listed = F.array(*map(F.lit, order))
    start = F.lit(1) if "MEMORY" in order else F.array_position(listed, own).cast("int")
    return F.get(F.filter(F.slice(listed, start, F.lit(len(order))), lambda t: F.array_contains(usable, t)), 0)


@query("op113_storage_policy", "SELECT worker, disk, CASE WHEN slots > 7 THEN 'MEMORY' WHEN usable AND flush < 20 THEN 'SSD' WHEN usable THEN 'HDD' ELSE 'HDFS' END AS tier FROM disks")
def op113(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = F.array_compact(F.array(F.when(F.col("slots") > 7, "MEMORY"), F.when(F.col("usable") & (F.col("flush") < 20), "SSD"), F.when(F.col("usable"), "HDD"), F.lit("HDFS")))
    return disks(spark, sf_dir).select("worker", "disk", created_tier(F.lit("HDD"), usable).alias("tier"))


@query("op114_eviction", "SELECT worker, disk, active > 5 AND (slots > 6 OR flush * 10 >= 200) AS evict FROM disks")
def op114(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory file moves on when serving is paused and eviction is aggressive or memory files fill their share."""
    return disks(spark, sf_dir).select("worker", "disk", ((F.col("active") > 5) & ((F.col("slots") > 6) | (F.col("flush") * 10 >= 200))).alias("evict"))


SHARES = (0.5, 0.75, 0.95, 0.98, 0.99, 0.999)


@query(
    "op115_timer_percentiles",
    "SELECT kind, count(*) AS n, min(bytes) AS lowest, max(bytes) AS highest, round(avg(bytes), 3) AS mean, " + ", ".join(f"round(quantile_cont(bytes, {s}), 3) AS p{str(s)[2:]}" for s in SHARES) + " FROM (SELECT kind, bytes, row_number() OVER (PARTITION BY kind ORDER BY event_id DESC) AS back FROM push_events) WHERE back <= 1000 GROUP BY 1",
)
def op115(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and exact percentiles of the last 1,000 updates of each timer, a ring buffer's contents."""
    last = push_events(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("event_id").desc()))).where("back <= 1000")
    return last.groupBy("kind").agg(F.count("*").alias("n"), F.min("bytes").alias("lowest"), F.max("bytes").alias("highest"), F.round(F.avg("bytes"), 3).alias("mean"), *(F.round(F.percentile("bytes", F.lit(s)), 3).alias(f"p{str(s)[2:]}") for s in SHARES))


@query("op116_labelled_counters", "SELECT 'push_bytes{kind=\"' || kind || '\"}' AS metric, CAST(sum(bytes) AS BIGINT) AS value FROM push_events GROUP BY kind")
def op116(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = push_events(spark, sf_dir).groupBy("kind").agg(F.sum("bytes").alias("value"))
    return summed.select(F.concat(F.lit('push_bytes{kind="'), F.col("kind"), F.lit('"}')).alias("metric"), "value")


def resolved(*candidates: Column, kind: str, default: Column) -> Column:
    """The first candidate that parses, narrowest level first."""
    return F.coalesce(*(c.try_cast(kind) for c in candidates), default)


@query(
    "op117_config_resolution",
    "SELECT c_custkey, coalesce(TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 4 = 1 THEN 'x' || c_custkey END AS BIGINT), TRY_CAST(CASE WHEN c_nationkey % 3 = 0 THEN CAST(c_nationkey * 1000 AS VARCHAR) WHEN c_nationkey % 3 = 1 THEN 'bad' END AS BIGINT), 77) AS value FROM customer",
)
def op117(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(pmod("c_custkey", 4) == 0, F.col("c_custkey").cast("string")).when(pmod("c_custkey", 4) == 1, F.concat(F.lit("x"), F.col("c_custkey").cast("string")))
    tenant = F.when(pmod("c_nationkey", 3) == 0, (F.col("c_nationkey") * 1000).cast("string")).when(pmod("c_nationkey", 3) == 1, F.lit("bad"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", resolved(user, tenant, kind="bigint", default=F.lit(77).cast("bigint")).alias("value"))


@query("op118_heartbeat_reconcile", "SELECT DISTINCT o_custkey AS app FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def op118(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local shuffles that the master's record lacks are registered again."""
    local = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("app")).distinct()
    recorded = read_table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("app")).distinct()
    return local.join(recorded, "app", "left_anti")


@query(
    "op119_excluded_workers",
    "SELECT worker, since, cause FROM (SELECT user_id % 60 AS worker, max(hour) AS since, arg_max(kind, (hour, event_id)) AS cause FROM push_events GROUP BY 1) WHERE CASE WHEN cause IN ('click', 'view') THEN (SELECT max(hour) FROM push_events) - since < 6 ELSE worker % 4 = 0 END",
)
def op119(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed causes keep a worker excluded until they time out; any other lasts while the master lists the worker."""
    last = push_events(spark, sf_dir).groupBy(pmod("user_id", 60).alias("worker")).agg(F.max("hour").alias("since"), F.max_by("kind", F.struct("hour", "event_id")).alias("cause"))
    now = last.agg(F.max("since")).scalar()
    return last.where(F.when(F.col("cause").isin("click", "view"), now - F.col("since") < 6).otherwise(pmod("worker", 4) == 0))
