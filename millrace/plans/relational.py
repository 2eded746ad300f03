"""The relational workloads an exchange is exercised with: combines, sorts, joins, unions and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources.tables import pmod, read_table, records, work_folder


def words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")


def word_count(df: DataFrame) -> DataFrame:
    return words(df).groupBy("word").agg(F.count("*").alias("n"))


def by_size(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit_rows: int = 100_000) -> DataFrame:
    """A join that broadcasts the right side only if a count shows at most limit_rows rows, and merges sorted runs else."""
    few = right.limit(limit_rows + 1).count() <= limit_rows
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


WORDS_SQL = "(SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents)"


@query("q01_combine_by_key", "SELECT l_suppkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def combine_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_linenumber").alias("total"), F.count("*").alias("n"))


@query("q02_repartition_reduce_filter", "SELECT l_partkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1 HAVING sum(l_linenumber) > 50")
def repartition_reduce_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").repartition(8).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_linenumber").alias("total")).where("total > 50")


@query("q03_group_then_sort", "SELECT l_suppkey AS k, array_to_string(list_sort(list(l_linenumber)), ',') AS vs FROM lineitem GROUP BY 1 ORDER BY 1")
def group_then_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-03 over all rows."""
    grouped = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("vs"))
    return grouped.select("k", F.array_join(F.col("vs").cast("array<string>"), ",").alias("vs")).orderBy("k")


@query("q04_group_order", "SELECT l_returnflag, count(l_linestatus) AS n FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT l_returnflag, count(l_linestatus) AS n FROM {line} GROUP BY l_returnflag ORDER BY l_returnflag", line=read_table(spark, sf_dir, "lineitem"))


@query(
    "q05_reused_exchange",
    """WITH j AS (SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10 LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1)
    SELECT * FROM j WHERE r_name IS NOT NULL UNION SELECT * FROM j""",
)
def reused_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    few = nation.where("n_nationkey < 10")
    joined = customer.join(few, customer.c_nationkey == few.n_nationkey, "left").join(region.where("r_regionkey > 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")
    return joined.where("r_name is not null").union(joined).distinct()


@query(
    "q06_skewed_join",
    """SELECT fa, count(*) AS n, CAST(sum(o_orderkey % 1000) AS BIGINT) AS checksum FROM (SELECT o_orderkey, CASE WHEN o_custkey % 64 < 32 THEN 1 ELSE o_custkey % 64 END AS fa FROM orders) a
    JOIN (SELECT n_nationkey AS fb FROM nation WHERE n_nationkey < 8) b ON fa = fb WHERE fa = 1 GROUP BY fa""",
)
def skewed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all keys collapse to one; a merge join, whose skewed partitions adaptive execution splits."""
    key = pmod("o_custkey", 64)
    left = read_table(spark, sf_dir, "orders").select("o_orderkey", F.when(key < 32, F.lit(1).cast("long")).otherwise(key).alias("fa")).where("fa = 1")
    right = read_table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("fb"))
    joined = left.join(right.hint("merge"), left.fa == right.fb)
    return joined.groupBy("fa").agg(F.count("*").alias("n"), F.sum(pmod("o_orderkey", 1000)).alias("checksum"))


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int) -> DataFrame:
    """An inner join on a key that a few values dominate: left rows are spread over `salts` copies of the right rows."""
    spread = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copied = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copied.hint("merge"), [on, "__salt"]).drop("__salt")


@query("q06b_salted_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return salted_join(read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), nation, "k", 8).groupBy("n_name").agg(F.count("*").alias("n"))


@query("q07_merge_join_of_counts", "SELECT a.k AS k, a.n AS n_left, b.n AS n_right FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k")
def merge_join_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_left"))
    b = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_right"))
    return a.hint("merge").join(b, "k")


@query("q08_union_of_empty", "SELECT count(*) AS n FROM (SELECT r_name FROM region WHERE r_regionkey < 0 UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 0 UNION ALL SELECT c_name FROM customer WHERE c_custkey < 0)")
def union_of_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read_table(spark, sf_dir, t).where(f"{k} < 0").select(F.col(c).alias("name")) for t, k, c in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count("*").alias("n"))


@query("q09_chained_group", "SELECT n AS k, count(*) AS members FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def chained_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("members"))


@query("q10_large_values", "SELECT lang AS k, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents GROUP BY 1")
def large_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide values are reduced before the exchange: only counts travel."""
    return read_table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text").cast("long")).alias("longest"))


JOIN_SQL = "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def joined_orders(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"))
    return line.join(orders.hint(hint), "k").groupBy("priority").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


@query("q11_hash_join", JOIN_SQL)
def hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_orders(spark, sf_dir, "shuffle_hash")


@query("q12_broadcast_join", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return by_size(read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), nation, ["k"]).groupBy("n_name").agg(F.count("*").alias("n"))


@query("q13_sort_merge_join", JOIN_SQL)
def sort_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_orders(spark, sf_dir, "merge")


@query("q14_partitioned_product", "SELECT r_name, n_name, s_suppkey AS s FROM region, nation, supplier")
def partitioned_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-14: regions and nations are tables of fixed size."""
    region, nation = read_table(spark, sf_dir, "region").select("r_name"), read_table(spark, sf_dir, "nation").select("n_name")
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s")).crossJoin(F.broadcast(region.crossJoin(F.broadcast(nation))))


@query("q15_word_count", f"SELECT word, count(*) AS n FROM {WORDS_SQL} WHERE word <> '' GROUP BY 1")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(read_table(spark, sf_dir, "documents"))


@query("q16_keyed_sum", "SELECT event_type AS word, CAST(sum(1) * 200 AS BIGINT) AS n FROM events GROUP BY 1")
def keyed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("word"), F.lit(200).alias("one")).groupBy("word").agg(F.sum("one").alias("n"))


@query("q17_word_count_of_conversations", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(read_table(spark, sf_dir, "conversations"))


@query("q18_ordered_word_count", f"SELECT word, count(*) AS n FROM {WORDS_SQL} WHERE word <> '' GROUP BY 1 ORDER BY n, word")
def ordered_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(read_table(spark, sf_dir, "documents")).orderBy("n", "word")


@query("q19_split_aggregate", "SELECT l_partkey % 100 AS k, CAST(sum(200) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def split_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(pmod("l_partkey", 100).alias("k"), F.lit(200).alias("v")).repartition("k").groupBy("k").agg(F.sum("v").alias("total"))


@query(
    "q20_encoded_sums",
    "SELECT pid, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS total FROM (SELECT pid, unnest(string_split(encoded, '-')) AS x FROM (SELECT pid, map_id, string_agg(size, '-') AS encoded FROM records GROUP BY 1, 2)) GROUP BY 1",
)
def encoded_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = records(spark, sf_dir).groupBy("pid", "map_id").agg(F.array_join(F.collect_list(F.col("size").cast("string")), "-").alias("encoded"))
    return packed.select("pid", F.explode(F.split("encoded", "-")).alias("x")).groupBy("pid").agg(F.sum(F.col("x").cast("long")).alias("total"))


CODECS = ("lz4", "zstd", "none")


def round_trip(df: DataFrame, path: str, codec: str) -> DataFrame:
    """df written with a codec and read again."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("q21_codec_round_trip", "SELECT codec, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(length(o_orderpriority)) AS BIGINT) AS chars FROM orders, (VALUES ('lz4'), ('zstd'), ('none')) c(codec) GROUP BY 1")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes in under each codec comes out again; the files go to the session's shared folder."""
    orders, folder, out = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), work_folder(spark), None
    for codec in CODECS:
        back = round_trip(orders, f"{folder}/{codec}", codec).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.sum(F.length("o_orderpriority")).alias("chars")).withColumn("codec", F.lit(codec))
        out = back if out is None else out.unionByName(back)
    return out.select("codec", "n", "keys", "chars")


@query(
    "q22_distinct_set_ops",
    "SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'left' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, orders = (read_table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    both = customer.select(F.col("c_nationkey").cast("long").alias("k")).intersect(supplier.select(F.col("s_nationkey").cast("long").alias("k")))
    left = customer.select(F.col("c_custkey").alias("k")).subtract(orders.select("o_custkey"))
    return both.withColumn("side", F.lit("both")).unionByName(left.withColumn("side", F.lit("left")))
