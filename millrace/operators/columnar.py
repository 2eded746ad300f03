"""Columnar encoding: eligibility, batching, dictionary encoding, sizes and column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.plans.registry import query
from millrace.sources.tables import TABLES, read_table, records

ELIGIBLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DecimalType)
DICTIONARY_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)
MAX_DICTIONARY = 32767
#: Bytes of a value of each fixed-width type.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
NULL_BYTES = 4


def is_columnar(schema: T.StructType | None) -> bool:
    """Whether every field is of a type that the columnar format can carry."""
    return schema is not None and all(isinstance(f.dataType, ELIGIBLE) for f in schema)


def value_size(column: Column, kind: str) -> Column:
    """Encoded bytes of a value: its width, or four bytes of length and the text's own."""
    return F.lit(WIDTHS[kind]).cast("long") if kind in WIDTHS else (F.octet_length(column) + 4).cast("long")


def row_batches(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """df with batch and place: each partition's rows in batches of `rows`, leftovers last."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__at", at).withColumns({"batch": F.floor(F.col("__at") / rows).cast("int"), "place": F.pmod("__at", F.lit(rows)).cast("int")}).drop("__at")


def dictionary_codes(df: DataFrame, keys: list[str], value: str, arrival: str, limit: int) -> DataFrame:
    """df with code (order of first arrival within the keys) and overflow (more distinct values than the limit).

    First arrivals are one row a distinct value, so ranking them and joining back moves little.
    """
    firsts = df.groupBy(*keys, value).agg(F.min(arrival).alias("__first"))
    ranked = firsts.withColumn("code", (F.row_number().over(Window.partitionBy(*keys).orderBy("__first")) - 1).cast("int"))
    sized = ranked.withColumn("overflow", F.count("*").over(Window.partitionBy(*keys)) > limit)
    return df.join(sized.drop("__first"), [*keys, value]).withColumn("code", F.when(~F.col("overflow"), F.col("code")))


def decoded(coded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of dictionary_codes with `value` read back from the dictionary, or plain where that overflowed."""
    dictionary = coded.where("not overflow").groupBy(*keys, "code").agg(F.min(value).alias("__value"))
    sent = coded.withColumn("__plain", F.when(F.col("overflow"), F.col(value))).drop(value)
    return sent.join(dictionary, [*keys, "code"], "left").withColumn(value, F.coalesce("__plain", "__value")).drop("__plain", "__value")


def column_statistics(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """lower, upper, nulls, rows and bytes of a column for each key; a null costs four bytes."""
    kind = dict(df.dtypes)[column]
    size = F.when(F.col(column).isNull(), F.lit(NULL_BYTES).cast("long")).otherwise(value_size(F.col(column), kind))
    return df.groupBy(*keys).agg(
        F.min(column).cast("string").alias("lower"), F.max(column).cast("string").alias("upper"), F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("n"), F.sum(size).alias("bytes")
    )


@query("op74_columnar_eligibility")
def op74(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, is_columnar(read_table(spark, sf_dir, t).schema)) for t in TABLES]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {str(ok).lower()})" for t, ok in found) + " AS t(name, columnar)")


@query("op75_row_batches", "SELECT pid, CAST((p - 1) // 1000 AS INT) AS batch, count(*) AS n FROM (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY map_id, attempt_id, seq) AS p FROM records) GROUP BY 1, 2")
def op75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_batches(records(spark, sf_dir), ["pid"], ["map_id", "attempt_id", "seq"], 1000).groupBy("pid", "batch").agg(F.count("*").alias("n"))


DICTIONARY_SQL = """r AS (SELECT pid, size, row_number() OVER (PARTITION BY pid ORDER BY map_id, attempt_id, seq) AS p FROM records),
    d AS (SELECT pid, size, min(p) AS first_p FROM r GROUP BY 1, 2), c AS (SELECT pid, size, CAST(row_number() OVER (PARTITION BY pid ORDER BY first_p) - 1 AS INT) AS code, count(*) OVER (PARTITION BY pid) AS n FROM d)"""


def coded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.row_number().over(Window.partitionBy("pid").orderBy("map_id", "attempt_id", "seq"))
    return dictionary_codes(records(spark, sf_dir).select("pid", "size", arrival.alias("p")), ["pid"], "size", "p", min(MAX_DICTIONARY, int(1000 * 0.3)))


@query("op77_dictionary_encoding", f"WITH {DICTIONARY_SQL} SELECT r.pid, r.p AS place, c.code FROM r JOIN c ON r.pid = c.pid AND r.size = c.size")
def op77(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_sizes(spark, sf_dir).select("pid", F.col("p").cast("long").alias("place"), "code")


@query("op77b_dictionary_overflow", "SELECT map_id, count(DISTINCT key) AS n_distinct, count(DISTINCT key) > 300 AS overflow FROM records GROUP BY 1")
def op77b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("map_id").agg(F.countDistinct("key").alias("n_distinct")).withColumn("overflow", F.col("n_distinct") > 300)


@query("op78_encoded_size", f"WITH {DICTIONARY_SQL}, s AS (SELECT pid, count(*) AS distinct_values FROM c GROUP BY 1) SELECT r.pid, CASE WHEN distinct_values > 300 THEN 2147483647 ELSE 4 + 8 * distinct_values + 2 * count(*) END AS compressed, 8 * count(*) AS uncompressed FROM r JOIN s ON r.pid = s.pid GROUP BY r.pid, distinct_values")
def op78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with and without the dictionary: its entries and two bytes a value, or none at all once it overflows."""
    counted = records(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("size").alias("d"))
    compressed = F.when(F.col("d") > 300, F.lit(2147483647)).otherwise(4 + 8 * F.col("d") + 2 * F.col("n"))
    return counted.select("pid", compressed.cast("long").alias("compressed"), (8 * F.col("n")).alias("uncompressed"))


@query("op79_column_statistics", "SELECT p_brand, min(p_name) AS lower, max(p_name) AS upper, count(*) FILTER (p_name IS NULL) AS nulls, count(*) AS n, CAST(sum(CASE WHEN p_name IS NULL THEN 4 ELSE 4 + strlen(p_name) END) AS BIGINT) AS bytes FROM part GROUP BY 1")
def op79(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_statistics(read_table(spark, sf_dir, "part"), "p_name", ["p_brand"])


@query("op79b_long_statistics", "SELECT l_returnflag, CAST(min(l_orderkey) AS VARCHAR) AS lower, CAST(max(l_orderkey) AS VARCHAR) AS upper, count(*) FILTER (l_orderkey IS NULL) AS nulls, count(*) AS n, CAST(count(*) * 8 AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def op79b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_statistics(read_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag"])


@query("op81_columnar_decode", "SELECT pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY map_id, attempt_id, seq) AS BIGINT) AS place, size FROM records")
def op81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes joined to their dictionary give the values back; a partition whose dictionary overflowed carries plain values."""
    return decoded(coded_sizes(spark, sf_dir), ["pid"], "size").select("pid", F.col("p").cast("long").alias("place"), "size")
