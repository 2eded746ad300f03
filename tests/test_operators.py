"""Operators on the fixtures whose expected values are known, and their edge cases."""

import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.checksum import combine_two, combined_crc, crc_of
from millrace.operators.columnar import column_statistics, is_columnar
from millrace.operators.control import expired_apps, group_allocations, group_shares, sliding_rates, tagged
from millrace.operators.exchange import checked_partitions, flushes, packed
from millrace.operators.integrity import range_verdicts
from millrace.operators.push import congestion_windows
from millrace.operators.read import chunk_flags, may_hold, skew_split
from millrace.plans.relational import CODECS, round_trip


def test_known_checksums(spark):
    got = spark.range(1).select(crc_of(F.lit("test")).alias("a"), crc_of(F.lit("data")).alias("b"), combine_two(F.lit(123456789), F.lit(987654321)).alias("c"), combine_two(crc_of(F.lit("test")), crc_of(F.lit("data"))).alias("d")).first()
    assert tuple(got) == (3632233996, 2918445923, 1094268358, 2238869871)


def test_combined_checksum_ignores_order(spark):
    words = [f"w{i}" for i in range(50)]
    lanes = [sum(zlib.crc32(w.encode()) >> 8 * i & 255 for w in words) % 256 for i in range(4)]
    for order in (words, words[::-1]):
        df = spark.createDataFrame([(w,) for w in order], "w string").repartition(5)
        assert df.agg(combined_crc(crc_of(F.col("w"))).alias("c")).first().c == sum(x << 8 * i for i, x in enumerate(lanes))


LENGTHS = [100, 100, 100, 200, 500]


def location_chunks(spark):
    ids = [f"0-{i}" for i in range(13)]
    rows = [(i, c, n) for i in ids for c, n in enumerate(LENGTHS)] + [("0-91", 0, 1)]
    return spark.createDataFrame(rows, "unique_id string, chunk int, size long").withColumn("p", F.lit(0))


def test_skew_split_fixture(spark):
    got = skew_split(location_chunks(spark), ["p"], ["unique_id", "chunk"], "size", 3).groupBy("sub", "unique_id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).collect()
    found = {(r["sub"], r.unique_id): (r.a, r.b) for r in got}
    want = {(0, f"0-{i}"): (0, 4) for i in (0, 1, 10, 11)} | {(0, "0-12"): (0, 2), (1, "0-12"): (3, 4), (1, "0-5"): (0, 3), (2, "0-5"): (4, 4), (2, "0-91"): (0, 0)}
    want |= {(1, f"0-{i}"): (0, 4) for i in (2, 3, 4)} | {(2, f"0-{i}"): (0, 4) for i in (6, 7, 8, 9)}
    assert found == want


def test_skew_split_edges(spark):
    def split(sizes, subs):
        df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "p int, i int, size long")
        return [r["sub"] for r in skew_split(df, ["p"], ["i"], "size", subs).orderBy("i").collect()]

    assert split([100] * 5, 5) == [0, 1, 2, 3, 4]
    assert split([20, 10], 10) == [6, 9]
    assert split([0, 1, 1], 5) == [None, 4, 4]


def test_chunk_rules(spark):
    blocks = spark.createDataFrame([(0, i, n) for i, n in enumerate((50, 51, 49, 51))], "p int, i int, size long")
    equal = spark.createDataFrame([(0, 0, 50), (0, 1, 50)], "p int, i int, size long")
    starts = lambda df, rule: [r.begins for r in chunk_flags(df, ["p"], ["i"], "size", 100, rule).groupBy("chunk_id").agg(F.min("offset").alias("begins")).orderBy("chunk_id").collect()]
    assert starts(blocks, "disk") == starts(blocks, "memory") == [0, 101]
    assert starts(equal, "disk") == starts(equal, "memory") == [0]
    more = spark.createDataFrame([(0, i, 50) for i in range(4)], "p int, i int, size long")
    assert starts(more, "disk") == [0, 100] and starts(more, "memory") == [0, 150]


def test_slow_start_fixture(spark):
    def windows(replies, threshold):
        df = spark.createDataFrame([(0, i, c) for i, c in enumerate(replies)], "u int, i int, congested boolean")
        return [r.cwnd for r in congestion_windows(df, ["u"], ["i"], "congested", threshold).orderBy("i").collect()]

    got = windows([False] * 12 + [True] * 3, 5)
    assert [got[0], got[2], got[6], got[11], *got[12:]] == [2, 4, 5, 6, 3, 1, 1]


def test_range_validation_fixture(spark):
    def verdict(ranges):
        df = spark.createDataFrame([(0, a, b, 1, 1) for a, b in ranges], "pid int, start int, finish int, bytes long, crc long")
        return range_verdicts(df, ["pid"], 20).first().verdict

    assert verdict([(0, 10)]) == "waiting for more data"
    assert verdict([(0, 10), (5, 15)]) == "overlap"
    assert verdict([(0, 1), (2, 3), (1, 2)]) == "waiting for more data"
    assert verdict([(0, 10), (0, 5)]) == "overlap"
    assert verdict([(0, 10), (10, 20), (0, 10)]) == "complete"


GIB = 1 << 30


def test_quota_expiry_fixture(spark):
    apps = spark.createDataFrame([("t", "u", "app1", 150 * GIB, 15000, 25 * GIB, 20), ("t", "u", "app2", 50 * GIB, 5000, 5 * GIB, 20)], "tenant string, user string, app string, disk_bytes long, disk_files long, hdfs_bytes long, hdfs_files long")

    def expired(quota):
        return sorted(r.app for r in expired_apps(apps, ["tenant", "user"], quota).where("expired").collect())

    most = 1 << 62
    assert expired({"disk_bytes": 100 * GIB, "disk_files": 10000, "hdfs_bytes": 10 * GIB, "hdfs_files": most}) == ["app1"]
    assert expired({"disk_bytes": 50 * GIB}) == ["app1", "app2"]
    assert expired({"disk_bytes": 60 * GIB}) == ["app1"]


def test_sliding_rate_counts_empty_buckets(spark):
    df = spark.createDataFrame([(1, 0, 30), (1, 2, 60), (1, 9, 5)], "u int, sec long, v long")
    got = {r.sec: (r.total, r.rate) for r in sliding_rates(df, ["u"], "sec", "v", 3).collect()}
    assert got == {0: (30, 30), 2: (90, 30), 9: (5, 5)}


def test_flushes_and_giants(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate((40, 40, 40, 300, 60, 1))], "p int, i int, size long")
    got = [(r.flush_id, r.giant) for r in flushes(df, ["p"], ["i"], "size", 100).orderBy("i").collect()]
    assert got == [(0, False), (0, False), (1, False), (None, True), (1, False), (2, False)]


def test_packing_skips_empty_buffers(spark):
    df = spark.createDataFrame([(0, i, s, n) for i, (s, n) in enumerate(((0, 50), (0, 0), (0, 50), (1, 10), (0, 10)))], "m int, i int, sub int, size long")
    assert [r.buffer_id for r in packed(df, ["m"], ["i"], "sub", "size", 100, 16).orderBy("i").collect()] == [0, None, 0, 1, 2]


def test_illegal_partition_fails_the_job(spark):
    df = spark.createDataFrame([(1,), (7,)], "pid int")
    assert checked_partitions(df, "pid", 8).count() == 2
    with pytest.raises(Exception, match="Illegal partition for 7"):
        checked_partitions(df, "pid", 5).collect()


def test_columnar_eligibility():
    assert is_columnar(T.StructType.fromDDL("a int, b string, c decimal(30,2)"))
    assert not is_columnar(T.StructType.fromDDL("a int, b timestamp")) and not is_columnar(None)


def test_statistics_charge_nulls_four_bytes(spark):
    df = spark.createDataFrame([(1, "ab"), (1, None), (1, "é")], "k int, s string")
    assert tuple(column_statistics(df, "s", ["k"]).first()) == (1, "ab", "é", 1, 3, 16)


def test_location_without_bitmap_is_read(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [5]), (3, None)], "id int, maps array<int>")
    assert sorted(r.id for r in df.where(may_hold(F.col("maps"), 4, 9)).collect()) == [2, 3]


def test_tags(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "worker int, tag string")
    assert [r.worker for r in tagged(df, "a,b").collect()] == [1]
    assert sorted(r.worker for r in tagged(df, " ").collect()) == [1, 2]


def test_load_aware_shares_and_carry():
    shares = group_shares([0, 1, 2], 3, 1.0)
    assert shares == {0: 4 / 7, 1: 2 / 7, 2: 1 / 7}
    assert group_allocations(shares, {0: 10, 1: 100, 2: 100}, 70) == {0: 10, 1: 50, 2: 10}


@pytest.mark.parametrize("codec", CODECS)
def test_codec_round_trip(spark, tmp_path, codec):
    df = spark.createDataFrame([(i, f"{i:06d}" * n) for i, n in enumerate((170, 5400, 5400, 2700))], "i int, s string")
    assert sorted(round_trip(df, f"{tmp_path}/{codec}", codec).collect()) == sorted(df.collect())
