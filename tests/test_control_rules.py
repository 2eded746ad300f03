"""Placement, congestion, split requests, dictionaries and growing key counts on cases whose results are known."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import control
from millrace.operators.columnar import decoded, dictionary_codes
from millrace.operators.control import worker_state
from millrace.operators.push import answered_requests
from millrace.operators.slots import Rules, by_racks, placed, relaxing
from millrace.plans.catalog import ORACLE_SQL, QUERIES
from millrace.sources import tables

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.orderBy("pid").collect()]


def pids(spark, n):
    return spark.range(n).select(F.col("id").alias("pid"))


def test_slots_run_out_one_by_one(spark):
    """Three workers with one slot each hold three single copies, or one pair."""
    disks, racks, slots = {w: [0] for w in range(3)}, {w: w for w in range(3)}, {w: {0: 1} for w in range(3)}
    alone = rows(placed(pids(spark, 4), [Rules(range(3), range(3), disks, racks, slots, replicate=False)]))
    assert [r[1] for r in alone] == [None, 2, 1, 0]
    pairs = rows(placed(pids(spark, 2), [Rules(range(3), range(3), disks, racks, slots)]))
    assert pairs == [(0, None, None, None, None, None), (1, 0, 0, 1, 0, 1)]


def test_disks_take_turns_and_full_ones_are_passed_over(spark):
    rules = Rules([7], [7], {7: [0, 1, 2]}, {7: 0}, {7: {0: 2, 1: 0, 2: 1}}, replicate=False)
    assert [r[2] for r in rows(placed(pids(spark, 4), [rules]))] == [None, 0, 2, 0]


def test_copies_stand_in_different_racks_until_the_last_pass(spark):
    racks = {w: "ab"[w // 2] for w in range(4)}
    assert by_racks(range(4), racks) == [0, 2, 1, 3]
    rules = Rules(range(4), range(4), {w: [0] for w in range(4)}, racks, rack_aware=True)
    assert all(racks[r[1]] != racks[r[3]] for r in rows(placed(pids(spark, 20), [rules])))
    one_rack = dict.fromkeys(range(4), "a")
    passes = relaxing(range(4), dict.fromkeys(range(4), 0), {w: {0: 3} for w in range(4)}, one_rack)
    got = rows(placed(pids(spark, 6), passes))
    assert {r[5] for r in got} == {4} and all(r[1] != r[3] for r in got)


def test_passes_go_from_calm_workers_to_all(spark):
    racks, tier = {w: w for w in range(6)}, {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    got = rows(placed(pids(spark, 10), relaxing(range(6), tier, {w: {0: 2} for w in range(6)}, racks)))
    assert [r[5] for r in got] == [2] * 8 + [1] * 2
    assert all(r[1] in (0, 1) and r[3] in (0, 1) for r in got if r[5] == 1) and all(tier[r[1]] < 2 and tier[r[3]] == 2 for r in got if r[5] == 2)


@pytest.mark.parametrize("name", ["op92b_budgeted_slots", "op94b_relaxed_placement"])
def test_placements_of_the_tables(spark, name):
    found = QUERIES[name](spark, DATA).collect()
    slots = {(r.worker, r.disk): r.slots for r in tables.disks(spark, DATA).where("usable").collect()}
    used = {}
    for r in found:
        if r.primary_worker is None:
            continue
        assert r.primary_worker != r.replica_worker
        for at in ((r.primary_worker, r.primary_disk), (r.replica_worker, r.replica_disk)):
            used[at] = used.get(at, 0) + 1
    if name == "op92b_budgeted_slots":
        assert all(n <= slots[at] for at, n in used.items()) and 0 < sum(used.values()) <= sum(slots.values())
        first_free = min(r.pid for r in found if r.primary_worker is not None)
        assert all((r.primary_worker is None) == (r.pid < first_free) for r in found)
    else:
        assert all(r.primary_worker is not None for r in found) and len({r["pass"] for r in found}) > 1


def test_worker_congestion_has_hysteresis(spark, monkeypatch):
    monkeypatch.setattr(control, "WORKER_MARKS", (1000, 500))
    monkeypatch.setattr(control, "PENDING_MARKS", (100, 50))
    hours = [(0, 1, 10, 0), (1, 1, 10, 101), (2, 2, 10, 60), (3, 1, 10, 50), (4, 1, 10, 49), (5, 1, 2000, 0), (6, 1, 600, 0), (7, 1, 400, 10)]
    events = spark.createDataFrame(hours, "hour long, user long, bytes long, pending long")
    got = sorted((r.hour, r.mean, r.over) for r in worker_state(events, "hour", "user", "bytes", F.col("pending"), 1).collect())
    assert [o for *_, o in got] == [False, True, True, True, False, True, True, False]
    assert [m for _, m, _ in got] == [10, 10, 5, 5, 5, 1000, 300, 200]


def test_requests_join_open_or_are_answered(spark):
    asked = [(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1), (5, 3, 5), (6, 2, 6)]
    df = spark.createDataFrame([(1, *x) for x in asked], "pid int, i int, epoch int, tick int")
    got = [(r.outcome, r.answer) for r in answered_requests(df, ["pid"], ["i"], "epoch", "tick").orderBy("i").collect()]
    assert got == [("opened", 1), ("joined", 1), ("known", 1), ("opened", 2), ("joined", 2), ("opened", 3), ("known", 3)]


def test_overflowed_dictionaries_keep_all_rows(spark):
    df = spark.createDataFrame([(k, i, i % (1000 if k else 10)) for k in range(2) for i in range(1000)], "k int, p int, v long")
    coded = dictionary_codes(df, ["k"], "v", "p", 300)
    assert coded.where("overflow").count() == 1000
    assert sorted(map(tuple, decoded(coded, ["k"], "v").select("k", "p", "v").collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["op17_sorted_runs", "op20_ordered_output", "op21_sort_buffer", "op23_map_output_sizes", "op25_merged_requests", "op37_stage_complete", "op51_exactly_once", "op72_segment_read"])
def test_keys_grow_with_the_records(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "ROWS_A_MAP", 150)
    monkeypatch.setattr(tables, "ROWS_A_PARTITION", 300)
    maps, partitions = tables.key_counts(spark, DATA)
    assert maps > 16 and partitions > 8
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql = ORACLE_SQL[name].replace("499999) // 500000", "149) // 150").replace("999999) // 1000000", "299) // 300")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, DATA)
    want = sorted(tuple(str(r[names.index(c)]).lower() for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(str(r[c]).lower() for c in sorted(names)) for r in df.collect()) == want


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None), (3, 'q"x', -2.0)], "id long, name string, value double")
    want, schema = sorted(map(str, df.collect())), "id long, name string, value double"
    df.write.option("header", True).csv(f"{tmp_path}/c", escape='"')
    df.write.json(f"{tmp_path}/j")
    df.write.orc(f"{tmp_path}/o")
    assert sorted(map(str, tables.read_csv(spark, f"{tmp_path}/c", schema, escape='"').collect())) == want
    assert sorted(map(str, tables.read_json(spark, f"{tmp_path}/j", schema).collect())) == want
    assert sorted(map(str, tables.read_orc(spark, f"{tmp_path}/o").collect())) == want
