"""Components of near duplicates: ids with several sets, template pages, and the prefix filter against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.near_dedup import near_duplicates, prefixes

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))


def test_rows_of_one_id_are_one_node(spark):
    rows = [(2, B), (3, B), (3, A), (7, A), (8, "other words stand here and there"), (9, None), (None, A), (9, "")]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(2, 2, True), (3, 2, False), (3, 2, False), (7, 2, False), (8, 8, True), (9, 9, True), (9, 9, True), (None, 2, False)], key=str)


def linked(spark, sets, least=80):
    rows = [(i, i, True, np.sort(np.array(sorted(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tobytes()) for i, s in enumerate(sets)]
    found = prefixes(spark.createDataFrame(rows, "id long, component long, minor boolean, elements binary"), least).collect()
    assert all(r.component == r.id and r.minor for r in found)
    probe, index, size = {}, {}, {}
    for r in found:
        size[r.id] = r.n
        probe.setdefault(r.id, set()).add(r.shingle)
        if r["index"]:
            index.setdefault(r.id, set()).add(r.shingle)
    return {(min(x, y), max(x, y)) for x in probe for y in probe if (size[x], x) > (size[y], y) and probe[x] & index[y]}


def test_prefixes_lose_no_link(spark):
    draw = random.Random(4)
    sets = []
    for _ in range(12):
        base = draw.sample(range(3000), draw.randrange(1, 60))
        for _ in range(10):
            sets.append({draw.randrange(3000) if draw.random() < 0.05 else x for x in base[: draw.randrange(len(base) * 7 // 8, len(base) + 1) or 1]})
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 100 * len(x & y) >= 80 * len(x | y)}
    assert len(want) > 50 and want <= linked(spark, sets)


def test_pages_of_one_template_meet_in_no_pair(spark):
    sets = [set(range(200)) | {1000 + 50 * i + j for j in range(50)} for i in range(300)]
    assert linked(spark, sets) == set()
    common = " ".join(f"menu{i}" for i in range(200))
    rows = [(i, common + " " + " ".join(f"own{i}x{j}" for j in range(50))) for i in range(400)] + [(1000 + i, common + " " + " ".join(f"own{i}x{j}" for j in range(i, 50))) for i in range(4)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.where("not kept").collect()} == {1000 + i: i for i in range(4)}
    assert got.where(F.col("kept")).count() == 400
