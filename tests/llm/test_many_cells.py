"""Raking more cells than the driver takes: the same probabilities, as a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, raking
from millrace.llm.mixing import KEYS, SMOOTHING, bounded, goal, mix_sources, probabilities
from millrace.llm.raking import raked_cells

SHAPE = "__0 string, __1 string, __2 string, tokens long"


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    monkeypatch.setattr(raking, "TOLERANCE", 1e-4)


def both(spark, cells, targets, share):
    goals = []
    for i, wanted in enumerate(targets):
        sums = {}
        for c, t in cells.items():
            sums[c[i]] = sums.get(c[i], 0.0) + t
        goals.append(goal(sums, wanted))
    want = probabilities({c: float(t) for c, t in cells.items()}, bounded({c: float(t) for c, t in cells.items()}, goals, share), share)
    table = spark.createDataFrame([(*c, t) for c, t in cells.items()], SHAPE)
    return want, {tuple(r)[:3]: r["__p"] for r in raked_cells(table, KEYS, targets, share, SMOOTHING).collect()}


def test_a_table_of_cells_is_raked_as_on_the_driver(spark):
    # goals that can be met together, with cells at their bound; where they can't, the two forms are only both logged
    rng = np.random.default_rng(3)
    cells = {(a, b, c): int(rng.integers(0, 30)) ** 3 for a in "pqrst" for b in "xyz" for c in "mn"} | {("t", "z", "n"): 0}
    want, got = both(spark, cells, [None, {"x": 0.45, "absent": 0.2}, {"m": 0.5}], 0.5)
    assert want.keys() == got.keys() and any(p == 1 for p in want.values()) and 0 in cells.values()
    assert max(abs(want[c] - got[c]) for c in want) < 1e-3


def test_a_goal_over_its_tokens_takes_all_of_them(spark):
    want, got = both(spark, {("p", "x", "m"): 100, ("q", "x", "m"): 900, ("r", "x", "m"): 0}, [{"p": 0.5, "q": 0.5}, None, None], 0.5)
    assert want["p", "x", "m"] == 1 and max(abs(want[c] - got[c]) for c in want) < 1e-3


def test_many_cells_give_the_same_sample(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))
    few = {r.doc_id: r.probability for r in mix_sources(docs, 0.4, {"lang": {"l0": 0.5}}).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    many = {r.doc_id: r.probability for r in mix_sources(docs, 0.4, {"lang": {"l0": 0.5}}).collect()}
    assert few.keys() == many.keys() and max(abs(few[i] - many[i]) for i in few) < 1e-3


def test_no_cells_and_no_tokens(spark):
    assert raked_cells(spark.createDataFrame([], SHAPE), KEYS, [None] * 3, 0.5, SMOOTHING).count() == 0
    assert [r["__p"] for r in raked_cells(spark.createDataFrame([("a", "b", "c", 0)], SHAPE), KEYS, [None] * 3, 0.5, SMOOTHING).collect()] == [0.5]
