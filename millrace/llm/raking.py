"""Raking of very many cells, as DataFrames: the result of mixing.bounded and mixing.probabilities without a driver's table.

A cell's probability is min(1, product of a factor of each of its three values).  A round takes the axes in turn; one
aggregation by value gives what the value's cells hold at full and at less, and its factor moves by a Newton step to its goal
(what is held is concave in the factor, so steps after the first come from below and end on it).  The rounds stop when no
value is off its goal.  Where all goals can be met together the solution is unique, so both forms agree; where they can't, the axes
pull against each other, the rounds end without meeting them, which is logged, and the two forms may end at different
probabilities (apart by 0.08 for a cell in one case whose goals were missed by 0.02).
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.near_dedup import ROWS_A_PART, checkpoint_folder, settled

ROUNDS, TOLERANCE, MOST = 200, 1e-6, 1e12
#: A round that gets no closer than this share of the last one's distance ends the raking: the goals can't all be met.
STALLED, PATIENCE = 0.999, 5
LOG = logging.getLogger(__name__)


def listed(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of driver-side rows without Python workers."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def goals(sums: DataFrame, targets: dict[str, float] | None, power: float) -> DataFrame:
    """v, most and goal of each value of sums (v, most): its target, and for the others what is left by most to the power."""
    table = listed(sums.sparkSession, [{"v": v, "target": float(s)} for v, s in (targets or {}).items()], "v:string,target:double")
    known = sums.join(F.broadcast(table), "v", "left").withColumn("pull", F.when(F.col("target").isNull() & (F.col("most") > 0), F.pow("most", F.lit(power))).otherwise(0.0))
    named, pull = known.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("pull"), F.lit(0.0))).first()
    left = max(0.0, 1 - named) if pull else 0.0
    whole = (named + left) or 1.0
    return known.select("v", "most", (F.coalesce(F.col("target"), F.lit(left / pull if pull else 0.0) * F.col("pull")) / whole).alias("goal"))


def wants(axis: DataFrame, budget: float) -> DataFrame:
    """v and want: each value's goal of the budget, or all it has; what it lacks goes to the others in proportion."""
    cut = 0.0  # values whose most / goal is under it are full
    full = (F.col("goal") > 0) & (F.col("most") < F.lit(cut) * F.col("goal"))
    while True:
        held, open_goal, tightest = axis.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("goal"))), F.lit(0.0)), F.min(F.when(~full & (F.col("goal") > 0), F.col("most") / F.col("goal")))).first()
        scale = max(0.0, (budget - held) / open_goal) if open_goal > 0 else 0.0
        if tightest is None or tightest >= scale:
            return axis.select("v", F.when(full, F.col("most")).otherwise(F.col("goal") * scale).alias("want"))
        cut = scale
        full = (F.col("goal") > 0) & (F.col("most") < F.lit(cut) * F.col("goal"))


def written(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows at most, written to the shared folder and read again: a checkpoint would hand on the size estimates and constraints of all rounds before, which double with each."""
    path = f"{checkpoint_folder(df.sparkSession)}/raking-{uuid.uuid4().hex}"
    df.coalesce(max(1, -(-n // ROWS_A_PART))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raked_cells(cells: DataFrame, keys: list[str], targets: list[dict[str, float] | None], share: float, power: float) -> DataFrame:
    """keys and __p, the probability of a document, of every cell (keys, tokens)."""
    cells, n = settled(cells.select(*keys, F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    budget = share * total
    if budget <= 0:
        return cells.select(*keys, F.lit(float(share)).alias("__p"))
    wanted = []
    for key, target in zip(keys, targets):
        axis, _ = settled(goals(cells.groupBy(F.col(key).alias("v")).agg(F.sum("tokens").alias("most")), target, power))
        wanted.append(written(wants(axis, budget).withColumn("f", F.lit(1.0)), n))
    nearest, stale = float("inf"), 0
    for _ in range(ROUNDS):
        off = 0.0
        for i, key in enumerate(keys):
            rest = cells
            for j, other in enumerate(keys):
                if j != i:
                    rest = rest.join(wanted[j].select(F.col("v").alias(other), F.col("f").alias(f"f{j}")), other)
            rest = rest.select(F.col(key).alias("v"), "tokens", F.expr(" * ".join(f"f{j}" for j in range(len(keys)) if j != i)).alias("r"))
            at = rest.join(wanted[i].select("v", "f"), "v").withColumn("x", F.col("r") * F.col("f"))
            held = at.groupBy("v").agg(
                F.sum(F.when(F.col("x") >= 1, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(F.col("x") < 1, F.col("tokens") * F.col("r")).otherwise(0.0)).alias("loose"),
                F.max(F.when(F.col("tokens") > 0, F.col("r"))).alias("top"),
            )
            have = F.col("full") + F.col("loose") * F.col("f")
            newton = (F.col("want") - F.col("full")) / F.col("loose")
            # where the full cells alone pass the goal, back in proportion from the least factor that keeps the fullest one full
            back = F.least(F.col("f"), 1 / F.col("top")) * F.col("want") / have
            moved = F.when(F.col("want") <= 0, 0.0).when((F.col("loose") > 0) & (F.col("want") > F.col("full")), newton).when((have > F.col("want")) & (F.col("top") > 0), back).otherwise(F.col("f"))
            step = written(wanted[i].join(held, "v").select("v", "want", F.least(moved, F.lit(MOST)).alias("f"), F.abs(have - F.col("want")).alias("off")), n)
            off = max(off, (step.agg(F.max("off")).first()[0] or 0.0) / budget)
            wanted[i] = step.select("v", "want", "f")
        if off < TOLERANCE:
            break
        stale = stale + 1 if off > STALLED * nearest else 0
        nearest = min(nearest, off)
        if stale >= PATIENCE:
            break
    if off >= TOLERANCE:
        LOG.warning("raking stopped %.2e off its goals", off)
    held = cells
    for j, key in enumerate(keys):
        held = held.join(wanted[j].select(F.col("v").alias(key), F.col("f").alias(f"f{j}")), key)
    held, _ = settled(held.select(*keys, "tokens", F.least(F.lit(1.0), F.expr(" * ".join(f"f{j}" for j in range(len(keys))))).alias("x")))
    cut = 1.0  # cells over it are full once the whole is scaled to the budget
    while True:
        over = (F.col("tokens") > 0) & (F.col("x") > cut)
        full, loose, top = held.agg(F.sum(F.when(over, F.col("tokens")).otherwise(0.0)), F.sum(F.when(~over, F.col("tokens") * F.col("x")).otherwise(0.0)), F.max(F.when(~over & (F.col("tokens") > 0), F.col("x")))).first()
        scale = max(0.0, budget - full) / loose if loose > 0 else 0.0
        if top is None or top * scale <= 1 + 1e-12:
            break
        cut = 1 / scale
    chance = F.when(F.col("tokens") <= 0, F.lit(float(share))).when(over, 1.0).otherwise(F.least(F.lit(1.0), F.col("x") * scale))
    return held.select(*keys, chance.alias("__p"))
