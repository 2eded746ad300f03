"""Mixing sources to target weights: iterative proportional fitting, then Poisson sampling by calibrated probabilities.

Token counts are summed by cell (source, language, topic); the cells' weights are raked until their marginals over each of
the three attributes meet the targets at `share` of the corpus with no cell over its own tokens; each document is kept with
the probability of its cell's raked weight over the cell's tokens.  Targets that can't be met at that share are logged with
the expected share (shortfalls).

Plan.  DataFrame functions only: one aggregation with map-side combining, one pass that joins each row to its cell.  The
cells are attribute combinations and not data; up to MAX_CELLS of them are raked on the driver and broadcast, more are raked
as a table (raking) and joined by shuffle.  A document's draw is a hash of its id, so reruns, retries and copies of a row
agree.

Defined results.  Null attributes form a value of their own; null or empty text has no tokens and is kept as its cell is;
a null id draws by its text.  Targets name values and shares; values without a target share what is left by their tokens
to the power of SMOOTHING.  Values with a target but no documents are left out and the rest scaled up.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.llm.raking import listed, raked_cells

#: Cells that are raked on the driver and broadcast, about 60 bytes each.
MAX_CELLS = 200_000
ROUNDS, TOLERANCE = 100, 1e-9
#: Rounds of raking under the bound, and the largest factor of a value.
BOUNDED_ROUNDS, MOST = 2000, 1e12
#: Misses of a goal, as shares of the sample, that are reported.
SHORT = 1e-4
SMOOTHING = 0.7
MISSING = "(none)"
AXES = ("source", "lang", "topic")
KEYS = ["__0", "__1", "__2"]
LOG = logging.getLogger(__name__)


def topic_of(text: Column) -> Column:
    """Stand-in for the topic of a document without a topic column, by its form: table, shout, symbols, records or prose."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    signs = n - F.length(F.regexp_replace(text, r"[#$%&*]+", ""))
    bars = n - F.length(F.replace(text, F.lit(" | "), F.lit("")))
    shouts = n - F.length(F.replace(text, F.lit("!!"), F.lit("")))
    digits = n - F.length(F.regexp_replace(text, r"[0-9]+", ""))
    return F.when(bars * 20 > n, "table").when(shouts * 20 > n, "shout").when(signs * 20 > n, "symbols").when(digits * 20 > n, "records").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(F.lit(0)).cast("long")


def goal(axis: dict[str, float], wanted: dict[str, float] | None) -> dict[str, float]:
    """Target share of each value: as wanted, and the rest by tokens to the power of SMOOTHING."""
    wanted = {v: s for v, s in (wanted or {}).items() if v in axis}
    rest = {v: t**SMOOTHING for v, t in axis.items() if v not in wanted and t > 0}
    left = max(0.0, 1 - sum(wanted.values())) if rest else 0.0
    out = {**{v: 0.0 for v in axis}, **wanted, **{v: left * t / sum(rest.values()) for v, t in rest.items()}}
    total = sum(out.values())
    return {v: s / total for v, s in out.items()} if total else out


def raked(cells: dict[tuple[str, ...], float], goals: list[dict[str, float]]) -> dict[tuple[str, ...], float]:
    """Iterative proportional fitting of the cells' weights to the goals' marginals."""
    whole = sum(cells.values())
    weight = {c: t / whole for c, t in cells.items()} if whole else dict(cells)
    for _ in range(ROUNDS):
        off = 0.0
        for i, wanted in enumerate(goals):
            have = dict.fromkeys(wanted, 0.0)
            for c, w in weight.items():
                have[c[i]] += w
            off = max(off, *(abs(have[v] - wanted[v]) for v in wanted), 0.0)
            factor = {v: wanted[v] / have[v] if have[v] > 0 else 0.0 for v in wanted}
            weight = {c: w * factor[c[i]] for c, w in weight.items()}
        if off < TOLERANCE:
            return weight
    LOG.warning("raking stopped after %s rounds, %.2e off its goals", ROUNDS, off)
    return weight


def probabilities(cells: dict[tuple[str, ...], float], weight: dict[tuple[str, ...], float], share: float) -> dict[tuple[str, ...], float]:
    """Probability of a document of each cell: min(1, scale * weight / tokens), with expected tokens of `share` of all."""
    budget = share * sum(cells.values())
    full: set[tuple[str, ...]] = set()
    while True:
        open_weight = sum(w for c, w in weight.items() if c not in full)
        left = budget - sum(cells[c] for c in full)
        scale = left / open_weight if open_weight > 0 else 0.0
        over = {c for c, w in weight.items() if c not in full and cells[c] > 0 and scale * w > cells[c]}
        if not over:
            return {c: 1.0 if c in full else (min(1.0, max(0.0, scale * w / cells[c])) if cells[c] > 0 else share) for c, w in weight.items()}
        full |= over


def bounded(cells: dict[tuple[str, ...], float], goals: list[dict[str, float]], share: float) -> dict[tuple[str, ...], float]:
    """Weights raked to the goals' marginals at `share` of all tokens, with no cell over its own tokens.

    A cell's tokens times min(1, product of a factor of each of its values): the closest sample to the corpus that meets the
    goals.  A goal over a value's own tokens takes these and leaves the rest to the axis's other values.
    """
    names, tokens = list(cells), np.array(list(cells.values()))
    budget = share * float(tokens.sum())
    if budget <= 0:
        return raked(cells, goals)
    places, wanted = [], []
    for i, axis in enumerate(goals):
        order = {v: j for j, v in enumerate(axis)}
        at = np.array([order[c[i]] for c in names])
        goal_of = np.array(list(axis.values()))
        places.append(at)
        wanted.append(capped(goal_of, np.bincount(at, tokens, len(goal_of)), budget))
    factor = [np.ones(len(w)) for w in wanted]
    for _ in range(BOUNDED_ROUNDS):
        off = 0.0
        for i, (at, want) in enumerate(zip(places, wanted)):
            rest = np.prod([f[p] for j, (f, p) in enumerate(zip(factor, places)) if j != i], axis=0)
            have = np.bincount(at, tokens * np.minimum(1.0, rest * factor[i][at]), len(want))
            off = max(off, float(np.abs(have - want).max()) / budget)
            full = np.zeros(len(names), dtype=bool)
            while True:
                loose = np.bincount(at, np.where(full, 0.0, tokens * rest), len(want))
                left = np.maximum(want - np.bincount(at, np.where(full, tokens, 0.0), len(want)), 0.0)
                f = np.where(loose > 0, left / np.where(loose > 0, loose, 1.0), MOST)
                over = ~full & (tokens > 0) & (rest * f[at] > 1.0)
                if not over.any():
                    break
                full |= over
            # where all cells of a value are full, the least factor that keeps them so
            tight = np.full(len(want), 0.0)
            np.maximum.at(tight, at[full], 1.0 / np.maximum(rest[full], 1.0 / MOST))
            factor[i] = np.minimum(np.where(loose > 0, f, np.maximum(tight, np.where(want > 0, 1.0, 0.0))), MOST)
        if off < TOLERANCE:
            break
    else:
        LOG.warning("raking stopped after %s rounds, %.2e off its goals", BOUNDED_ROUNDS, off)
    kept = tokens * np.minimum(1.0, np.prod([f[p] for f, p in zip(factor, places)], axis=0))
    return dict(zip(names, (kept / budget).tolist()))


def capped(goal_of: np.ndarray, most: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each value: its goal, or all it has; what it lacks goes to the others in proportion to their goals."""
    full = np.zeros(len(goal_of), dtype=bool)
    while True:
        open_goal = float(goal_of[~full].sum())
        scale = (budget - float(most[full].sum())) / open_goal if open_goal > 0 else 0.0
        over = ~full & (goal_of * scale > most)
        if not over.any():
            return np.where(full, most, goal_of * max(scale, 0.0))
        full |= over


def shortfalls(cells: dict[tuple[str, ...], float], goals: list[dict[str, float]], chance: dict[tuple[str, ...], float]) -> list[tuple[str, str, float, float]]:
    """(axis, value, goal, expected share) of the values whose expected share of the sample misses the goal by over SHORT."""
    total = sum(chance[c] * t for c, t in cells.items())
    out = []
    for i, (axis, wanted) in enumerate(zip(AXES, goals)):
        have = dict.fromkeys(wanted, 0.0)
        for c, t in cells.items():
            have[c[i]] += chance[c] * t
        out += [(axis, v, wanted[v], have[v] / total) for v in wanted if total and abs(have[v] / total - wanted[v]) > SHORT]
    return out


def listed_chances(spark: SparkSession, rows: list[Row], targets: dict[str, dict[str, float]], share: float) -> DataFrame:
    """The cells rows (KEYS, tokens) with the probability __p of a document of each, raked on the driver."""
    cells = {(r[0], r[1], r[2]): float(r.tokens or 0) for r in sorted(rows, key=lambda r: (r[0], r[1], r[2]))}
    goals = []
    for i, axis in enumerate(AXES):
        sums: dict[str, float] = {}
        for c, t in cells.items():
            sums[c[i]] = sums.get(c[i], 0.0) + t
        goals.append(goal(sums, targets.get(axis)))
    chance = probabilities(cells, bounded(cells, goals, share), share) if cells else {}
    for axis, value, wanted, expected in shortfalls(cells, goals, chance):
        LOG.warning("target of %s %s can't be met at share %s: %.6f wanted, %.6f expected", axis, value, share, wanted, expected)
    return listed(spark, [{**dict(zip(KEYS, c)), "__p": p} for c, p in chance.items()], "__0:string,__1:string,__2:string,__p:double")


def mix_sources(docs: DataFrame, share: float = 0.5, targets: dict[str, dict[str, float]] | None = None, seed: int = 7) -> DataFrame:
    """The sampled documents, with n_tokens, topic, probability and weight (1 / probability) added."""
    targets = targets or {}
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text").cast("string"))
    cell = [F.coalesce(F.col("source").cast("string"), F.lit(MISSING)).alias("__0"), F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)).alias("__1"), F.coalesce(topic, F.lit(MISSING)).alias("__2")]
    extra = ("n_tokens", "probability", "weight", "topic")
    marked = docs.select("*", *cell, tokens_of(F.col("text").cast("string")).alias("__n"))
    summed = marked.groupBy(*KEYS).agg(F.sum("__n").alias("tokens"))
    rows = summed.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        table = raked_cells(summed, KEYS, [targets.get(axis) for axis in AXES], share, SMOOTHING).hint("merge")
    else:
        table = F.broadcast(listed_chances(docs.sparkSession, rows, targets, share))
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("text").cast("string"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    uniform = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / float(1 << 53)
    kept = marked.join(table, KEYS).where(uniform < F.col("__p"))
    plain = [c for c in docs.columns if c not in extra]
    return kept.select(*plain, F.col("__2").alias("topic"), F.col("__n").alias("n_tokens"), F.round("__p", 9).alias("probability"), F.round(1 / F.col("__p"), 9).alias("weight"))
