"""Raking with no cell over its own tokens."""

import numpy as np

from millrace.llm.mixing import bounded, goal, probabilities, shortfalls


def sums(cells, i):
    out = {}
    for c, t in cells.items():
        out[c[i]] = out.get(c[i], 0.0) + t
    return out


def test_marginals_hold_where_cells_are_full():
    rng = np.random.default_rng(8)
    cells = {(a, b, c): float(rng.integers(1, 30) ** 3) for a in "pqrstu" for b in "xyz" for c in "mno"}
    goals = [goal(sums(cells, i), w) for i, w in enumerate((None, {"x": 0.45}, {"m": 0.5}))]
    chance = probabilities(cells, bounded(cells, goals, 0.5), 0.5)
    print("FULL", sum(p >= 1 for p in chance.values()), len(chance), shortfalls(cells, goals, chance))
    assert shortfalls(cells, goals, chance) == [] and any(p >= 1 for p in chance.values())
    assert abs(sum(chance[c] * t for c, t in cells.items()) - 0.5 * sum(cells.values())) < 1e-6 * sum(cells.values())


def test_targets_out_of_reach_are_reported():
    cells = {("p", "x", "m"): 100.0, ("q", "x", "m"): 900.0, ("q", "y", "m"): 0.0}
    goals = [{"p": 0.5, "q": 0.5}, {"x": 1.0, "y": 0.0}, {"m": 1.0}]
    chance = probabilities(cells, bounded(cells, goals, 0.5), 0.5)
    assert chance["p", "x", "m"] == 1.0 and abs(chance["q", "x", "m"] - 400 / 900) < 1e-9
    assert [(a, v, w, round(e, 6)) for a, v, w, e in shortfalls(cells, goals, chance)] == [("source", "p", 0.5, 0.2), ("source", "q", 0.5, 0.8)]
