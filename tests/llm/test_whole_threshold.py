"""The quality threshold over all labelled rows, against a plain search of every cut."""

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality


def best(llr, good):
    """The first cut with the most junk caught less trusted lost, of those that lose few enough; each lies half way between two values."""
    llr, good = np.asarray(llr, float), np.asarray(good) == 1
    if not good.any() or good.all():
        return float("-inf")
    values, at = np.unique(llr, return_inverse=True)
    below = [np.concatenate([[0], np.cumsum(np.bincount(at, flag, len(values)))[:-1]]) for flag in (good, ~good)]
    lost, caught = below[0] / good.sum(), below[1] / (~good).sum()
    i = int(np.argmax(np.where(lost <= 1 - quality.KEEP_TRUSTED, caught - lost, -1.0)))
    return float("-inf") if i == 0 else (values[i - 1] + values[i]) / 2


@pytest.mark.parametrize("broadcast_rows", [quality.BROADCAST_ROWS, 0])
def test_threshold_is_fitted_on_every_labelled_row(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(5)
    n = 24_000
    good = (rng.random(n) < 0.8).astype(int)
    plain = rng.random((n, 60)) < rng.beta(2, 2, n)[:, None] * 0.5 + 0.45 * good[:, None]
    drawn = np.where(plain, rng.integers(0, 300, (n, 60)), rng.integers(200, 500, (n, 60)))
    texts = [" ".join(f"w{x}" for x in row) for row in drawn.tolist()]
    docs = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "text": texts})).repartition(8)
    labels = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "quality": good}))
    rows = quality.quality_rules(docs, labels).select("doc_id", "llr", "threshold", "base_failed", "kept").toPandas()
    assert len(rows) == n and not rows.base_failed.any()
    want = best(rows.llr, good[rows.doc_id])
    assert np.isfinite(want) and set(rows.threshold) == {want}
    assert (rows.kept == (rows.llr >= want)).all()


@pytest.mark.parametrize("case", ["none", "trusted only", "junk only", "one value", "apart", "mixed", "upside down", "ties", "far apart"])
def test_threshold_equals_a_search_of_every_cut(spark, case):
    rng = np.random.default_rng(len(case))
    g = (rng.random(3000) < 0.7).astype(int)
    llr, good = {
        "none": ([], []),
        "trusted only": ([0.1, 0.2], [1, 1]),
        "junk only": ([0.1, 0.2], [0, 0]),
        "one value": ([0.0, -0.0, 0.0], [1, 0, 1]),
        "apart": ([-3.25, -3.2491, 4.5, 4.5], [0, 0, 1, 1]),
        "mixed": (np.round(rng.normal(g * 2, 1), 9), g),
        "upside down": (np.round(rng.normal(-g * 2, 0.1), 9), g),
        "ties": (np.round(rng.normal(g * 2, 1), 2), g),
        "far apart": (np.round(rng.normal(g * 0.0009, 0.0003), 9), g),
    }[case]
    rows = pa.table({"llr": pa.array(llr, pa.float64()), "good": pa.array(good, pa.int32())})
    assert quality.fit_threshold(spark.createDataFrame(rows).repartition(4)) == best(llr, good)
