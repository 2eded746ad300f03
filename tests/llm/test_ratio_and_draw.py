"""Log-likelihood ratios, thresholds, goals and draws recomputed in plain Python; blocks of long documents."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.mixing import MISSING, SMOOTHING, bounded, goal, mix_sources, probabilities, tokens_of, topic_of
from millrace.llm.quality import BITS, KEEP_TRUSTED
from millrace.llm.quality import SMOOTHING as COUNT_SMOOTHING
from millrace.llm.quality import ngram_buckets
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.tokens import LOWER, Words

DATA = "/root/testdata/sf0.001"


def test_ratios_and_threshold_equal_plain_counts(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    grams = {i: ngram_buckets(Words([t], table=LOWER))[1].tolist() for i, t in docs.items()}
    raw, trusted = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        trusted.update(g if quality.get(i) == 1 else ())
    size = [sum(c.values()) + COUNT_SMOOTHING * (1 << BITS) for c in (trusted, raw)]
    llr = lambda g: math.log((trusted[g] + COUNT_SMOOTHING) / size[0]) - math.log((raw[g] + COUNT_SMOOTHING) / size[1])
    want = {i: sum(map(llr, g)) / len(g) if g else 0.0 for i, g in grams.items()}
    rows = queries.op7_quality_rules(spark, DATA).collect()
    assert len(rows) == len(docs) and all(abs(r.llr - want[r.doc_id]) < 1e-6 for r in rows)
    fitted = [(r.llr, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    cut = rows[0].threshold
    good = [x for x, q in fitted if q == 1]
    gain = lambda c: np.mean([x < c for x, q in fitted if q != 1]) - np.mean([x < c for x in good])
    allowed = [c for c in sorted({x for x, _ in fitted}) if np.mean([x < c for x in good]) <= 1 - KEEP_TRUSTED]
    assert np.mean([x < cut for x in good]) <= 1 - KEEP_TRUSTED and gain(cut) >= max(map(gain, allowed)) - 1e-12
    assert all(r.kept == (not r.base_failed and r.llr >= cut) for r in rows)


def test_tokens_of_white_space(spark):
    texts = ["", " ", "\n\t", "\r\n \x0b\x0c", "a", " a\tb\nc ", "a b c", None, "x " * 300_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tokens_of(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_draws_equal_the_cells_probabilities(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("__u", F.lit(1)).drop("__u")
    rows = docs.select("doc_id", F.coalesce("source", F.lit(MISSING)).alias("source"), F.coalesce("lang", F.lit(MISSING)).alias("lang"), topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n"), F.xxhash64(F.lit(7), F.col("doc_id").cast("string")).alias("h")).collect()
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += float(r.n)
    cells = dict(sorted(cells.items()))
    goals = []
    for i, axis in enumerate(("source", "lang", "topic")):
        sums = Counter()
        for c, t in cells.items():
            sums[c[i]] += t
        goals.append(goal(sums, queries.MIX_TARGETS.get(axis)))
        assert axis != "source" or all(abs(goals[0][v] / goals[0][w] - (sums[v] / sums[w]) ** SMOOTHING) < 1e-6 for v in sums for w in sums if sums[v] and sums[w])
    chance = probabilities(cells, bounded(cells, goals, queries.MIX_SHARE), queries.MIX_SHARE)
    want = {r.doc_id: round(chance[r.source, r.lang, r.topic], 9) for r in rows if ((r.h % (1 << 64)) // 2048 + 0.5) / 2.0**53 < chance[r.source, r.lang, r.topic]}
    got = {r.doc_id: r.probability for r in queries.op8_source_mixing(spark, DATA).collect()}
    assert got == want and len(want) > 20
    kept = [(c[1], p * cells[c]) for c, p in chance.items()]
    share = lambda lang: sum(x for v, x in kept if v == lang) / sum(x for _, x in kept)
    assert all(abs(share(v) - w) < 1e-3 for v, w in goals[1].items())


def test_long_documents_that_lie_together(spark, monkeypatch):
    """Blocks are cut by bytes; rows without an id are returned whole."""
    from millrace.llm import substring_dedup as module

    monkeypatch.setattr(module, "BLOCK_BYTES", (20_000, 20_000))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(2000 if 100 <= i < 110 else 5))) for i in range(400)]
    rows += [(400 + i, rows[100 + i][1]) for i in range(10)] + [(None, rows[100][1]), (None, None), (None, "")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_removed for r in got if r.n_removed} == {400 + i: 2000 for i in range(10)}
    assert sorted(r.n_words for r in got if r.doc_id is None) == [0, 0, 2000]
    mixed = mix_sources(spark.createDataFrame([(1, "\n\t", "s", "l"), (2, "a b", "s", "l")], "doc_id long, text string, source string, lang string"), 1.0).collect()
    assert {r.doc_id: r.n_tokens for r in mixed} == {1: 0, 2: 2}
