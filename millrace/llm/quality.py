"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus, per n-gram.

Two multinomials over hashed uni- and bigrams are counted, one over the trusted documents and one over all documents; a
document's score is the mean over its n-grams of log p(trusted) - log p(raw).  The threshold is the best cut over the scores of
all labelled rows, and every document is compared with it; nothing is sampled or drawn at random.

Plan.  Counting and scoring are one pass each over documents without a shuffle of text; a counting task sends at most
one row a bucket, summed in Spark to a table of fixed size.  Scores, without texts, are checkpointed, as the threshold and
the result both read them.  The labelled ids are joined by broadcast up to BROADCAST_ROWS of them and by a sort-merge join
beyond (of the counting pass with its texts).  The threshold is found by bins of llr: the driver takes one row a bin.

Defined results.  Null and empty texts have no words: all counts 0, score 0.0, base_failed true.  Label rows that
disagree count as not trusted; null labels are ignored.  Without trusted rows every score is 0.0 and the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.near_dedup import settled
from millrace.llm.tokens import LOWER, SPACE, U64, Words, pieces

BITS = 16
SMOOTHING = 0.5
BROADCAST_ROWS = 1_000_000
#: Bins of the threshold's search in a unit of llr; llr has DIGITS decimals, so a bin holds a million values at most.
BINS = 1000
DIGITS = 9
#: Share of the trusted rows that the threshold must keep.
KEEP_TRUSTED = 0.995

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every uni- and bigram of a batch."""
    pair, h2 = words.windows(2)
    row = words.doc
    bucket = np.concatenate([words.hash >> U64(64 - BITS), h2 >> U64(64 - BITS)]).astype(np.int64)
    return np.concatenate([row, row[pair]]), bucket


def base_measures(texts: list[bytes], words: Words) -> dict[str, np.ndarray]:
    """MEASURES of each text, from the unfolded bytes."""
    buf, at = words.buf, words.offset

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    lines = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        parts = t.split(b"\n")
        if len(parts) != len(set(parts)):
            parts = [p for p in parts if p.strip()]
            lines[i] = len(parts) - len(set(parts))
    first, h = words.windows(3)
    covered = np.zeros(len(words.start) + 2, dtype=bool)
    if len(h):
        key = (words.doc[first].astype(U64) << U64(54)) | (h >> U64(10))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = first[twice[near] == key]
            for j in range(3):
                covered[hit + j] = True
    repeated = np.zeros(len(covered) + 1, dtype=np.int64)
    np.cumsum(covered, out=repeated[1:])
    return {
        "n_words": words.count,
        "word_chars": per_row(~SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_row(SYMBOLS[buf]),
        "n_dup_lines": lines,
        "n_repeat_words": repeated[words.first[1:]] - repeated[words.first[:-1]],
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label row calls good, with `good` 1, and all other labelled ids with 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    return rows.dropna().groupBy("label_id").agg(F.min("quality").alias("good"))


def with_labels(docs: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    side = F.broadcast(labels) if n_labels <= BROADCAST_ROWS else labels.hint("merge")
    return docs.join(side, docs.doc_id == side.label_id, "left").drop("label_id")


def ngram_llr(docs: DataFrame, labels: DataFrame, n_labels: int) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw), over all documents and all trusted ones."""

    def count(batches):
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            good = b.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
            for begin, end, part in pieces(b.column(0), rows=1024):
                row, bucket = ngram_buckets(Words(part, table=LOWER))
                raw += np.bincount(bucket, minlength=1 << BITS)
                target += np.bincount(bucket[good[begin:end][row]], minlength=1 << BITS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counted = with_labels(docs, labels, n_labels).select("text", "good").mapInArrow(count, "bucket long, raw long, target long")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[table["bucket"].to_numpy()] = table["raw"].to_numpy()
    target[table["bucket"].to_numpy()] = table["target"].to_numpy()
    if not target.sum():
        return np.zeros(1 << BITS)
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return share(target) - share(raw)


def scored(docs: DataFrame, llr: np.ndarray) -> DataFrame:
    """doc_id, the base measures and the length-normalised log-likelihood ratio of every document."""

    def score(batches):
        for b in batches:
            for begin, end, part in pieces(b.column(1), rows=1024):
                plain = Words(part)
                measures = base_measures(part, plain)
                row, bucket = ngram_buckets(Words(part, table=LOWER))
                n = np.bincount(row, minlength=len(part))
                total = np.bincount(row, weights=llr[bucket], minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, end - begin), *(pa.array(measures[m].astype(np.int64)) for m in MEASURES), pa.array(np.round(total / np.maximum(n, 1), DIGITS))], names=["doc_id", *MEASURES, "llr"]
                )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", llr double")


def fit_threshold(rows: DataFrame) -> float:
    """The cut with the best balanced accuracy among those that keep KEEP_TRUSTED of the trusted rows, over all rows (llr, good)."""
    trusted = (F.col("good") == 1).cast("long")
    values = rows.groupBy("llr").agg(F.sum(trusted).alias("good"), F.sum(1 - trusted).alias("bad")).withColumn("bin", F.floor(F.col("llr") * BINS))
    bins = values.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("llr").alias("last")).toArrow().sort_by("bin")
    good, bad = (np.concatenate([[0], np.cumsum(bins[c].to_numpy())]).astype(np.int64) for c in ("good", "bad"))
    n_good, n_bad = int(good[-1]), int(bad[-1])
    if not n_good or not n_bad:
        return float("-inf")
    last = pa.array([None, *bins["last"].to_pylist()[:-1]], pa.float64())
    most = 1 - KEEP_TRUSTED
    below = pa.table({"bin": bins["bin"], "good_below": good[:-1], "bad_below": bad[:-1], "value_below": last}).filter(pa.array(good[:-1] / n_good <= most))
    ordered = Window.partitionBy("bin").orderBy("llr")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    cuts = values.join(F.broadcast(rows.sparkSession.createDataFrame(below)), "bin").select(
        "llr",
        F.coalesce(F.lag("llr").over(ordered), F.col("value_below")).alias("value_below"),
        ((F.col("good_below") + F.coalesce(F.sum("good").over(before), F.lit(0))) / n_good).alias("lost"),
        ((F.col("bad_below") + F.coalesce(F.sum("bad").over(before), F.lit(0))) / n_bad).alias("caught"),
    )
    best = cuts.where(F.col("lost") <= most).orderBy((F.col("caught") - F.col("lost")).desc(), "llr").first()
    return float("-inf") if best.value_below is None else (best.value_below + best.llr) / 2


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base measures, llr, threshold, base_failed and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = trusted_ids(labels)
    n_labels = known.count()
    llr = ngram_llr(docs, known, n_labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows, _ = settled(scored(docs, llr).withColumn("base_failed", failed))
    cut = fit_threshold(with_labels(rows.where(~F.col("base_failed")).select("doc_id", "llr"), known, n_labels).where(F.col("good").isNotNull()))
    return rows.withColumns({"threshold": F.lit(cut), "kept": ~F.col("base_failed") & (F.col("llr") >= F.lit(cut))})
