"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features per text: densities of a lexicon of words and one of word stems, nearness of a second-person word to a lexicon
word, capitals, punctuation, symbols, digits, obfuscation (letters mixed with digits or signs, lexicon words that appear
only once such signs are read as letters, drawn-out letters) and length.  Both lexicons are learned from the training
sample as terms far commoner in toxic rows; a row's training features come from lexicons learned without its fold, so the
trees see hits as rare as unseen text will have them, and the calibration is fitted on out-of-fold margins.

Plan.  Training rows are a bounded sample of the labelled rows (SAMPLE_ROWS, those with the least hash of doc_id) joined
by broadcast of their ids; lexicon counts are summed in Spark, and what reaches the driver is bounded by LEXICON_TERMS
and the sample.  Scoring is one pass over all documents without a shuffle.  Only the text enters a score.

Defined results.  Null and empty texts have all-zero features and the score that the model gives those.  Label rows that
disagree count as toxic; null labels are ignored.  With no labels of one class every score is the share of toxic rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.boosting import Booster, boost, isotonic
from millrace.llm.tokens import LOWER, SPACE, U64, Words, mix, pieces

SAMPLE_ROWS = 12_000
FOLDS = 3
LEXICON_TERMS = 4_000
#: A term enters a lexicon with this many toxic rows and this log-odds.
MIN_TOXIC, MIN_ODDS = 3, 2.0
STEMS = range(4, 10)
THRESHOLD = 0.7

#: Words of address in the four languages of the tables (fixed values).
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer eure sie ihnen tú ti tuyo usted ustedes vosotros os vuestro".split()
LETTERS = ~np.isin(np.arange(256), [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
LEET = LOWER.copy()
for sign, letter in zip(b"0134579@$!|", b"oieastgasil"):
    LEET[sign] = letter
PUNCTUATION = np.isin(np.arange(256), list(b".,;:?!'\"()-"))
SYMBOL = np.isin(np.arange(256), list(b"#$%&*@^~_+=<>|\\/"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
N_FEATURES = 20


def folded(texts: list[bytes], table: np.ndarray) -> Words:
    """Letter runs of the texts, lower-cased also beyond ASCII (U+00C0 to U+00DE)."""
    words = Words(texts, separators=SPACE, table=table)
    buf = words.buf
    late = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    buf[late] += 0x20
    gap = LETTERS[buf]
    inside = np.concatenate([[False], ~gap])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    words.start, words.end = edges[::2], edges[1::2]
    words.first = np.searchsorted(words.start, words.offset)
    words.count = np.diff(words.first)
    return words


def terms(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of the whole words and of their stems of each length in bytes."""
    length = words.end - words.start
    whole = np.flatnonzero(length >= 3)
    out = [(whole, mix(words.range_hash(words.start[whole], words.end[whole]) ^ U64(0x5851F42D4C957F2D)))]
    for n in STEMS:
        at = np.flatnonzero(length > n)
        out.append((at, words.range_hash(words.start[at], words.start[at] + n)))
    return out


class Lexicon:
    """Hashed terms with weights; most words are dismissed by a bitmap before the sorted table is searched."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.bitmap = np.zeros(1 << 18, dtype=bool)
        self.bitmap[(hashes >> U64(46)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.bitmap[(h >> U64(46)).astype(np.int64)])
        if not len(maybe):
            return maybe, np.empty(0)
        near = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        right = self.hashes[near] == h[maybe]
        return maybe[right], self.weights[near[right]]


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """Dense features of a batch of texts."""
    n = len(texts)
    words = folded(texts, LOWER)
    row, count = words.doc, words.count
    size = np.maximum(np.diff(words.offset) - 1, 1)
    per_word = 1 / np.maximum(count, 1)
    x = np.zeros((n, N_FEATURES))
    weight = [np.zeros(len(row)), np.zeros(len(row))]
    for i, (at, h) in enumerate(terms(words)):
        hit, w = lexicon.hits(h)
        which = weight[min(i, 1)]
        np.maximum.at(which, at[hit], w)
    either = np.maximum(*weight)
    for j, w in enumerate((*weight, either)):
        total = np.bincount(row, w, n)
        hits = np.bincount(row, w > 0, n)
        x[:, 3 * j], x[:, 3 * j + 1], x[:, 3 * j + 2] = total * per_word, np.log1p(hits), np.log1p(total)
    top = np.zeros(n)
    np.maximum.at(top, row, either)
    x[:, 9] = top
    pronoun = np.isin(words.hash, PRONOUNS)
    x[:, 10] = np.bincount(row, pronoun, n) * per_word
    hit_at, pronoun_at = np.flatnonzero(either > 0), np.flatnonzero(pronoun)
    if len(hit_at) and len(pronoun_at):
        near = np.searchsorted(pronoun_at, hit_at)
        gap = np.full(len(hit_at), np.inf)
        for side in (near - 1, near):
            other = pronoun_at[np.clip(side, 0, len(pronoun_at) - 1)]
            gap = np.minimum(gap, np.where(row[other] == row[hit_at], np.abs(other - hit_at), np.inf))
        np.maximum.at(x[:, 11], row[hit_at], 1 / (1 + gap))
    raw = np.frombuffer(words.raw, dtype=np.uint8)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[words.offset[1:]] - sums[words.offset[:-1]]) / size

    x[:, 12] = share((raw >= 65) & (raw <= 90))
    x[:, 13] = share(raw == ord("!"))
    x[:, 14] = share(PUNCTUATION[raw])
    x[:, 15] = share(SYMBOL[raw])
    x[:, 16] = share(DIGIT[raw])
    letter = ~LETTERS[words.buf]
    mixed = np.zeros(len(raw), dtype=bool)
    mixed[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & ~SPACE[raw[1:-1]]
    drawn = np.zeros(len(raw), dtype=bool)
    drawn[2:] = letter[2:] & (words.buf[2:] == words.buf[1:-1]) & (words.buf[2:] == words.buf[:-2]) & (words.buf[2:] < 0x80)
    x[:, 17] = share(mixed | drawn)
    hidden = folded(texts, LEET)
    found = np.zeros(len(hidden.start))
    for at, h in terms(hidden):
        hit, w = lexicon.hits(h)
        np.maximum.at(found, at[hit], w)
    x[:, 18] = np.maximum(np.bincount(hidden.doc, found, n) - np.bincount(row, either, n), 0) * per_word
    x[:, 19] = np.log1p(count)
    return x


def _pronouns() -> np.ndarray:
    return folded([w.encode() for w in SECOND_PERSON], LOWER).hash


PRONOUNS = _pronouns()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and fold of the bounded sample of labelled rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    known = rows.dropna().groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_ROWS)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "label_id"), F.lit(FOLDS)).cast("int")
    return docs.join(F.broadcast(sample), docs.doc_id == sample.label_id).select("doc_id", "text", "toxic", fold.alias("fold"))


def learned_lexicons(sample: DataFrame) -> list[Lexicon]:
    """A lexicon learned without each fold in turn, and last the one learned from all."""

    def count(batches):
        for b in batches:
            toxic, fold = b.column(1).to_numpy(), b.column(2).to_numpy()
            for begin, _, texts in pieces(b.column(0)):
                words = folded(texts, LOWER)
                found = [np.stack([h, words.doc[at].astype(U64)], axis=1) for at, h in terms(words)]
                pairs = np.unique(np.concatenate(found), axis=0)
                key = pairs[:, 1].astype(np.int64) + begin
                cell = np.stack([pairs[:, 0], fold[key].astype(U64), toxic[key].astype(U64)], axis=1)
                cells, n = np.unique(cell, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, 0]).view(np.int64)), pa.array(cells[:, 1].astype(np.int32)), pa.array(cells[:, 2].astype(np.int32)), pa.array(n)], names=["term", "fold", "toxic", "n"])

    counted = sample.select("text", "toxic", "fold").mapInArrow(count, "term long, fold int, toxic int, n long")
    sums = [F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{k}{t}") for k in range(FOLDS) for t in (0, 1)]
    per_class = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    rows = [[per_class.get((k, t), 0) for t in (0, 1)] for k in range(FOLDS)]
    clean, toxic = sum(r[0] for r in rows), sum(r[1] for r in rows)
    totals = counted.groupBy("term").agg(*sums)
    n1 = sum(F.col(f"n{k}1") for k in range(FOLDS))
    n0 = sum(F.col(f"n{k}0") for k in range(FOLDS))
    odds = F.log((n1 + 0.5) / (toxic + 1.0)) - F.log((n0 + 0.5) / (clean + 1.0))
    kept = totals.where(n1 >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS / 2)
    table = kept.orderBy((F.col("odds") * F.sqrt(n1)).desc(), "term").limit(LEXICON_TERMS).toArrow()
    term = table["term"].to_numpy().view(U64)
    n = {(k, t): table[f"n{k}{t}"].to_numpy() for k in range(FOLDS) for t in (0, 1)}
    out = []
    for left_out in [*range(FOLDS), None]:
        used = [k for k in range(FOLDS) if k != left_out]
        hit, miss = sum(n[k, 1] for k in used), sum(n[k, 0] for k in used)
        w = np.log((hit + 0.5) / (sum(rows[k][1] for k in used) + 1)) - np.log((miss + 0.5) / (sum(rows[k][0] for k in used) + 1))
        good = (w >= MIN_ODDS) & (hit >= MIN_TOXIC)
        out.append(Lexicon(term[good], w[good]))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, Booster | float, tuple[np.ndarray, np.ndarray]]:
    """Lexicon, trees (or a constant) and calibration knots."""
    sample = training_rows(docs, labels)
    lexicons = learned_lexicons(sample)

    def describe(batches):
        for b in batches:
            fold = b.column(3).to_numpy()
            for begin, end, texts in pieces(b.column(1)):
                x = np.zeros((end - begin, N_FEATURES))
                for k in range(FOLDS):
                    own = np.flatnonzero(fold[begin:end] == k)
                    if len(own):
                        x[own] = features([texts[i] for i in own], lexicons[k])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), b.column(2).slice(begin, end - begin), b.column(3).slice(begin, end - begin), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    table = sample.mapInArrow(describe, "doc_id long, toxic int, fold int, x array<double>").orderBy("doc_id").toArrow()
    y, fold = table["toxic"].to_numpy().astype(float), table["fold"].to_numpy()
    flat = np.array([0.0]), np.array([y.mean() if len(y) else 0.0])
    if not len(y) or y.min() == y.max():
        return lexicons[-1], 0.0, flat
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    out_of_fold = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.all() or not rest.any() or y[rest].min() == y[rest].max():
            out_of_fold[~rest] = np.log(y.mean() / (1 - y.mean()))
        else:
            out_of_fold[~rest] = boost(x[rest], y[rest]).margin(x[~rest])
    return lexicons[-1], boost(x, y), isotonic(out_of_fold, y)


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= THRESHOLD); the model is learned from train_docs and labels.

    train_docs and labels: doc_id and text, doc_id and toxic; only labels passed here are learned from.
    """
    train = train_docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon, model, (knots, levels) = fit(train, labels)

    def score(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for begin, end, texts in pieces(b.column(b.schema.get_field_index("text"))):
                margin = model.margin(features(texts, lexicon)) if isinstance(model, Booster) else np.zeros(end - begin)
                out[begin:end] = np.round(np.interp(margin, knots, levels), 6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
