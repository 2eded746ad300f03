"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND by every passage.

Test items are cut into pieces of at most PIECE words and indexed; a posting's impact is its BM25 weight over the piece's own
score, so that one threshold fits all pieces.  Every training document is read as overlapping passages of 2 * PIECE words,
so that a copied piece lies wholly within one of them.  A passage is dropped when the largest impacts of its terms can't
reach the threshold, then block by block of BLOCK_PIECES pieces with the largest impacts that the terms' postings have there;
postings are read and summed only in blocks whose bound reaches it: all pieces at or above the threshold are retrieved.
A retrieved item counts as leaked when shares of the word trigrams of its question (all but the last sentence) and of its
answer (the last sentence) stand around the passage (an item's length before and after it), or when the whole item stands
there with at most EDITS of its words put in, left out or changed.

Plan.  One pass over the documents without a shuffle.  The items are the stated query set: they are dealt by hash into groups
of about GROUP_BYTES, whose sparse postings bound what a task holds (about 8 bytes a byte of text); idf and mean length are
those of all groups.  More groups than one are searched one after the other, the documents with their hits so far written
to the checkpoint folder between two passes.

Defined results.  Null and blank texts have no passages and no hits; null or blank items are never hit; an item of one
sentence has no answer part and is judged by the question alone; repeated items each report their own hit.  The overlaps are
those of the first passage that is accepted, the score is the best passage's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.near_dedup import checkpointed
from millrace.llm.tokens import LOWER, U64, WORD_BASE, Words, mix, pieces

PIECE = 64
BLOCK_PIECES = 16
#: Text of items that one index holds.
GROUP_BYTES = 16 << 20
#: Rows that a search holds at once: block bounds of passages.
STEP = 4 << 20
K1, B = 1.2, 0.75
#: Share of a piece's own BM25 score that a passage must reach.
THRESHOLD = 0.6
#: Share of the trigrams of the question, and of the answer, that must stand around the passage.
OVERLAP = 0.7
#: Word edits, as a share of the item's words, up to which a passage is a near copy of the whole item.
EDITS = 0.2
SENTENCE = re.compile(rb"(?:[.!?]+[\x20\x09-\x0D]+|\n+)(?=[^\x20\x09-\x0D])")

#: Words are runs of ASCII letters, digits and all characters beyond ASCII, so that marks next to a copy don't hide its ends.
GAPS = np.ones(256, dtype=bool)
GAPS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
GAPS[128:] = False

HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def split_words(texts: list[bytes]) -> Words:
    return Words(texts, separators=GAPS, table=LOWER)


def grams(h: np.ndarray, sizes: tuple[int, ...] | None = None) -> np.ndarray:
    """Distinct trigram hashes of a word sequence, or of a shorter one its whole; or the windows of the given sizes."""
    out = []
    for k in sizes or (min(3, len(h)),):
        if 0 < k <= len(h):
            rolled = np.zeros(len(h) - k + 1, dtype=U64)
            for j in range(k):
                rolled = rolled * U64(WORD_BASE) + h[j : j + len(rolled)]
            out.append(mix(rolled + U64(k)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, U64)


def parts_of(text: bytes) -> tuple[bytes, bytes]:
    """Question and answer of an item."""
    text = text.strip()
    cuts = [m.end() for m in SENTENCE.finditer(text)]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, b"")


def word_edits(item: np.ndarray, document: np.ndarray) -> int:
    """Least number of word edits that turn an item into any passage of a document (Myers' bit-parallel search)."""
    n = len(item)
    last, every = 1 << (n - 1), (1 << n) - 1
    at: dict[int, int] = {}
    for j, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    plus, minus, score = every, 0, n
    best = n
    for w in document.tolist():
        eq = at.get(w, 0)
        flat = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (every & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 & every, down << 1 & every
        plus = down | (every & ~(flat | up))
        minus = up & flat
        best = min(best, score)
    return best


def near_copy(item: np.ndarray, document: np.ndarray) -> bool:
    """Whether a passage of the document is the item but for EDITS of its words."""
    allowed = int(EDITS * len(item))
    return int((~np.isin(item, document)).sum()) <= allowed and word_edits(item, document) <= allowed


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges starts[i] .. starts[i] + counts[i]: the range and the place of every element."""
    which = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return which, np.arange(len(which)) - before[which] + starts[which]


class IndexPart:
    """Postings of pieces by term and block, with idf and mean length of the whole index.

    terms (sorted); runs of a term: first_run[t] .. first_run[t + 1], each with its block, its largest impact and its postings
    first_posting[r] .. first_posting[r + 1], each a piece and an impact.
    """

    def __init__(self, held: list[tuple[int, np.ndarray]], idf: dict[int, float], mean: float) -> None:
        self.items = np.array([i for i, _ in held], dtype=np.int64)
        found = []
        for _, t in held:
            term, tf = np.unique(t, return_counts=True)
            w = np.array([idf[x] for x in term.tolist()]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            found.append((term, (w / w.sum()).astype(np.float32)))
        term = np.concatenate([t for t, _ in found])
        piece = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t, _ in found])
        order = np.argsort(term, kind="stable")  # pieces ascend within a term
        term, self.piece, self.impact = term[order], piece[order], np.concatenate([w for _, w in found])[order]
        block = self.piece // BLOCK_PIECES
        fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        self.first_posting = np.append(np.flatnonzero(fresh), len(term))
        self.block, self.most = block[fresh], np.maximum.reduceat(self.impact, self.first_posting[:-1])
        run_term = term[fresh]
        starts = np.flatnonzero(np.concatenate([[True], run_term[1:] != run_term[:-1]]))
        self.terms, self.first_run, self.top = run_term[starts], np.append(starts, len(run_term)), np.maximum.reduceat(self.most, starts)
        self.blocks = -(-len(held) // BLOCK_PIECES)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.terms >> U64(44)).astype(np.int64)] = True

    def passages(self, words: Words) -> list[tuple[int, int, int, float]]:
        """(row, passage of the row, item place, score) of the pieces that a passage reaches the threshold of."""
        maybe = np.flatnonzero(self.bitmap[(words.hash >> U64(44)).astype(np.int64)])
        if not len(maybe):
            return []
        near = np.minimum(np.searchsorted(self.terms, words.hash[maybe]), len(self.terms) - 1)
        right = self.terms[near] == words.hash[maybe]
        at, term = maybe[right], near[right]
        # passage p of a row holds the row's halves p and p + 1 of PIECE words each
        halves = np.maximum(-(-words.count // PIECE), 1)
        base = np.concatenate([[0], np.cumsum(halves)])
        row = words.doc[at]
        half = base[row] + (at - words.first[row]) // PIECE
        n = int(base[-1])
        bound = np.bincount(half, self.top[term], n)
        bound[:-1] += bound[1:]  # the next row's first half only raises the bound
        alive = bound >= THRESHOLD - 1e-6
        own, before = alive[half], np.concatenate([[False], alive[:-1]])[half] & (half > base[row])
        passage = np.concatenate([half[own], half[before] - 1])
        if not len(passage):
            return []
        key = np.unique(passage * len(self.terms) + np.concatenate([term[own], term[before]]))
        passage, term = key // len(self.terms), key % len(self.terms)
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        sizes = np.add.reduceat(self.first_run[term + 1] - self.first_run[term], starts)
        part = (np.cumsum(sizes) - 1) // STEP  # passages whose block bounds are held together
        cuts = np.append(starts[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))], len(passage))
        out: list[tuple[int, int, int, float]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            t, p = term[lo:hi], passage[lo:hi]
            which, run = spread(self.first_run[t], self.first_run[t + 1] - self.first_run[t])
            place, slot = np.unique(p[which] * self.blocks + self.block[run], return_inverse=True)
            reached = np.bincount(slot, self.most[run]) >= THRESHOLD - 1e-4
            which, run = which[reached[slot]], run[reached[slot]]
            back, posting = spread(self.first_posting[run], self.first_posting[run + 1] - self.first_posting[run])
            hit, slot = np.unique(p[which[back]] * len(self.items) + self.piece[posting], return_inverse=True)
            score = np.bincount(slot, self.impact[posting])
            for j in np.flatnonzero(score >= THRESHOLD - 1e-6).tolist():
                q = int(hit[j]) // len(self.items)
                doc = int(np.searchsorted(base, q, side="right")) - 1
                out.append((doc, q - int(base[doc]), int(hit[j]) % len(self.items), float(score[j])))
        return out

    def search(self, words: Words) -> list[tuple[int, int, float]]:
        """(row, item place, score) of the pieces that a passage reaches the threshold of, best passage of each."""
        best: dict[tuple[int, int], float] = {}
        for row, _, place, score in self.passages(words):
            best[row, place] = max(best.get((row, place), 0.0), score)
        return [(d, p, s) for (d, p), s in best.items()]


def cut_pieces(h: np.ndarray) -> list[np.ndarray]:
    """Pieces of an item's words; the last ends with the item."""
    return [h[b : b + PIECE] for b in (max(0, min(b, len(h) - PIECE)) for b in range(0, len(h), PIECE))]


#: What idf and mean length are counted from: pieces, their words, and pieces that hold each term.
Totals = tuple[int, int, dict[int, int]]


def totals(held: list[np.ndarray]) -> Totals:
    found, n = np.unique(np.concatenate([np.unique(t) for t in held]), return_counts=True) if held else (np.empty(0, U64), np.empty(0, np.int64))
    return len(held), sum(map(len, held)), dict(zip(found.tolist(), n.tolist()))


def build_index(items: list[tuple[int, bytes]], known: Totals | None = None) -> tuple[list[IndexPart], list[tuple[int, int, np.ndarray]]]:
    """Index parts (one, or none without words), whose entries name places in the list of (item_id, words of the question, words)."""
    held: list[tuple[int, np.ndarray]] = []
    checks = []
    for item, text in items:
        h = split_words([text]).hash
        if len(h):
            held += [(len(checks), p) for p in cut_pieces(h)]
            checks.append((item, len(split_words([parts_of(text)[0]]).hash), h))
    if not held:
        return [], checks
    n_pieces, n_words, df = known or totals([t for _, t in held])
    idf = {x: float(np.log1p((n_pieces - n + 0.5) / (n + 0.5))) for x, n in df.items()}
    return [IndexPart(held, idf, n_words / n_pieces)], checks


def counted_terms(items: DataFrame) -> tuple[int, int, DataFrame]:
    """Totals of all items' pieces: pieces, words, and the table term, n."""

    def count(batches):
        for b in batches:
            held = [p for text in b.column(0).to_pylist() for p in cut_pieces(split_words([text.encode()]).hash) if len(p)]
            n_pieces, n_words, df = totals(held)
            term, n = [None, None, *np.array(list(df), dtype=U64).view(np.int64).tolist()], [n_pieces, n_words, *df.values()]
            yield pa.RecordBatch.from_arrays([pa.array(["pieces", "words", *["term"] * len(df)]), pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["kind", "term", "n"])

    rows = checkpointed(items.select("text").mapInArrow(count, "kind string, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")))
    sums = {r.kind: r.n for r in rows.where("term is null").collect()}
    return sums.get("pieces", 0), sums.get("words", 0), rows.where("term is not null").select("term", "n")


def benchmark_hits(docs: DataFrame, items: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with the column hits: the leaked items of each document, by item_id."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    groups = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    out = docs.drop("hits")
    whole = counted_terms(items) if groups > 1 else None
    for g in range(groups):
        own = [(r.item_id, r.text.encode()) for r in dealt.where(F.col("group") == g).orderBy("item_id", "text").collect()]  # about group_bytes
        known = None
        if whole:
            mine = np.unique(np.concatenate([split_words([t]).hash for _, t in own] or [np.empty(0, U64)])).view(np.int64)
            terms = docs.sparkSession.createDataFrame([(x,) for x in mine.tolist()], "term long")
            known = whole[0], whole[1], {r.term & 0xFFFFFFFFFFFFFFFF: r.n for r in whole[2].join(terms, "term").collect()}
            out = checkpointed(out) if g else out
        out = searched(out, own, known)
    return out


def searched(docs: DataFrame, own: list[tuple[int, bytes]], known: Totals | None) -> DataFrame:
    """docs with the hits of these items, added to the column hits if there is one."""
    index, checks = build_index(own, known)

    def verdict(check: int, around: np.ndarray) -> tuple[float, float] | None:
        """Shares of question and answer in the words around a passage, if the item is leaked there."""
        _, n_question, item = checks[check]
        there = grams(around, (1, 2, 3))
        shares = [float(np.isin(grams(x), there).mean()) if len(x) else 1.0 for x in (item[:n_question], item[n_question:])]
        return tuple(shares) if min(shares) >= OVERLAP or near_copy(item, around) else None

    def search(batches):
        for b in batches:
            hits = b.column(b.schema.get_field_index("hits")).to_pylist() if "hits" in b.schema.names else [[] for _ in range(b.num_rows)]
            for begin, _, texts in pieces(b.column(b.schema.get_field_index("text"))):
                words = split_words(texts)
                best: dict[tuple[int, int], float] = {}
                spots: dict[tuple[int, int], set[int]] = {}
                for part in index:
                    for row, passage, place, score in part.passages(words):
                        k = row, int(part.items[place])
                        best[k] = max(best.get(k, 0.0), score)
                        spots.setdefault(k, set()).add(passage)
                for (row, check), score in sorted(best.items()):
                    text, size = words.hash[words.first[row] : words.first[row + 1]], len(checks[check][2])
                    around = (text[max(0, p * PIECE - size) : (p + 2) * PIECE + size] for p in sorted(spots[row, check]))
                    if shares := next(filter(None, (verdict(check, w) for w in around)), None):
                        hits[begin + row].append({"item_id": checks[check][0], "score": round(min(score, 1.0), 6), "question_overlap": round(shares[0], 6), "answer_overlap": round(shares[1], 6)})
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
            kept = [i for i, name in enumerate(b.schema.names) if name != "hits"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array([sorted(h, key=lambda x: x["item_id"]) for h in hits], kind)], names=[*(b.schema.names[i] for i in kept), "hits"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "hits")
    return docs.mapInArrow(search, f"{columns}, hits {HITS}")
