"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted across the corpus.

A word is removed when some window of `width` words that covers it also starts in a document with a smaller id; the
removed words of a document form maximal intervals.

Plan.  Documents are dealt into blocks, contiguous ranges of doc_id.  A block hashes all its windows and sends each
distinct hash once, sorted and delta-coded, to the bucket that the hash belongs to; the bucket counts the blocks of every
hash and answers each block with those of its hashes that a smaller block has as well.  Within a block the
comparison is local.  So a passage that a third of all documents share costs one entry a block and not one a document,
no task holds more than a block or a bucket, and the text itself is shuffled once (both passes read the same exchange).
Blocks and buckets are as many as the input needs, at a size that does not depend on it; nothing is collected but a
fixed number of quantiles of doc_id, weighted by the texts' bytes.  Rows without an id meet no other row and are not shuffled.

Defined results.  Null text has no words.  A null doc_id is neither smaller nor larger than any other, so such a row
loses nothing and costs others nothing; rows with equal ids do not remove each other's words.  Extra columns are ignored.
Hashes have 64 bits: of n windows about n**2 / 2**65 pairs collide (1e-3 expected pairs at a billion bytes).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import U64, Words, encoded, pieces, ranges

#: Quantiles of doc_id that the block bounds are interpolated between.
KNOTS = 4096
#: Bytes of text that a document counts once more for in the quantiles.
KNOT_BYTES = 4096
#: Windows that one bucket is meant to hold, and bounds of a block's text in bytes.
BUCKET_WINDOWS = 1 << 20
BLOCK_BYTES = (2 << 20, 128 << 20)

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,finish:long>>, kept_text string"


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as the first value and fixed-width differences."""
    steps = np.diff(sorted_hashes)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(sorted_hashes[0]).to_bytes(8, "little") + body.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), dtype=np.uint8)
    out[1:, :width] = body
    steps = out.view("<u8").ravel().astype(U64)
    steps[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(steps, dtype=U64)


def block_windows(texts: pa.ChunkedArray | pa.Array, width: int):
    """For each piece of a block: its row range, its words, and first word and hash of each window."""
    for begin, end, part in pieces(texts):
        words = Words(part)
        yield begin, end, words, *words.windows(width)


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans of removed words (from 0, end exclusive), kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shares = F.split(F.lit(",".join(str(i / KNOTS) for i in range(KNOTS + 1))), ",").cast("array<double>")  # one literal, not thousands
    counted = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    weighted = counted.select("doc_id", "size", F.posexplode(F.array_repeat(F.lit(0), (1 + F.col("size") / KNOT_BYTES).cast("int"))).alias("copy", "zero"))
    size, knots = weighted.agg(F.sum(F.when(F.col("copy") == 0, F.col("size"))), F.percentile_approx("doc_id", shares, 10 * KNOTS)).first()
    size = size or 0
    block_bytes = min(max(int(math.sqrt(size * 65536)), BLOCK_BYTES[0]), BLOCK_BYTES[1])
    n_blocks = max(1, math.ceil(size / block_bytes))
    n_buckets = max(16, math.ceil(size / 6 / BUCKET_WINDOWS))
    low = np.array(knots or [0], dtype=np.float64)
    at = np.linspace(0, n_blocks, len(low))
    low, keep = np.unique(low, return_index=True)
    at = at[keep]

    def deal(batches):
        for b in batches:
            ids = b.column(0)
            place = np.interp(ids.to_numpy(zero_copy_only=False).astype(np.float64), low, at)
            place = np.minimum(np.floor(place), n_blocks - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), *b.columns], names=["block", "doc_id", "text"])

    dealt = docs.where("doc_id is not null").mapInArrow(deal, "block long, doc_id long, text string")

    def send(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        found = [h for *_, h in block_windows(table["text"], width)]
        h = np.unique(np.concatenate(found)) if found else np.empty(0, U64)
        bucket = ((h >> U64(32)) * U64(n_buckets)) >> U64(32)
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=U64))
        sent = [i for i in range(n_buckets) if cuts[i] < cuts[i + 1]]
        return pa.table({"bucket": pa.array(sent, pa.int64()), "block": pa.array([block] * len(sent), pa.int64()), "hashes": pa.array([pack(h[cuts[i] : cuts[i + 1]]) for i in sent], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        lists = [unpack(table["hashes"][int(i)].as_py()) for i in order]
        h = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        by_hash = np.argsort(h, kind="stable")
        h, owner = h[by_hash], owner[by_hash]
        late = np.zeros(len(h), dtype=bool)
        late[1:] = h[1:] == h[:-1]
        h, owner = h[late], owner[late]
        regroup = np.argsort(owner, kind="stable")
        h, owner = h[regroup], owner[regroup]
        cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
        told = [i for i in range(len(lists)) if cuts[i] < cuts[i + 1]]
        return pa.table({"block": pa.array([int(blocks[order[i]]) for i in told], pa.int64()), "hashes": pa.array([pack(h[cuts[i] : cuts[i + 1]]) for i in told], pa.binary())})

    def result(ids: pa.Array, texts: pa.Array, gone: list[np.ndarray]) -> pa.Table:
        """RESULT rows of texts; gone: first words of the windows that are removed from each."""
        n_words, n_removed, spans, kept = [], [], [], []
        for text, starts in zip(encoded(texts), gone):
            words = text.split()
            n_words.append(len(words))
            if not len(starts):
                n_removed.append(0)
                spans.append([])
                kept.append(b" ".join(words))
                continue
            breaks = np.flatnonzero(np.diff(starts) > width)
            begins = np.concatenate([starts[:1], starts[breaks + 1]]).tolist()
            ends = (np.concatenate([starts[breaks], starts[-1:]]) + width).tolist()
            rest, after = [], 0
            for a, b in zip(begins, ends):
                rest += words[after:a]
                after = b
            rest += words[after:]
            n_removed.append(len(words) - len(rest))
            spans.append([{"begin": a, "finish": b} for a, b in zip(begins, ends)])
            kept.append(b" ".join(rest))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))
        return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    def remove(table: pa.Table, repeated: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table["doc_id"].combine_chunks()
        texts = table["text"].combine_chunks()
        n = len(texts)
        gone: list[np.ndarray] = [np.empty(0, np.int64)] * n
        if n:
            value = ids.to_numpy()
            rank = np.zeros(n, dtype=np.int64)
            rank[1:] = np.cumsum(value[1:] != value[:-1])
            doc, start, hashes = [], [], []
            for begin, _, words, first, h in block_windows(texts, width):
                rows = words.doc[first]
                doc.append(rows + begin)
                start.append(first - words.first[rows])
                hashes.append(h)
            doc, start, h = np.concatenate(doc), np.concatenate(start), np.concatenate(hashes)
            if len(h):
                _, earliest, which = np.unique(h, return_index=True, return_inverse=True)
                hit = rank[doc[earliest]][which] < rank[doc]
                if repeated.num_rows:
                    others = np.sort(np.concatenate([unpack(x.as_py()) for x in repeated["hashes"]]))
                    near = np.minimum(np.searchsorted(others, h), len(others) - 1)
                    hit |= others[near] == h
                doc, start = doc[hit], start[hit]
                cuts = np.searchsorted(doc, np.arange(n + 1))
                gone = [start[cuts[i] : cuts[i + 1]] for i in range(n)]
        return result(ids, texts, gone)

    def alone(batches):
        for b in batches:
            for begin, end in ranges(np.asarray(pc.binary_length(b.column(1)).fill_null(0))):
                yield from result(b.column(0).slice(begin, end - begin), b.column(1).slice(begin, end - begin), [np.empty(0, np.int64)] * (end - begin)).to_batches()

    sent = dealt.groupBy("block").applyInArrow(send, "bucket long, block long, hashes binary")
    repeated = sent.groupBy("bucket").applyInArrow(count, "block long, hashes binary")
    compared = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(remove, RESULT)
    return compared.unionByName(docs.where("doc_id is null").mapInArrow(alone, RESULT))
