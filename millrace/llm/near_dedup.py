"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets and union-find grouping.

Two documents are linked if the Jaccard similarity of their shingle sets is at least `least` percent, decided on the full
sets; a document's component is the smallest id it can reach over links.  Documents with equal sets form a class and take
part once, as the class's smallest id.

Plan.  One pass over the text gives each document its set's size and digest, a one-bit-a-slot sketch and its band keys.
Classes that share a band key meet in a bucket; a class that shares any gets one row with its buckets and their hubs (the
bucket's least id), and its shingle set is written once.  Every member is compared with its buckets' hubs (the closest first),
links are verified on full sets, components are contracted.  Only members of buckets that are still in several components go
on, and not as pairs of a bucket: an exact prefix filter over their sets (two similar sets share one of their rarest shingles)
gives the pairs of different components to verify, so that pages of one template, whose rare shingles differ, meet in no
pair, and a large group of near copies meets only the few that its hub did not catch.  Odd sketches (the parity of the
shingles that fall on each of 1,024 bits; two of them differ in no more bits than the sets in shingles) rule out nearly all
pairs that are no links, without loss.  Verified pairs are components' edges, contracted by min-label stars: all of it as
DataFrames, with lineage cut in spark.checkpoint.dir.

Recall.  With 32 bands of 4 slots a pair at exactly 0.8 similarity shares a bucket with probability 1 - 5e-8.

Defined results.  Null or blank text has an empty set, is linked with nothing and is its own component.  A null id joins
the component of an equal set that has an id, else null, and is kept then.  Rows with one id are one node, but for its
rows without words.  Shingles are hashes of 54 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.superminhash import ROWS, band_keys, odd_sketches, set_digests, shingle_sets, signatures
from millrace.llm.tokens import U64, pieces

BANDS, SLOTS = 32, 128
#: Mismatches among the sketch bits that a pair at 0.8 similarity exceeds with probability under 1e-8 (12.8 expected).
SKETCH_SLACK = 36
#: 64-bit words of an odd sketch.
ODD_WORDS = 16
#: Shingles are put in order by the counts of 2**ORDER_BITS buckets.
ORDER_BITS = 18
#: Rows of prefixes that leave a Python worker at once, or one set's.
PREFIX_ROWS = 100_000
BATCH_ROWS = 1000
ROWS_A_PART = 100_000
#: Ids to verify are broadcast up to this many (8 bytes each), and joined by shuffle beyond.
BROADCAST_IDS = 2_000_000

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, s1 long, s2 long, odd array<long>, bands array<long>"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without it, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/millrace-checkpoints"
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """df checkpointed, in a partition for every ROWS_A_PART rows, and its number of rows.

    The tables of the rounds are small next to the text; few partitions keep their many exchanges from many tiny files.
    """
    kept = checkpointed(df)
    n = kept.count()
    return kept.coalesce(max(1, -(-n // ROWS_A_PART))), n


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches hold BATCH_ROWS rows at most, so that a worker holds few texts or sets at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """SKETCH of every row of docs (doc_id, text)."""

    def sketch(batches):
        for b in batches:
            for begin, end, texts in pieces(b.column(1), rows=ROWS):
                n = end - begin
                row, elements = shingle_sets(texts, k)
                size, d1, d2 = set_digests(row, elements, n)
                sig = signatures(row, elements, n, SLOTS)
                bits = np.packbits((sig & 1).astype(bool), axis=1).view(U64)
                keys = band_keys(sig, BANDS)
                long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), long(x.reshape(-1)))
                odd = odd_sketches(row, elements, n, ODD_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, n), pa.array(size.astype(np.int64)), long(d1), long(d2), long(bits[:, 0]), long(bits[:, 1]), lists(odd), lists(keys)], names=["doc_id", "n_shingles", "d1", "d2", "s1", "s2", "odd", "bands"]
                )

    return docs.mapInArrow(sketch, SKETCH)


def similar(a: str, b: str, least: int):
    """Whether two sketches allow a similarity of `least` percent: sizes and bits."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * small >= least * large) & (mismatches(a, b) <= SKETCH_SLACK)


def close(a: str, b: str, least: int):
    """Whether two odd sketches allow a similarity of `least` percent: exact, as they differ in no more bits than the sets in shingles."""
    apart = sum((F.bit_count(F.col(f"{a}.odd.o{i}").bitwiseXOR(F.col(f"{b}.odd.o{i}"))) for i in range(ODD_WORDS)), F.lit(0))
    return (100 + least) * apart <= (100 - least) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def mismatches(a: str, b: str):
    return F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))


def text_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and elements (54-bit shingle hashes, as bytes) of the documents named by ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def sets(batches):
        for b in batches:
            for begin, end, texts in pieces(b.column(1), rows=ROWS):
                row, elements = shingle_sets(texts, k)
                cuts = np.searchsorted(row, np.arange(end - begin + 1))
                blobs = [elements[cuts[i] : cuts[i + 1]].tobytes() for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.array(blobs, pa.binary())], names=["id", "elements"])

    picked = docs.join(F.broadcast(ids) if few else ids, docs.doc_id == ids.id, "left_semi").select("doc_id", "text")
    return picked.mapInArrow(sets, "id long, elements binary")


def verified(sets: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def check(batches):
        for b in batches:
            left, right = b.column(2), b.column(3)
            keep = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                both = np.sort(np.concatenate([np.frombuffer(side[i].as_buffer(), U64) for side in (left, right)]))
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= least * (len(both) - common)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long").distinct()


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """Sets that hold a shingle of each of 2**ORDER_BITS hash buckets: a table of fixed size."""

    def count(batches):
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            if b.num_rows:
                e = np.concatenate([np.frombuffer(blob.as_buffer(), U64) for blob in b.column(0)])
                total += np.bincount((e >> U64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = sets.select("elements").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, least: int) -> DataFrame:
    """The rarest shingles of each set (id, component, minor, elements), as rows id, component, minor, n, shingle, index.

    Two sets with `least` percent of their union in common share a shingle among the first n - ceil(least n / 100) + 1 of the
    larger one and, index, the first m - ceil(2 least m / (100 + least)) + 1 of the smaller one, in any one order of all
    shingles; the order here is by the counts of the shingles' buckets, so that text that many share comes last.
    """
    counts = shingle_counts(sets)

    def cut(batches):
        names = ["id", "component", "minor", "n", "shingle", "index"]
        for b in batches:
            first, taken, sizes, index = [], [], [], []
            for row, blob in enumerate(b.column(3)):
                e = np.frombuffer(blob.as_buffer(), U64)
                n = len(e)
                ordered = e[np.lexsort((e, counts[(e >> U64(64 - ORDER_BITS)).astype(np.int64)]))[: n - -(-least * n // 100) + 1]]
                first.append(ordered)
                taken.append(np.full(len(ordered), row))
                sizes.append(np.full(len(ordered), n))
                index.append(np.arange(len(ordered)) < n - -(-2 * least * n // (100 + least)) + 1)
                if sum(map(len, first)) >= PREFIX_ROWS or row == b.num_rows - 1:
                    rows = pa.array(np.concatenate(taken))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(3)), *(pa.array(np.concatenate(x)) for x in (sizes, [x.view(np.int64) for x in first], index))], names=names)
                    first, taken, sizes, index = [], [], [], []

    return sets.select("id", "component", "minor", "elements").mapInArrow(cut, "id long, component long, minor boolean, n long, shingle long, index boolean")


def contracted(edges: DataFrame) -> DataFrame:
    """id and component (smallest reachable id) of every node of the edges (a, b), by alternating large and small stars."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges, _ = settled(small.where("u <> v").distinct())
        # done when every node names one other and none that names another itself: all stars around their least nodes
        parents = edges.select(F.col("v").alias("x"), F.lit(2).alias("k")).distinct()
        if edges.select(F.col("u").alias("x"), F.lit(1).alias("k")).union(parents).groupBy("x").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, least: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):  # all that runs Python here runs within it
        return grouped(docs, k, least)


def grouped(docs: DataFrame, k: int, least: int) -> DataFrame:
    """near_duplicates of doc_id and text."""
    sketched = checkpointed(sketches(docs, k))
    class_key = ["n_shingles", "d1", "d2"]
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy(*class_key).agg(F.min(F.struct("doc_id", "s1", "s2", "odd", "bands")).alias("r"))
    reps = checkpointed(classes.select(F.col("r.doc_id").alias("rep"), F.col("n_shingles").alias("n"), *class_key[1:], "r.s1", "r.s2", "r.odd", "r.bands"))
    membership = reps.select(*[F.col("n" if c == "n_shingles" else c).alias(f"__{c}") for c in class_key], "rep")
    labels = None  # id, component of verified links so far

    def classed(df: DataFrame) -> DataFrame:
        return df.join(membership, [F.col(c) == F.col(f"__{c}") for c in class_key], "left").drop(*(f"__{c}" for c in class_key))

    def label(df: DataFrame, column: str, out: str) -> DataFrame:
        if labels is None:
            return df.withColumn(out, F.col(column))
        side = labels.withColumnsRenamed({"id": "__id", "component": "__component"})
        return df.join(side, F.col(column) == F.col("__id"), "left").withColumn(out, F.coalesce("__component", column)).drop("__id", "__component")

    def merge(new: DataFrame) -> None:
        nonlocal labels
        new, n = settled(new)
        if n:
            labels = contracted(new if labels is None else new.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    # an id with several sets is one node of all its classes
    mixed = real.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("doc_id")
    merge(classed(real.join(mixed, "doc_id", "left_semi")).where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())

    entries = reps.select("rep", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("high"), F.count("*").alias("members")).where("hub < high").drop("high")
    # one row a class that shares a bucket: its buckets (BANDS at most) with their hubs
    shares = entries.join(buckets, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "hub", "members")).alias("buckets"))
    members, _ = settled(shares.join(reps.select("rep", F.struct("n", "s1", "s2", F.struct(*(F.col("odd")[i].alias(f"o{i}") for i in range(ODD_WORDS))).alias("odd")).alias("m")), "rep"))
    sets = checkpointed(text_sets(docs, members.select(F.col("rep").alias("id")).distinct(), k))

    def link(pairs: DataFrame) -> None:
        """Verifies pairs (a, b, gap): the closest of each b first, then those that still join different components."""
        pairs, n = settled(pairs)
        if not n:
            return
        first = pairs.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        merge(verified(sets, first, least))
        rest, n = settled(label(label(pairs.join(first, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"))
        if n:
            merge(verified(sets, rest, least))

    hubs = members.select("rep", "m", F.explode(F.array_distinct(F.transform("buckets", lambda b: b["hub"]))).alias("hub")).where("rep <> hub")
    met = hubs.join(members.select(F.col("rep").alias("hub"), F.col("m").alias("h")), "hub").where(similar("m", "h", least))
    link(met.select(F.col("hub").alias("a"), F.col("rep").alias("b"), mismatches("m", "h").alias("gap")).distinct())

    # buckets of two are decided; of the larger ones, those whose members are still apart, and their largest component
    several = label(members.select("rep", F.transform(F.filter("buckets", lambda b: b["members"] > 2), lambda b: b["key"]).alias("keys")), "rep", "component")
    seats = several.select("rep", "component", F.explode("keys").alias("key"))
    split = seats.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("major"), F.count("*").alias("components")).where("components > 1")
    left, n = settled(seats.join(split.select("key", "major"), "key").groupBy("rep", "component").agg(F.max(F.col("component") != F.col("major")).alias("minor")))
    if n:
        apart = checkpointed(prefixes(sets.join(left, sets.id == left.rep).select("id", "component", "minor", "elements"), least))
        # shingles by which members of two components meet; sketches go along with these alone
        live = apart.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("minor").alias("minor")).where("low < high and minor")
        seen = apart.join(live.select("shingle"), "shingle", "left_semi").join(members.select(F.col("rep").alias("id"), "m"), "id")
        x, y = (rows.select(F.col("shingle").alias(f"{c}_shingle"), F.struct("id", "component", "minor", "m.*").alias(c)) for rows, c in ((seen, "x"), (seen.where("index"), "y")))
        met = (F.col("x.component") != F.col("y.component")) & (F.col("x.minor") | F.col("y.minor")) & (F.struct("x.n", "x.id") > F.struct("y.n", "y.id"))
        found = x.join(y, (F.col("x_shingle") == F.col("y_shingle")) & met & similar("x", "y", least) & close("x", "y", least))
        link(found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), mismatches("x", "y").alias("gap")).distinct())
    out = label(classed(sketched.select("doc_id", *class_key)), "rep", "component")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
