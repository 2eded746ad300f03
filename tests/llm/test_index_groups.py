"""The index of test items: groups of items, block bounds against exhaustive sums, memory, and where overlap counts."""

import pickle
import random
from collections import Counter

import numpy as np

from millrace.llm import decontaminate
from millrace.llm.decontaminate import B, K1, PIECE, THRESHOLD, benchmark_hits, build_index, cut_pieces, split_words


def invented(n, seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    return [(i, " ".join(draw.choices(vocabulary, weights, k=draw.choice((8, 40, 64, 90, 200)))) + ". It is so.") for i in range(n)]


def exhaustive(items, texts):
    held = [(i, p) for i, (_, t) in enumerate(items) for p in cut_pieces(split_words([t]).hash)]
    df = Counter(x for _, t in held for x in set(t.tolist()))
    mean = np.mean([len(t) for _, t in held])
    weights = []
    for _, t in held:
        w = {x: np.log1p((len(held) - df[x] + 0.5) / (df[x] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(t) / mean)) for x, n in Counter(t.tolist()).items()}
        weights.append({x: v / sum(w.values()) for x, v in w.items()})
    want = {}
    for d, text in enumerate(texts):
        h = split_words([text]).hash.tolist()
        for p in range(max(1, -(-len(h) // PIECE))):
            passage = set(h[p * PIECE : (p + 2) * PIECE])
            for place, w in enumerate(weights):
                if (score := sum(v for x, v in w.items() if x in passage)) >= THRESHOLD:
                    want[d, p, place] = score
    return want


def test_block_bounds_lose_nothing(monkeypatch):
    items = [(i, t.encode()) for i, t in invented(400)]
    draw = random.Random(6)
    texts = [b" ".join(t for _, t in draw.sample(items, 3)) for _ in range(30)] + [items[7][1][:90], b"", " ".join(f"w{i}" for i in range(3000)).encode()]
    want = exhaustive(items, texts)
    assert len(want) > 100
    for step in (decontaminate.STEP, 50):
        monkeypatch.setattr(decontaminate, "STEP", step)
        (part,), _ = build_index(items)
        got = {(d, p, place): s for d, p, place, s in part.passages(split_words(texts))}
        assert {k for k in want if want[k] > THRESHOLD + 1e-4} <= set(got) <= {*want} and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_groups_of_items_find_the_same(spark):
    items = invented(60) + [(1, "Which of the seven old clocks strikes thirteen? The third brass clock."), (99, "  ")]
    docs = [(i, f"before {t} after", i) for i, (_, t) in enumerate(items)] + [(None, items[3][1] + " and " + items[5][1], 0), (70, None, 0), (71, " ", 0), (72, "unlike all of them", 0)]
    frames = spark.createDataFrame(docs, "doc_id long, text string, hits long"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (
        sorted((r.doc_id or -1, *((h.item_id, h.score, h.question_overlap, h.answer_overlap) for h in r.hits)) for r in benchmark_hits(*frames, **more).collect())
        for more in ({}, {"group_bytes": 4000})
    )
    assert len(one) == len(docs) and one == many and sum(len(r) > 1 for r in one) >= 61


def test_an_index_of_many_items_is_small():
    index, checks = build_index([(i, t.encode()) for i, t in invented(20_000)])
    assert len(pickle.dumps((index, checks))) < 100 << 20
    assert len(index[0].passages(split_words([checks and invented(3)[2][1].encode()]))) >= 1


def test_unrelated_places_are_no_copy(spark):
    """All of an item's trigrams stand in the text, but an item's length and more apart from the passage."""
    words = [f"term{i}" for i in range(60)]
    item = " ".join(words) + ". The answer is forty two apples."
    filler = " ".join(f"filler{i}" for i in range(400))
    scattered = f" {filler} ".join([" ".join(words[i : i + 5]) for i in range(0, 60, 3)] + ["the answer is forty two apples"])
    got = benchmark_hits(spark.createDataFrame([(1, scattered), (2, f"{filler} {item} {filler}")], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: len(r.hits) for r in got} == {1: 0, 2: 1}
