"""Near copies of test items."""

import random

import numpy as np

from millrace.llm.decontaminate import benchmark_hits, word_edits


def brute_edits(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_word_edits_are_the_least():
    draw = random.Random(3)
    for _ in range(300):
        item, text = (draw.choices(range(4), k=draw.randrange(1, 12)), draw.choices(range(5), k=draw.randrange(0, 30)))
        assert word_edits(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64)) == brute_edits(item, text)


def test_one_changed_word_hides_no_item(spark):
    words = "Which of the seven old clocks in the market tower strikes thirteen at noon? The third brass clock.".split()
    rows = [(i, " ".join(["before", *words[:i], "replaced", *words[i + 1 :], "after"])) for i in range(len(words))]
    rows += [(100, " ".join(words[:9]) + " is unknown"), (101, " ".join(reversed(words)))]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert all(got[i] == [1] for i in range(len(words))) and got[100] == got[101] == []
