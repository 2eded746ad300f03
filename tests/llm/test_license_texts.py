"""Licence texts against a plain search of every text at every place."""

import random

from millrace.llm.license_scan import DRIFT, MATCH, PHRASES, TEMPLATES, license_scan, split_words
from millrace.llm.license_texts import TEXTS


def brute_labels(text):
    words, out = split_words(text or ""), set()
    for label, parts, key in TEMPLATES:
        at = next(j for j in range(len(parts)) if parts[j : j + len(key)] == key)
        drift = -(-len(parts) // DRIFT)
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] == key:
                begin = i - at
                hits = sum(w in words[max(0, begin + j - drift) : max(0, begin + j + drift + 1)] for j, w in enumerate(parts))
                out |= {label} if hits >= MATCH * len(parts) else set()
    return out | {label for phrase, label in PHRASES if f" {phrase} " in f" {' '.join(words)} "}


def test_labels_equal_a_search_of_everything(spark):
    draw = random.Random(1)
    rows = []
    for i in range(200):
        picked = [draw.choice(TEXTS)[1] for _ in range(draw.randrange(4))]
        words = f" filler {i} of the text ".join(["", *picked, ""]).split()
        for _ in range(draw.randrange(8)):
            at = draw.randrange(len(words) + 1)
            words[at : at + draw.randrange(2)] = draw.choices(["new", "the", "License"], k=draw.randrange(2))
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "MIT"), (1003, TEXTS[0][1] * 300), (1004, "license " * 20_000)]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ",".join(sorted(brute_labels(t))) for i, t in rows} and sum(bool(x) for x in got.values()) > 100


def test_every_text_in_every_row(spark):
    rows = [(i, f"{i} " + "\n\n".join(t for _, t, _ in TEXTS)) for i in range(12)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.labels for r in got} == {",".join(sorted({label for label, _, _ in TEXTS}))} and {r.score for r in got} == {1.0}


def test_families_are_told_apart_and_words_put_in(spark):
    by = {label: next(t for lab, t, _ in TEXTS if lab == label) for label in ("gpl", "lgpl", "agpl", "isc", "unlicense", "zlib")}
    mit = next(t for label, t, key in TEXTS if "deal in" in key).split()
    rows = [(1, by["gpl"]), (2, by["lgpl"]), (3, by["agpl"]), (4, by["isc"]), (5, by["unlicense"]), (6, by["zlib"]), (7, " ".join([*mit[:30], "really", "and", "truly", *mit[30:]]))]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "gpl", 2: "gpl,lgpl", 3: "agpl,gpl", 4: "isc", 5: "unlicense", 6: "zlib", 7: "mit"}
