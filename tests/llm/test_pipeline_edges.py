"""The pipeline over tables with nulls, repeated rows, clashing columns and no rows."""

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, score string, spans string, n_tokens string, kept string"
ITEM = "Which of the seven old clocks in the market tower strikes thirteen at noon? The third brass clock."


def tables(spark, folder, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def row(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), "h", "s", "p", "n", "k")


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_on_odd_rows(spark, tmp_path):
    draw = random.Random(4)
    prose = lambda: " ".join(draw.choices([f"word{i}" for i in range(500)], k=60))
    docs = [row(i, ("you are an idiot " * 3 if i % 4 == 0 else "a fine day it is ") + prose()) for i in range(160)]
    docs += [row(200, None), row(201, ""), row(202, " \n\t"), row(None, "a fine day " + prose(), None), row(None, None), row(203, "a fine day " + prose() * 300)]
    docs += [row(204, f"a fine day {prose()} {ITEM} {prose()}"), row(205, "a fine day password = 'abcdefghijklmnop' " + prose()), row(1, docs[1][1]), row(206, docs[2][1]), row(207, docs[3][1] + " more")]
    stages = staged(spark, tables(spark, tmp_path, docs))
    ids = [Counter(r.doc_id for r in df.collect()) for df in stages]
    clean, single, safe, masked, mixed = ids
    assert not [i for i in clean if i is not None and i < 160 and i % 4 == 0] and {200, 201, 202, 203, 204, 205, None} <= set(clean) and clean[None] == 2 and clean[1] == 2
    assert single[1] == 2 and not {206, 207} & set(single) and set(clean) - set(single) == {206, 207} and single[None] == 2
    assert set(single) - set(safe) == {204} and masked == safe and set(mixed) <= set(masked)
    text = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert "[SECRET]" in text[205][0] and "abcdefghijklmnop" not in text[205][0] and text[205][1] == len(text[205][0])
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[:4])


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
