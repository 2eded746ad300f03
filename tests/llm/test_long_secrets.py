"""Secret scans of very long tokens and of texts with very many matches, against plain Python."""

import base64
import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm.secret_scan import redacted, running, secret_spans


def test_running_folds(spark):
    draw = random.Random(2)
    rows = [(i, [draw.randrange(100) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 4, 5, 9, 10, 99, 100, 1000))]
    df = spark.createDataFrame(rows, "i int, x array<long>").select("i", running(F.col("x"), 0, lambda a, b: a + b).alias("sums"), running(F.col("x"), 0, F.greatest).alias("tops"))
    got = {r.i: (r.sums, r.tops) for r in df.collect()}
    assert got == {i: ([sum(x[: j + 1]) for j in range(len(x))], [max(x[: j + 1]) for j in range(len(x))]) for i, x in rows}


def marked(text, spans):
    out, at = [], 0
    for s in spans:
        if s.begin >= at:
            out += [text[at : s.begin], "[SECRET]"]
        at = max(at, s.finish)
    return "".join(out) + text[at:]


def test_long_tokens_and_many_matches(spark):
    draw = random.Random(3)
    blob = base64.b64encode(draw.randbytes(750_000)).decode()
    many = "".join(f"é{'%016x' % draw.getrandbits(64)} token={'%012d' % i}x😀 " for i in range(20_000))
    keys = " ".join(base64.b64encode(draw.randbytes(30)).decode() for _ in range(3_000))
    texts = {1: blob, 2: many, 3: keys, 4: f"api_key = '{blob}' {'f' * 100_000}", 5: "A" * 200_000, 6: "", 7: "AKIA" * 30_000}
    began = time.perf_counter()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7, "doc_id")
    got = {r.doc_id: r for r in secret_spans(docs).withColumn("shown", redacted(F.col("text"), F.col("spans"))).collect()}
    assert time.perf_counter() - began < 60
    names = lambda i: [(s.begin, s.kind, s.finish) for s in got[i].spans]
    assert names(1) == [(0, 3, 1_000_000)] and names(5) == names(6) == []
    assert names(2) == sorted([(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", many)] + [(m.start(), 0, m.end()) for m in re.finditer("token=[0-9]+x", many)])
    assert len(names(3)) > 2_900 and names(4)[0] == (0, 0, len("api_key = '") + len(blob)) and names(7) == [(0, 1, 120_000)]
    assert all(got[i].shown == marked(t, got[i].spans) for i, t in texts.items())
