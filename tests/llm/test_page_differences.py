"""Page differencing against brute force, with articles and without, copies, very long pages and repeated runs."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import html_extract
from millrace.llm.html_extract import extract_pages, near, nearest_pages, page_lines, shared_lines


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_halving_finds_a_longest_common_subsequence(monkeypatch):
    monkeypatch.setattr(html_extract, "ALIGN_BITS", 12)
    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(25))] for _ in range(2))
        got, rest = shared_lines(a, b), iter(b)
        assert len(got) == lcs_length(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_very_long_pages_align_in_little_memory():
    import tracemalloc

    draw = np.random.default_rng(4)
    a, b = (draw.integers(0, 1 << 40, 30_000).tolist() for _ in range(2))
    a[::3] = b[::3] = range(10_000)
    tracemalloc.start()
    got = shared_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20 and len(got) == 10_000
    tracemalloc.stop()


def site(draw, n, article):
    pages = []
    for i in range(n):
        own = [f"<p>text {draw.randrange(1 << 30)} of page {i}</p>" for _ in range(draw.randrange(1, 4))]
        body = "".join(own)
        host, path = f"h{draw.randrange(3)}.example", f"{draw.choice('ab')}/{draw.randrange(40)}"
        frame = "<p>Home</p>", f"<p>Contact {host}</p><p>Rights</p>"
        pages.append((i, f"http://{host}/{path}", frame[0] + (f"<article>{body}</article>" if article else body) + frame[1]))
        if draw.random() < 0.3:
            pages.append((1000 + i, f"http://{host}/{draw.choice('ab')}/{draw.randrange(40)}", pages[-1][2]))
    return pages


def brute(pages):
    def key(url):
        host, _, path = url.removeprefix("http://").partition("/")
        return host, "/" + path

    found = {p: (*key(p[1]), page_lines(p[2])) for p in set(pages)}
    out = {}
    for p, (host, _, lines) in found.items():
        texts = {}
        for q, (h, path, other) in found.items():
            if h == host:
                texts.setdefault(tuple(x for x, _ in other), []).append((path, row_ids[q], q))
        firsts = sorted(min(copies) for copies in texts.values())
        at = next(i for i, f in enumerate(firsts) if f == min(texts[tuple(x for x, _ in lines)]))
        partner = None
        for f in (firsts[at - 1] if at else None, firsts[at + 1] if at + 1 < len(firsts) else None):
            if f and (partner is None or near(f[0], firsts[at][0]) > near(partner[0], firsts[at][0])):
                partner = f
        shared = set(shared_lines([x for x, _ in lines], [x for x, _ in found[partner[2]][2]])) if partner else set()
        kept = [x for i, (x, main) in enumerate(lines) if main or i not in shared]
        out[p] = "\n".join(kept or [x for x, _ in lines])
    return out


row_ids: dict = {}


def test_texts_equal_brute_force(spark):
    for article in (False, True):
        pages = site(random.Random(5), 60, article)
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
        ids = df.withColumn("row_id", F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.xxhash64("url").cast("string"), "html").cast("binary")))
        row_ids.update({(r.page_id, r.url, r.html): r.row_id for r in ids.collect()})
        got = {r.page_id: r.text for r in extract_pages(df).collect()}
        want = {p[0]: t for p, t in brute(pages).items()}
        assert got == want and all("Home" not in t for t in want.values())


def test_copies_and_repeated_ids_keep_their_text(spark):
    story = "<h1>Story</h1><p>The whole main text</p>"
    pages = [(1, "http://h/a", story), (2, "http://h/b", story), (3, "http://k/x", "<p>nav</p><p>main text one</p>"), (3, "http://k/x", "<p>nav</p><p>main text two</p>"), (4, "http://m/1", "<p>a</p>"), (5, "http://m/2", "<p>a</p><p>b</p>")]
    got = extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "Story\nThe whole main text"), (2, "Story\nThe whole main text"), (3, "main text one"), (3, "main text two"), (4, "a"), (5, "b")]


def test_neighbours_are_the_same_in_every_run(spark):
    rows = spark.range(100_000).select(F.concat(F.lit("h"), (F.col("id") % 3).cast("string")).alias("host"), F.md5(F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("row_id"))
    listed = sorted((r.host, r.path, r.row_id) for r in rows.collect())
    want = {}
    for i, (host, path, row) in enumerate(listed):
        best = None
        for other in (listed[i - 1] if i else None, listed[i + 1] if i + 1 < len(listed) else None):
            if other and other[0] == host and (best is None or near(other[1], path) > near(best[1], path)):
                best = other
        want[row] = best and best[2]
    for n in (8, 30):
        assert {r.row_id: r.partner_id for r in nearest_pages(rows.repartition(n)).collect()} == want
