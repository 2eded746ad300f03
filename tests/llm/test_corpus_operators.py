"""Pages, conversations, benchmark, toxicity, mixing and the pipeline against brute force, held-out labels and edge cases."""

import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.boosting import boost, isotonic
from millrace.llm.chat_quotes import link_replies
from millrace.llm.decontaminate import B, K1, PIECE, THRESHOLD, benchmark_hits, build_index, split_words
from millrace.llm.html_extract import extract_pages, nearest_pages, page_lines, shared_lines, url_key
from millrace.llm.mixing import mix_sources, probabilities, raked
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.secret_scan import secret_spans

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def lines(page):
    return [x for x, _ in page_lines(page)]


def test_page_lines():
    assert lines("<body><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a <b>b</b>\n c<br>d<p>e</article><footer>f</footer>") == ["T & U", "a b c d", "e"]
    assert lines("<article><p>one<div class='comments'><p>no</p></div><p>two &lt;b&gt; &#8364;&hellip;<form>q<input>r</form></article>") == ["one", "two <b> €…"]
    assert lines("<article><script>if (a<b && '</p>') {}</script><style>p{}</style><p>kept<!-- <p>no --></p><aside>no</aside><p>cut &am") == ["kept", "cut &am"]
    assert lines("<article><p>end &amp") == ["end &"]
    assert lines("<div class='has-sidebar'><p>main</p><div id=sidebar>no</div></div><p hidden>no</p><p style='display:none'>no</p>") == ["main"]
    assert lines("a < b and c > d") == ["a < b and c > d"]
    assert lines("") == lines("<p></p>") == lines("<!DOCTYPE html><head><title>no</title></head>") == []
    assert page_lines("<p>x</p><main><p>y</p></main>") == [("x", 0), ("y", 1)]
    assert lines("<article>" + "<p>w" * 5000 + "<b" * 3) == ["w"] * 5000


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(500):
        a, b = (rng.integers(0, 4, rng.integers(0, 10)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        got = shared_lines(a, b)
        rest = iter(b)
        assert len(got) == table[-1, -1] and got == sorted(set(got)) and all(a[i] in rest for i in got)


PAGES = [
    (1, "http://h.example/a/1?q", "<p>Home</p><p>first story</p><p>Contact</p>"),
    (2, "https://H.example/a/2#x", "<p>Home</p><p>second story</p><p>Contact</p>"),
    (3, "http://h.example/b/9", "<p>Home</p><article><p>Home</p></article><p>Contact</p>"),
    (4, "http://alone.example/", "<p>Home</p><p>alone</p>"),
    (5, None, None),
    (None, "no url", "<p>null id</p>"),
    (4, "http://alone.example/", "<p>Home</p><p>alone</p>"),
]


def test_differencing_deletes_lines_that_the_nearest_page_shares(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, lines string")
    got = Counter((r.page_id, r.text) for r in extract_pages(df).collect())
    assert got == Counter([(1, "first story"), (2, "second story"), (3, "Home"), (4, "Home\nalone"), (5, ""), (None, "null id"), (4, "Home\nalone")])
    assert extract_pages(df.limit(0)).count() == 0


def test_nearest_pages_do_not_depend_on_partitions(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").select(*url_key(), F.col("page_id").cast("string").alias("row_id"))
    found = []
    for n in ("1", "8", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.row_id: r.partner_id for r in nearest_pages(rows).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2]
    by_host = Counter(r.host for r in rows.collect())
    assert sum(v is None for v in found[0].values()) == sum(n for n in by_host.values() if n == 1)


def test_articles_of_the_pages_table(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op2_html_extraction(spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.sub(r"<footer>.*", "", p.html.split("<article>", 1)[1].split("</article>")[0], flags=re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:h1|p|/p|/h1)>", article)]
        text = "\n".join(x for x in blocks if x)
        assert got[p.page_id] == (text, len(text))


CHAT = [
    (1, 0, "user", "How do I bake bread at home?\nAny advice on flour?"),
    (1, 1, "assistant", "> How do I bake bread at home?\n\nMix, knead, and wait for an hour."),
    (1, 2, "user", "Ann wrote:\n> > How do I bake bread at home?\n> Mix, knead, and wait for an hour.\n\nWhich oven temperature works?"),
    (1, 3, "user", "> Any advice on flour?\nStrong flour is best for that."),
    (1, 4, "assistant", ">  MIX,  knead, and wait for an hour.\nNo, two hours are better."),
    (2, 0, "user", "> Strong flour is best for that.\nIs that so? I doubt it."),
    (2, 1, "user", "nothing quoted here"),
    (3, 0, "user", "> a line that nobody ever wrote\nhm"),
    (4, 0, None, None),
    (None, 1, "user", "> How do I bake bread at home?\nlost"),
    (1, 0, "user", "How do I bake bread at home?\nAny advice on flour?"),
]


def test_quotes_link_replies(spark):
    rows = link_replies(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(CHAT)
    got = {(r.conv_id, r.turn): r for r in rows}
    parents = {k: (r.parent_conv, r.parent_turn) for k, r in got.items() if r.parent_conv is not None}
    assert parents == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (1, 4): (1, 1), (2, 0): (1, 3)}
    assert got[1, 2].own_text == "\nWhich oven temperature works?".strip() and got[1, 1].own_text == "Mix, knead, and wait for an hour."
    assert (got[1, 2].n_quotes, got[1, 2].n_linked, got[3, 0].n_linked) == (2, 2, 0)
    assert {k: (r.root_conv, r.root_turn, r.depth) for k, r in got.items() if k in ((1, 4), (2, 0), (2, 1))} == {(1, 4): (1, 0, 2), (2, 0): (1, 0, 2), (2, 1): (2, 1, 0)}
    thread = sorted((r for r in got.values() if (r.root_conv, r.root_turn) == (1, 0)), key=lambda r: r.position)
    assert [(r.conv_id, r.turn) for r in thread] == [(1, 0), (1, 1), (1, 2), (1, 4), (1, 3), (2, 0)]
    assert got[4, 0].own_text == "" and got[None, 1].parent_conv is None


def test_conversations_without_quotes_are_unchanged(spark):
    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = queries.op3_chat_formatting(spark, DATA).collect()
    assert {(r.conv_id, r.turn): r.own_text for r in got} == {k: t.strip("\n") for k, t in rows.items()} and all(r.depth == 0 for r in got)
    empty = spark.read.parquet(f"{DATA}/conversations.parquet").limit(0)
    assert link_replies(empty).count() == 0


def test_long_reply_chains(spark):
    rows = [(7, 0, "u", "message number zero of the chain")]
    for i in range(1, 40):
        rows.append((7, i, "u", f"> {rows[-1][3].splitlines()[-1]}\nmessage number {i} of the chain"))
    got = {r.turn: r for r in link_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[i].depth == i and got[i].root_turn == 0 for i in range(40))


def test_search_finds_what_exhaustive_scoring_finds(spark):
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index, checks = build_index(items)
    held = [split_words([t]).hash[:PIECE] for _, t in items]
    df = Counter(x for t in held for x in set(t.tolist()))
    mean = np.mean([len(t) for t in held])
    idf = {x: np.log1p((len(held) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    impacts = []
    for t in held:
        tf = Counter(t.tolist())
        w = {x: idf[x] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(t) / mean)) for x, n in tf.items()}
        impacts.append({x: v / sum(w.values()) for x, v in w.items()})
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(150).collect()] + [b"", b" \n", items[0][1], items[1][1][: len(items[1][1]) // 2] + items[2][1]]
    got = {(d, p): s for part in index for d, p, s in part.search(split_words(texts))}
    want = {}
    for d, text in enumerate(texts):
        h = split_words([text]).hash.tolist()
        for begin in range(0, max(len(h), 1), PIECE):
            passage = set(h[begin : begin + 2 * PIECE])
            for p, w in enumerate(impacts):
                score = sum(v for x, v in w.items() if x in passage)
                if score >= THRESHOLD:
                    want[d, p] = max(want.get((d, p), 0), score)
    assert set(got) == set(want) and len(want) > 3
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_leaks_are_found_and_nothing_else(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    flat = lambda t: f" {' '.join(re.findall('[0-9a-z\x80-\U0010ffff]+', t.lower()))} "
    want = {(d, i) for i, x in items.items() for d, t in docs.items() if flat(x) in flat(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op10_benchmark_decontamination(spark, DATA).collect()}
    assert want and got == want


def test_decontamination_edge_cases(spark):
    item = "Which of the seven old clocks in the tower strikes thirteen? The third clock."
    long = " ".join(f"term{i}" for i in range(150)) + ". End of it."
    items = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, long), (5, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item}*** y", 0), (2, None, 0), (3, "", 0), (None, item.upper(), 0), (4, "Which of the seven old clocks", 0), (5, " ".join(long.split()[:30]), 0), (6, f"before {long}", 0), (1, f"x {item} y", 0)], "doc_id long, text string, hits int")
    got = Counter((r.doc_id, tuple(h.item_id for h in r.hits)) for r in benchmark_hits(docs, items).collect())
    assert got == Counter([(1, (1, 5)), (1, (1, 5)), (2, ()), (3, ()), (None, (1, 5)), (4, ()), (5, ()), (6, (4,))])
    assert benchmark_hits(docs, items.limit(0)).where("size(hits) > 0").count() == 0 and benchmark_hits(docs.limit(0), items).count() == 0


def test_boosting_learns_and_isotonic_is_monotone():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boost(x[:1000], y[:1000])
    assert ((model.margin(x[1000:]) > 0) == y[1000:]).mean() > 0.95
    knots, levels = isotonic(model.margin(x), y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and 0 <= levels.min() <= levels.max() <= 1
    m = np.array([0.0, 1, 2, 3, 4])
    assert isotonic(m, np.array([0.0, 1, 0, 1, 1]))[1].tolist() == [0, 0.5, 1.0]


def test_toxicity_on_held_out_labels(spark):
    source = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{source}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, source).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = ([s for s, t, _ in held if t == k] for k in (1, 0))
    assert np.mean([np.mean(np.array(good) < s) + 0.5 * np.mean(np.array(good) == s) for s in bad]) > 0.97
    flagged = [t for _, t, p in held if p]
    assert np.mean(flagged) > 0.95 and sum(flagged) > 0.85 * len(bad)


def test_toxicity_edge_cases(spark, tmp_path):
    rows = [(i, ("you are an idiot " if i % 4 == 0 else "a fine day ") + f"word{i % 7} " * 5, "x") for i in range(200)] + [(None, "idiot", "x"), (500, None, "x"), (501, "", "x"), (502, "IDIOT " * 30000, "x"), (3, "a fine day", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    verdict = {r.doc_id: r.predicted for r in got if r.doc_id is not None and 150 <= r.doc_id < 200}
    assert verdict == {i: int(i % 4 == 0) for i in range(150, 200)}
    spark.createDataFrame([], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert {r.score for r in queries.op9_toxicity(spark, str(tmp_path)).collect()} == {0.0}


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(6)
    cells = {(a, b, c): float(rng.integers(1, 1000)) for a in "pq" for b in "xyz" for c in "mn"}
    goals = [{"p": 0.3, "q": 0.7}, {"x": 0.2, "y": 0.5, "z": 0.3}, {"m": 0.6, "n": 0.4}]
    weight = raked(cells, goals)
    for i, goal in enumerate(goals):
        for v, share in goal.items():
            assert abs(sum(w for c, w in weight.items() if c[i] == v) - share) < 1e-6
    p = probabilities(cells, weight, 0.4)
    assert all(0 <= x <= 1 for x in p.values()) and abs(sum(p[c] * cells[c] for c in cells) - 0.4 * sum(cells.values())) < 1e-6


def test_mixing_samples_by_calibrated_probabilities(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a = mix_sources(docs, 0.5, {"lang": {"en": 0.4}}).collect()
    b = mix_sources(docs.repartition(7), 0.5, {"lang": {"en": 0.4}}).collect()
    assert sorted(r.doc_id for r in a) == sorted(r.doc_id for r in b)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect())
    assert abs(sum(r.n_tokens for r in a) / total - 0.5) < 0.06 and abs(sum(r.n_tokens * r.weight for r in a) / total - 1) < 0.12
    english = sum(r.n_tokens for r in a if r.lang == "en") / sum(r.n_tokens for r in a)
    assert abs(english - 0.4) < 0.06
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r["topic"] for r in a)


def test_mixing_edge_cases(spark):
    rows = [(i, "a b c", None if i % 2 else "s", "l", 1) for i in range(100)] + [(None, "x", "s", None, 1), (100, None, "s", "l", 1), (5, "a b c", None, "l", 1), (5, "a b c", None, "l", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    got = mix_sources(docs, 1.0).collect()
    assert len(got) >= len(rows) - 1 and all(r.probability > 0 for r in got)
    assert mix_sources(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage was given and returned, over the smallest tables."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline_stages(spark, stages):
    columns = corpus_pipeline.COLUMNS
    assert all(after.columns == columns for _, after in stages[:-1]) and set(columns) <= set(stages[-1][1].columns)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = set(ids(stages[0][1]))
    assert all(i in kept for i, t in labels.items() if t == 0)
    before, after = stages[1]
    assert ids(after) == sorted(r.doc_id for r in near_duplicates(before).where("kept").collect())
    before, after = stages[2]
    flat = lambda t: f" {' '.join(re.findall('[0-9a-z\x80-\U0010ffff]+', t.lower()))} "
    items = [flat(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not any(x in flat(r.text) for x in items))
    before, after = stages[3]
    assert ids(after) == ids(before) and secret_spans(after).where("size(spans) > 0").count() == 0
    clean = {r.doc_id: r.text for r in secret_spans(before).where("size(spans) = 0").collect()}
    assert all(r.text == clean[r.doc_id] for r in after.collect() if r.doc_id in clean) and after.where("n_chars <> length(text)").count() == before.where("n_chars <> length(text)").count()
    before, after = stages[4]
    assert set(ids(after)) <= set(ids(before)) and all(0 < r.probability <= 1 for r in after.collect())


def test_pipeline_run_is_its_stages(spark, stages):
    assert ids(corpus_pipeline.run(spark, SMALL)) == ids(stages[-1][1])
