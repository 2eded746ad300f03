"""Quoted conversations of some size against plain Python, and the plan that links them."""

import random

from pyspark.sql import functions as F

from millrace.llm.chat_quotes import link_replies

SCHEMA = "conv_id long, turn long, role string, text string"


def quoted_table(n, seed=3):
    """Messages with lines of their own that reply to earlier ones of their conversation or of another, and the parents."""
    draw, rows, parents, says = random.Random(seed), [], {}, {}
    for c in range(n):
        for t in range(draw.randrange(1, 8)):
            own = f"Message {t} of {c} says {draw.randrange(1 << 40)} in full."
            key, parent = (c, t), None
            if t and draw.random() < 0.6:
                parent = (c, draw.randrange(t))
            elif c and draw.random() < 0.5:
                parent = (0, 0) if draw.random() < 0.6 else draw.choice([k for k in says if k[0] < c])
            text = own if parent is None else f"Someone wrote:\n>  {says[parent].upper()}\n> > a line that none has said {key}\n\n{own}"
            rows.append((*key, "user", text))
            says[key], parents[key] = own, parent
    return rows, parents, says


def brute_threads(parents):
    children, out = {}, {}
    for k, p in parents.items():
        children.setdefault(p, []).append(k)
    for root in children.get(None, []):
        stack, n = [(root, 0)], 0
        while stack:
            k, depth = stack.pop()
            out[k] = (root, depth, n)
            n += 1
            stack += [(x, depth + 1) for x in sorted(children.get(k, []), reverse=True)]
    return out


def test_threads_equal_plain_python(spark):
    rows, parents, says = quoted_table(150)
    got = {(r.conv_id, r.turn): r for r in link_replies(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()}
    assert {k: None if r.parent_conv is None else (r.parent_conv, r.parent_turn) for k, r in got.items()} == parents
    assert {k: ((r.root_conv, r.root_turn), r.depth, r.position) for k, r in got.items()} == brute_threads(parents)
    assert all(r.own_text == says[k] and r.n_quotes == (2 if parents[k] else 0) and r.n_linked == (parents[k] is not None) for k, r in got.items())


def test_ties_large_numbers_long_texts_and_other_columns(spark):
    big = 10**17
    long = "\n".join(f"line {i} of a long text" for i in range(20_000))
    rows = [
        (1, big, "u", "first line here\nsecond line there", 0), (1, big + 1, "u", "third line elsewhere", 0),
        (1, big + 2, "u", "> first line here\nx\n> third line elsewhere\ny", 0), (1, big + 3, "u", "> first line here\n> second line there\nz", 0),
        (2, 5, "u", "a reply in two", 0), (2, 6, "u", "> first line here\n> second line there\nsame turn", 0), (3, 6, "u", "> first line here\n> second line there\nsame turn too", 0),
        (4, 0, "u", long, 0), (4, 1, "u", "> " + long.replace("\n", "\n> ") + "\nall of it", 0), (4, 2, "u", ">" * 50_000, 0),
    ]
    got = {(r.conv_id, r.turn): r for r in link_replies(spark.createDataFrame(rows, SCHEMA + ", root_conv long")).collect()}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items() if r.parent_conv is not None}
    assert parent == {(1, big + 2): (1, big + 1), (1, big + 3): (1, big), (2, 6): (1, big), (3, 6): (1, big), (4, 1): (4, 0)}
    order = sorted((r for r in got.values() if (r.root_conv, r.root_turn) == (1, big)), key=lambda r: r.position)
    assert [(r.conv_id, r.turn, r.position) for r in order] == [(1, big, 0), (1, big + 1 + 2, 1), (2, 6, 2), (3, 6, 3)]


def test_a_message_with_very_many_replies(spark):
    rows = [(0, 0, "u", "the message that everybody quotes")] + [(i, 1, "u", f"> the message that everybody quotes\nreply {i}") for i in range(1, 5001)]
    out = link_replies(spark.createDataFrame(rows, SCHEMA))
    assert out.where("depth = 1 and root_conv = 0 and position = conv_id").count() == 5000 and out.agg(F.max("position")).first()[0] == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Window" not in plan
