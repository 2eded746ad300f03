"""Quoted passages of any length link within their conversation."""

from millrace.llm.chat_quotes import link_replies


def test_short_quotes_link_within_their_conversation(spark):
    rows = [(1, 0, "u", "ship it"), (1, 1, "u", "yes, do it"), (1, 2, "u", "> yes, do it\nDone."), (1, 3, "u", "> ship it\nShipped."), (2, 0, "u", "> ship it\nhere too")]
    got = {(r.conv_id, r.turn): r for r in link_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.parent_turn, r.root_turn, r.n_linked) for k, r in got.items()} == {(1, 0): (None, 0, 0), (1, 1): (None, 1, 0), (1, 2): (1, 1, 1), (1, 3): (0, 0, 1), (2, 0): (None, 0, 0)}
