"""Operator 6: quotations of every level, and lines that only look like an announcement."""

from tidewright.llm import quotes


def test_deeper_quotations_link(spark):
    rows = [
        (1, 0, "u", "First thing. Bob wrote:"), (1, 1, "a", "Second thing."), (1, 2, "u", ">> First thing.\nThird."), (1, 3, "a", "> > > Third.\n>> Second thing.\nFourth."),
        (1, 4, "u", "Ann wrote:\n\n> Fourth.\n>> Third.\n>> First thing.\n>> fourth\nShe wrote:\nEnd."),
    ]
    by = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[0].own_text == "First thing. Bob wrote:" and by[4].own_text == "She wrote:\nEnd."
    assert [by[t].parent for t in range(5)] == [None, None, 0, 1, 3]
    assert [(by[t].n_quoted, by[t].n_linked) for t in range(5)] == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3)]
    assert [by[t].root for t in range(5)] == [0, 1, 0, 1, 1] and by[4].depth == 2


def test_long_messages_take_linear_work(spark):
    import time

    from tidewright.llm import quotes

    texts = {
        0: "\n".join(f"Plain line {i}." for i in range(40_000)),
        1: "\n".join(f"He wrote:\n> Line {i}.\nMine {i}." for i in range(4000)),
        2: "\n".join(">" * (i + 1) + f" Level {i}." for i in range(1000)),
        3: "\n".join("He wrote:\n\n" for _ in range(4000)) + "\n> Plain line 7.",
    }
    df = spark.createDataFrame([(1, i, "u", t) for i, t in texts.items()], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r.turn: r for r in quotes.link_quotes(df).collect()}
    assert time.time() - began < 60
    assert got[0].n_quoted == 0 and got[0].own_text.count("\n") == 39_999
    assert got[1].n_quoted == 4000 and "wrote" not in got[1].own_text and got[1].own_text.count("Mine") == 4000
    assert got[2].n_quoted == 1000 and got[2].own_text == ""
    assert got[3].own_text.count("wrote") == 3999 and got[3].parent == 0


def test_clashing_names_and_wild_line_ends(spark):
    from tidewright.llm import quotes

    rows = [(1, 0, "u", "One.\r\nTwo.", 1, "a"), (1, 1, "v", "\r\n> one!\r\n\t> > two?\nMe.\r\n", 2, "b"), (1, 1, "v", "\r\n> one!\r\n\t> > two?\nMe.\r\n", 2, "b"), (None, 2, None, None, 3, "c"), (1, None, "u", "> One.", 4, "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent int, own_text string")
    got = sorted(((r.conv_id, r.turn, r.own_text, r.n_quoted, r.n_linked, r.parent) for r in quotes.link_quotes(df).collect()), key=repr)
    assert got == sorted([(1, 0, "One.\r\nTwo.".replace("\r", ""), 0, 0, None), (1, 1, "Me.", 2, 2, 0), (1, 1, "Me.", 2, 2, 0), (None, 2, "", 0, 0, None), (1, None, "", 1, 0, None)], key=repr)
