"""Cleaning keeps the paragraphs of a text."""

from quorumlens.llm import quality

A, B, C = ("one plain line of prose that goes on for a while.", "the next one, which is no shorter than that one was.", "a third to end the text with words enough in it.")
CASES = [
    (f"{A}\n\n{B}\n \n{C}\n", f"{A}\n\n{B}\n \n{C}\n"),
    (f"{A}\n\nHome\n{B}\n\n\n{A}\n\n{C}", f"{A}\n\n{B}\n\n\n\n{C}"),
    (f"{A}\nHome\n{B}\n{A}\n{C}", f"{A}\n{B}\n{C}"),
    ("\n\n", "\n\n"),
    (None, ""),
]


def test_blank_lines_stay(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.clean_lines(d).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i]["clean_text"] == want, i
    assert got[0]["kept"] and got[1]["n_failed_lines"] == 2 and got[0]["n_failed_lines"] == 0
