"""Near duplicates where rows share a doc_id, or have none."""

from quorumlens.llm import neardup

A = " ".join(f"a{i}" for i in range(100))
B = " ".join(f"b{i}" for i in range(100))


def rows_of(spark, rows):
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85, rows=7)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=str)


def test_texts_of_one_document(spark):
    """A document that stands in two rows links what is near to either."""
    got = rows_of(spark, [(1, A), (1, B), (2, A + " z"), (3, B + " z"), (4, "else")])
    assert got == [(1, 98, 1, True), (1, 98, 1, True), (2, 99, 1, False), (3, 99, 1, False), (4, 1, 4, True)]


def test_null_ids(spark):
    got = rows_of(spark, [(None, A), (7, A + " z"), (None, B), (None, B + " z"), (None, None), (9, "")])
    assert got == sorted([(None, 98, 7, False), (7, 99, 7, True), (None, 98, None, True), (None, 99, None, True), (None, 0, None, True), (9, 0, 9, True)], key=str)


def test_repeated_rows(spark):
    got = rows_of(spark, [(5, A)] * 30 + [(6, A + " z")] * 2)
    assert got == [(5, 98, 5, True)] * 30 + [(6, 99, 5, False)] * 2
