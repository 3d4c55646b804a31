"""Terms are counted inside a document's row: nothing of them is shuffled."""

from inkwell.operators import features


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_terms_are_counted_without_a_shuffle(spark):
    rows = [(1, ["b", "a", "b", None]), (2, None), (3, []), (None, ["a"]), (4, ["", "a"])]
    found = features.term_frequency(_docs(spark, rows))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "a", 1), (1, "b", 2), (None, "a", 1), (4, "", 1), (4, "a", 1)}


def test_rows_of_one_id_are_counted_together(spark):
    rows = [(1, ["a", "b"]), (1, ["a"]), (None, ["c"]), (None, ["c"]), (2, ["a"]), (3, None), (3, ["d"])]
    found = features.term_frequency(_docs(spark, rows))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 2), (1, "b", 1), (None, "c", 2), (2, "a", 1), (3, "d", 1)], key=str)
