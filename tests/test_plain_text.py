"""Text without Han characters: no test per word that the expression makes itself."""

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import tokens


def test_plain_text_is_read_once_per_list(spark):
    """A document without Han characters needs neither their spaces removed nor a test of every run."""
    one = spark.createDataFrame([(1, "ab 12cd _e x9 the 3.5 Éa　\n fg;　;1hi j ")], "doc_id long, content string")
    col = F.col("content")
    found = one.select(text.document_tokens(col, ["the"], "letters", lower=True).alias("t"), text.sentence_words(col, "all_filters", ["the"], "letters").alias("w")).first()
    assert found["t"] == ["ab", "_e", "éa", "fg"]
    assert found["w"] == [["ab", "cd", "_e", "x9", "éa"], ["fg"], ["hi", "j"]]
    lists = tokens.sentence_word_lists(one, ["the"], "letters", lower=True).orderBy("idx").first()
    assert lists["words_no_filter"] == ["ab", "12", "cd", "_e", "x9", "the", "3.5", "éa"]
    assert lists["words_no_stop_words"] == ["ab", "12", "cd", "_e", "x9", "3.5", "éa"]
    assert lists["words_all_filters"] == ["ab", "cd", "_e", "x9", "éa"]
    assert "regexp_replace" not in one.select(text.sentences(col))._jdf.queryExecution().optimizedPlan().toString()
