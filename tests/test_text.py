import pytest
from pyspark.sql import functions as F

from inkwell.functions import han, text, vectors
from inkwell.operators import tokens


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


def test_sentences_split_and_trim_unicode_space(spark):
    value = "甲乙。　丙丁！……戊…己? x;y\n z.w"
    assert one(spark, value, text.sentences) == ["甲乙", "丙丁", "戊", "己", "x", "y", "z.w"]


@pytest.mark.parametrize("value", ["a\x1cb\x85", "  a b ", " \x1fz\t", "　", "x\r", " y\v"])
def test_trim_matches_python_strip(spark, value):
    assert one(spark, value, text.trim_space) == value.strip()
    assert one(spark, value, lambda c: text.strip_space(c, "all")) == "".join(value.split())


def test_space_between_han_only(spark):
    assert one(spark, "中 文 a b", text.strip_space) == "中文 a b"


def test_custom_delimiters(spark):
    assert one(spark, "a||b.c", lambda c: text.sentences(c, ["||", "."])) == ["a", "b", "c"]


def test_titles_and_document_numbers(spark):
    value = "依据《编制办法》及《编制办法》（建标[2006]279号）执行"
    assert one(spark, value, text.title_names) == ["编制办法"]
    assert one(spark, value, lambda c: text.drop_document_numbers(text.drop_titles(c))) == "依据及执行"
    two = "（甲1号）中间文字（乙2号）末"
    assert one(spark, two, text.drop_document_numbers) == "中间文字末"
    assert one(spark, two, lambda c: text.drop_document_numbers(c, greedy=True)) == "末"


def test_token_test(spark):
    words = ["城市", "市", "ab", "a_b", "a1", "été", "the", "x"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    kept = df.where(text.keep_token(F.col("t"), ["the"])).collect()
    assert [r["t"] for r in kept] == ["城市", "ab", "a_b"]
    kept = df.where(text.keep_token(F.col("t"), ["the"], "letters")).collect()
    assert [r["t"] for r in kept] == ["城市", "ab", "a_b", "été"]


def test_document_tokens(spark):
    value = "The abc123 naïve 3.14 don't 《Big Name》 城市轨道"
    assert one(spark, value, lambda c: text.document_tokens(c, ["The"])) == ["na", "ve", "don", "Big", "Name", "城市", "市轨", "轨道"]
    got = one(spark, value, lambda c: text.document_tokens(c, ["The"], titles=True, token_class="letters"))
    assert got == ["Big Name", "naïve", "don", "城市", "市轨", "轨道"]


def test_word_lists_of_a_sentence(spark):
    value = "The 3.5 cats and été2. dogs"
    docs = spark.createDataFrame([(1, value)], "doc_id long, content string")
    row = tokens.sentence_word_lists(docs, ["and", "the"], "letters", lower=True).first()
    assert row["words_no_filter"] == ["the", "3.5", "cats", "and", "été2", ".", "dogs"]
    assert row["words_no_stop_words"] == ["3.5", "cats", "été2", ".", "dogs"]
    assert row["words_all_filters"] == ["cats", "été2", "dogs"]
    for source in ("no_filter", "no_stop_words", "all_filters", "anything"):
        words = one(spark, value, lambda c: text.sentence_words(c, source, ["and", "the"], "letters"))
        assert words == [row[f"words_{source}"] if source != "anything" else row["words_no_stop_words"]]


def test_allowed_tags_decide_word_kinds(spark):
    value = "abc 12 城市"
    tagged = one(spark, value, lambda c: text.select_words(text.tagged_words(c), "all_filters", [], ["m", "n"]))
    assert tagged == ["12", "城市"]
    assert one(spark, value, lambda c: text.sentence_words(c, "all_filters", [], allowed_tags=["m", "n"])) == [tagged]


def test_keyword_line(spark):
    assert one(spark, "[a, b,c]", text.keyword_line) == ["a", " b", "c"]


@pytest.mark.parametrize(
    "raw", [b"abc", b"\xff\xfeabc", "né�城".encode(), b"\xc3(" + "�".encode() + b"\xe4\xbd", b"\xf0\x9f\x98\x80\xf0\x9f", b""]
)
def test_decode_matches_python_ignore(spark, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    assert df.select(text.decode_text(F.col("c")).alias("r")).first()["r"] == raw.decode("utf-8", "ignore")


def test_vector_text(spark):
    assert one(spark, "[0.1, 0.2,1e-3]", vectors.parse_vector) == [0.1, 0.2, 0.001]
    assert one(spark, "Row(oid='5c1f')", vectors.object_id) == "5c1f"


LEXICON = [("城市", "n"), ("城市轨道", "n"), ("轨道", "n"), ("交通", "v"), ("的", "uj")]


def test_segmenters_agree_with_each_other(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, tag string")
    rows = [(1, "城市轨道交通的abc1设计，概预算 12"), (2, ""), (3, "轨道城市"), (4, "plain words"), (5, "预"), (6, "城市的轨")]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    cut = han.segmenter(lexicon)
    local = docs.select("doc_id", cut(text.raw_runs(F.col("content"))).alias("pieces"))
    local = {r["doc_id"]: [tuple(p) for p in r["pieces"]] for r in local.collect()}
    joined = tokens.segment_runs(docs, lexicon).collect()
    assert local == {r["doc_id"]: [tuple(p) for p in r["pieces"]] for r in joined}
    assert local[1] == [
        ("城市轨道", "n"), ("交通", "v"), ("的", "uj"), ("abc1", "eng"), ("设计", "n"), ("概预", "n"), ("预算", "n"), ("12", "m"),
    ]
    assert local[5] == [("预", "n")]


def test_segmenter_checks_the_lexicon_size(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, tag string")
    with pytest.raises(ValueError):
        han.segmenter(lexicon, max_words=3)


def test_tokens_with_lexicon(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, tag string")
    docs = spark.createDataFrame([(1, "城市 轨道交通 的")], "doc_id long, content string")
    got = tokens.tokenize(docs, segment=han.segmenter(lexicon)).first()["tokens"]
    assert got == ["城市轨道", "交通"]


def test_window_pairs_and_vertices(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["x"])], "doc_id long, idx int, words array<string>")
    for window, want in {1: "ab bc", 2: "ab bc", 3: "ab bc ac", 9: "ab bc ac"}.items():
        got = [r["w1"] + r["w2"] for r in tokens.window_pairs(rows, window=window).orderBy("distance", "w1").collect()]
        assert got == want.split()
    lists = spark.createDataFrame([(1, [["b", "a"], ["a", "c", "b"]])], "doc_id long, words array<array<string>>")
    assert [(r["vertex"], r["word"]) for r in tokens.word_vertices(lists).collect()] == [(0, "b"), (1, "a"), (2, "c")]


def test_tag_filter(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(["run", "the", "été", "quick", "城市"])], "doc_id long, pos int, token string")
    lexicon = spark.createDataFrame([("run", "v"), ("the", "x"), ("城市", "n")], "word string, tag string")
    assert {r["token"] for r in tokens.with_allowed_tags(rows, lexicon).collect()} == {"run", "quick", "城市"}


def test_text_functions_on_a_stream(spark, tmp_path):
    from inkwell.plans.summaries import summaries
    from inkwell.streaming import stream_corpus

    rows = spark.createDataFrame([(1, "alpha beta gamma. one! alpha beta delta."), (2, "short")], "doc_id long, html string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = summaries(stream_corpus(spark, "parquet", str(tmp_path / "in"), rows.schema))
    query = stream.writeStream.format("memory").queryName("summaries").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = summaries(rows.select("doc_id", F.col("html").alias("content")))
    assert sorted(spark.table("summaries").collect()) == sorted(batch.collect())
