import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import aggregates, clusters, features, joins, topics
from inkwell.plans import clustering, topic_modelling
from inkwell.sources import corpus


@pytest.fixture(scope="module")
def tokenized(spark):
    sport = "ball goal team match player".split()
    food = "bread cheese oven salt soup".split()
    rows = [(i, [(sport if i % 2 else food)[(i * j) % 5] for j in range(1, 9)] + ["common"]) for i in range(60)]
    rows += [(60, []), (61, ["common"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3).cache()


def test_hot_terms_are_sharded_without_changing_tfidf(tokenized):
    plain = sorted(features.tfidf(tokenized).collect())
    sharded = features.tfidf(tokenized, shard_rows=4)
    assert sorted(sharded.collect()) == plain
    common = [r for r in plain if r["term"] == "common"]
    assert len(common) == 61 and common[0]["tfidf"] == pytest.approx(np.log(63 / 62))


def test_join_counted_places_hot_rows_in_every_shard(spark):
    facts = spark.range(1000).select(F.col("id"), (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"))
    keyed = facts.groupBy("k").agg(F.count("*").alias("n"))
    joined = joins.join_counted(facts, keyed, "k", "id", F.col("n"), shard_rows=10)
    assert joined.count() == 1000
    assert joined.where("k = 0").select("n").distinct().collect()[0]["n"] == 334


@pytest.mark.parametrize("rows_per_range", [7, 1_000_000])
def test_lists_are_laid_end_to_end_whatever_a_key_holds(spark, rows_per_range):
    rows = [("hot", i, [f"h{i}a", f"h{i}b"]) for i in range(300)] + [("cold", 1, ["x"]), ("cold", 0, ["y"]), ("none", 0, None), ("void", 0, []), (None, 1, ["n"])]
    df = spark.createDataFrame(rows, "k string, at long, items array<string>")
    got = {}
    for r in aggregates.concat_lists(df, "k", "items", "at", rows_per_range).orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append((r["pos"], r["value"]))
    hot = [x for _, _, items in rows[:300] for x in items]
    assert got == {"hot": list(enumerate(hot)), "cold": [(0, "y"), (1, "x")], None: [(0, "n")]}
    assert aggregates.concat_lists(df.limit(0), "k", "items", "at").count() == 0


def test_count_and_idf_entries_equal_the_models(spark, tokenized):
    model = features.count_vectorizer(tokenized)
    counted = model.transform(tokenized)
    weighted = features.idf().fit(counted).transform(counted)
    entries = features.sparse_entries(weighted, "idf").collect()
    got = {(r["doc_id"], model.vocabulary[r["index"]]): r["value"] for r in entries}
    want = {(r["doc_id"], r["term"]): r["tfidf"] for r in features.idf_entries(tokenized).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    terms = features.vocabulary(tokenized).orderBy("index").collect()
    assert [r["index"] for r in terms] == list(range(len(terms)))
    assert [(r["df"], r["term"]) for r in terms] == sorted(((r["df"], r["term"]) for r in terms), key=lambda t: (-t[0], t[1]))


def test_vocabularies_have_no_cap(spark):
    words = spark.range(300_000).groupBy((F.col("id") % 100).alias("doc_id")).agg(F.collect_list(F.format_string("w%d", "id")).alias("tokens"))
    terms = features.vocabulary(words)
    assert terms.count() == terms.select("index").distinct().count() == 300_000
    assert features.count_entries(words, terms).count() == 300_000


def test_words_are_hashed_only_when_asked(tokenized):
    words = features.hashed_words(tokenized, 4).select(F.explode("tokens").alias("w"))
    assert words.select("w").distinct().count() <= 4
    assert words.count() == tokenized.select(F.explode("tokens")).count()


@pytest.fixture(scope="module")
def model(tokenized):
    return topics.fit_topics(tokenized, k=3, max_iter=10)


def test_topics(tokenized, model):
    described = topics.describe_topics(model, 5).collect()
    vocabulary = set(model.stages[0].vocabulary)
    assert [r["topic"] for r in described] == [0, 1, 2]
    for row in described:
        assert len(row["words"]) == 5 and set(row["words"]) <= vocabulary
        assert row["term_weights"] == sorted(row["term_weights"], reverse=True)


def test_distributions(tokenized, model):
    rows = {r["doc_id"]: r for r in topics.assign_topics(model, tokenized).collect()}
    assert len(rows) == 62 and rows[60]["topic_num"] is None and sum(rows[60]["topic_distribution"]) == 0
    for doc, row in rows.items():
        if doc != 60:
            assert sum(row["topic_distribution"]) == pytest.approx(1, abs=1e-6)
            assert row["topic_num"] == int(np.argmax(row["topic_distribution"]))


def test_other_corpora_use_the_training_vocabulary(spark, tokenized, model):
    words = tokenized.where("doc_id = 3").first()["tokens"]
    rows = [(3, words)] + [(100 + i, [f"new{i}", f"word{i}"] + words[:2]) for i in range(200)]
    other = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    got = topics.assign_topics(model, other).where("doc_id = 3").first()["topic_distribution"]
    want = topics.assign_topics(model, tokenized).where("doc_id = 3").first()["topic_distribution"]
    assert got == pytest.approx(want, abs=1e-9)


def test_models_reload(tokenized, model, tmp_path):
    topics.save_model(model, str(tmp_path / "m"))
    loaded = topics.load_model(str(tmp_path / "m"))
    a = topics.assign_topics(model, tokenized).orderBy("doc_id").collect()
    b = topics.assign_topics(loaded, tokenized).orderBy("doc_id").collect()
    assert a == b


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_hashing_and_weighting_options(tokenized, optimizer):
    model, labelled = topic_modelling.hashing_idf_topics(
        tokenized, k=2, weighting="tfidf", optimizer=optimizer, max_iter=3, vocab_size=64
    )
    assert model.stages[-1].getFeaturesCol() == "idf"
    assert labelled.count() == 62
    assert topics.describe_topics(model, 3).first()["words"] is None


def test_clusters(spark, tokenized, tmp_path):
    rows = clusters.cluster_word_lists(tokenized, k=3, seed=7, partitions=2).select("doc_id", "prediction").collect()
    assert len(rows) == 62 and {r["prediction"] for r in rows} <= {0, 1, 2}
    docs = spark.createDataFrame([(1, "one two three! four five six? one two"), (2, "seven")], "doc_id long, content string")
    for unit in ("word", "sentence"):
        assert clustering.sentence_clusters(docs, unit, k=2).count() == 4
    tokenized.select(F.concat(F.lit("["), F.concat_ws(",", "tokens"), F.lit("]"))).write.text(str(tmp_path / "t"))
    assert clustering.keyword_line_clusters(spark, str(tmp_path / "t"), k=2, vector_size=4).count() == 62


def test_corpus_shaping(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None), (1, "a"), (4, "")], "doc_id long, html string")
    docs = corpus.corpus(df)
    assert sorted(corpus.clean(docs).collect()) == [(1, "a"), (2, "b"), (4, "")]
    assert corpus.nonempty(docs).count() == 3
    assert [r["doc_id"] for r in corpus.first_documents(docs, 2).collect()] == [1, 1]
    assert corpus.remap(df).columns == ["doc_id", "title", "time", "html", "org"]
    nested = df.select(F.struct(F.col("doc_id").cast("string").alias("oid")).alias("_id"), "html")
    assert corpus.corpus(nested, id_col="_id.oid").first()["doc_id"] == "2"
    corpus.save(df, str(tmp_path / "out"), "json")
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.save(df, str(tmp_path / "out"), "json")
