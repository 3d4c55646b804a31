"""Language ID and quality: held-out accuracy, and the defined results of odd rows."""

import numpy as np
import pytest

from inkwell.llm import language_id, quality
from inkwell.llm.queries import QUERIES, held_out

ODD = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "x" * 300_000), (6, "the of and"), (6, "the of and"), (None, "the of and")]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 30])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert len(code) == n and (n < 2 or min(apart) >= max(1, code.shape[1] // 4))


def test_languages_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op2_language_id"](spark, small).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_is_predicted_from_text_alone(spark, small, frame):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs.where(~held_out()))
    got = {r.doc_id: r for r in language_id.predict(frame(ODD), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[6].lang_pred == "en"
    assert sorted(r.doc_id for r in language_id.accepted(frame(ODD), model).where("doc_id IN (1, 2, 3, 6)").collect()) == [6, 6]
    assert language_id.predict(frame([]), model).count() == 0
    nothing = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(frame(ODD), nothing).collect()} == {"und"}


def test_ambiguous_texts_are_flagged():
    model = language_id.Model(["a", "b"], np.array([[1.0], [-1.0]]), np.array([[1.0], [0.0]], np.float32), np.ones((2, 1)))
    best, score, ambiguous = language_id.decode(model, np.array([[2.0], [-2.0], [0.001], [0.0]], np.float32))
    assert best.tolist() == [0, 1, 0, 0] and ambiguous.tolist() == [False, False, True, True] and score[0] > 0.9 > score[3]


def test_quality_of_held_out_documents(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = QUERIES["op5_quality"](spark, small).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    good, bad = ([r.score for r in rows if r.quality == q and r.held_out] for q in (1, 0))
    assert not bad or np.mean([a > b for a in good for b in bad]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_odd_rows(spark, small, frame):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.selectExpr("doc_id", "quality", "'no' AS text").unionByName(spark.sql("SELECT -5L doc_id, CAST(NULL AS INT) quality, '' text")))
    got = quality.score(frame(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and quality.score(frame([]), model).count() == 0
    prior = quality.fit(docs, labels.where("quality = 1"))
    assert len({r.score for r in quality.score(frame(ODD), prior).collect()}) == 1


def test_descent_separates_a_small_table():
    sets = [np.array([0, i % 3 + 1]) for i in range(30)] + [np.array([0, i % 3 + 4]) for i in range(30)]
    y = np.array([1] * 30 + [0] * 30)
    model = quality.learn(sets, y, 0.5, bins=8)
    value = np.array([model.weights[s].sum() + model.intercept for s in sets])
    assert ((model.slope * value + model.shift > 0) == (y == 1)).all()


def test_quality_reads_one_row_of_a_repeated_id(spark, frame, monkeypatch):
    given = []
    monkeypatch.setattr(quality, "learn", lambda sets, y, prior: given.append(([s.tolist() for s in sets], y.tolist(), prior)))
    rows = [(1, f"copy {i}") for i in range(40)] + [(1, None)] + [(i, f"text {i}") for i in range(2, 9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    quality.fit(frame(rows), labels)
    quality.fit(frame(rows[::-1]), labels)
    assert given[0] == given[1] and len(given[0][1]) == 8 and sum(given[0][1]) == 4 and all(given[0][0])
