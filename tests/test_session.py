import os

import pytest
from pyspark.sql import functions as F

from inkwell import session
from inkwell.operators import graph, similarity
from inkwell.session import materialize, working_tables


@pytest.fixture(autouse=True)
def own_folder(spark, tmp_path, monkeypatch):
    """A shared folder that no other session writes to."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    yield
    monkeypatch.undo()
    spark.sparkContext.setCheckpointDir(session.shared_folder(spark))


def files(spark):
    folder = session.shared_folder(spark)
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def test_tables_go_with_their_block_but_kept_ones(spark):
    before = files(spark)
    with working_tables(spark):
        with working_tables(spark) as inner:
            first = materialize(spark.range(5).toDF("x"), "first")
            second = materialize(first.withColumn("y", F.col("x") * 2), "second")
            inner.drop(first)
            kept = inner.keep(second)
            also = inner.keep(second.where("x > 2"), "also")
            assert inner.paths == []
        assert kept.count() == 5 and also.count() == 2
    assert files(spark) == before


def test_a_failed_job_leaves_no_tables(spark):
    before = files(spark)
    with pytest.raises(ValueError), working_tables(spark):
        materialize(spark.range(3), "lost")
        raise ValueError
    assert files(spark) == before


def test_jobs_leave_nothing_behind(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 3) + 1]) for i in range(40)], "id long, topic_distribution array<double>")
    nodes = spark.createDataFrame([(0, i) for i in range(6)], "graph int, node int")
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 1)]
    links = spark.createDataFrame([(0, a, b, 1.0) for a, b in pairs] + [(0, b, a, 1.0) for a, b in pairs], "graph int, src int, dst int, weight double")
    before = files(spark)
    with working_tables(spark):
        assert similarity.nearest(vectors, vectors, 3, candidate_block=8).count() == 120
        assert graph.pagerank(nodes, links, max_iter=3).agg(F.round(F.sum("score"), 6)).first()[0] == 1.0
    assert files(spark) == before
