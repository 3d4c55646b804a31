import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import kernels, vectors
from inkwell.operators import similarity
from inkwell.sources.vectors import read_vector_csv, write_vector_csv


def kl(p, q):
    p, q = np.array(p) / np.sum(p), np.array(q) / np.sum(q)
    if np.any((p > 0) & (q == 0)):
        return np.inf
    return float(sum(a * np.log(a / b) for a, b in zip(p, q) if a > 0))


GOLDEN = [
    ([0.5, 0.5], [0.25, 0.75], 0.143841, 0.738796),
    ([0.5, 0.5, 0.0], [0.25, 0.5, 0.25], 0.346574, 0.738796),
    ([0.5, 0.5], [1.0, 0.0], float("inf"), 0.585786),
    ([1.0, 1.0], [0.25, 0.75], 0.143841, 0.558482),
    ([0.5, 0.5], [1.0], None, None),
    ([0.0, 0.0], [0.5, 0.5], None, 0.585786),
]


@pytest.mark.parametrize(("p", "q", "divergence", "closeness"), GOLDEN)
def test_golden_divergences(spark, p, q, divergence, closeness):
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    row = df.select(vectors.kl_divergence(p, q).alias("kl"), vectors.euclidean_similarity(p, q).alias("e")).first()
    assert row["kl"] == (None if divergence is None else pytest.approx(divergence, abs=1e-6))
    assert row["e"] == (None if closeness is None else pytest.approx(closeness, abs=1e-6))


def test_argmax_takes_the_first_and_skips_zero_vectors(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.argmax(F.col("v"))).collect()] == [1, None]


def collections(metric, seed=3):
    """Clustered rows; a third of the candidates are copies of one row; zero rows and holes for KL."""
    rng = np.random.default_rng(seed)
    centres = rng.random((6, 8)) ** 4
    right = [list(np.abs(centres[i % 6] + rng.normal(0, 0.02, 8))) for i in range(200)]
    right += [right[0]] * 100
    left = [list(np.abs(centres[i % 6] + rng.normal(0, 0.05, 8))) for i in range(60)] + [right[0]] * 10
    if metric == "kl":
        right[5] = right[17] = [0.0] * 8
        right[7][2] = right[9][3] = left[4][2] = 0.0
        left[1] = [0.0] * 8
    return [[float(x) for x in row] for row in left], [[float(x) for x in row] for row in right]


def brute(left, right, k, metric):
    want = {}
    for i, p in enumerate(left):
        if metric == "kl" and sum(p) == 0:
            continue
        scored = []
        for j, q in enumerate(right):
            if metric == "kl" and sum(q) == 0:
                continue
            d = kl(p, q) if metric == "kl" else float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()))
            scored.append((round(max(d, 0.0), 9), j))
        want[i] = [j for _, j in sorted(scored)[:k]]
    return want


@pytest.mark.parametrize("metric", ["kl", "euclid"])
@pytest.mark.parametrize("sizes", [(16, 8, 7), (4096, 1024, 256)])
def test_nearest_is_exact(spark, metric, sizes):
    left, right = collections(metric)
    schema = "id long, topic_distribution array<double>"
    a = spark.createDataFrame(list(enumerate(left)), schema).repartition(3)
    b = spark.createDataFrame(list(enumerate(right)), schema).repartition(3)
    candidate_block, query_block, cells = sizes
    rows = similarity.nearest(
        a, b, 5, metric, candidate_block=candidate_block, query_block=query_block, max_cells=cells
    ).collect()
    got = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(row["id1"], []).append(row["id2"])
    assert got == brute(left, right, 5, metric)


def test_cells_are_skipped_but_never_needed_ones():
    rng = np.random.default_rng(0)
    centres = np.eye(6) * 5 + 0.01
    rows = np.repeat(centres, 50, axis=0) + rng.random((300, 6)) * 0.05
    rows /= rows.sum(axis=1, keepdims=True)
    pivots = rows[::10]
    space = kernels.metric_space(rows, "kl")
    cell = kernels.square_matrix(space, kernels.metric_space(pivots, "kl")).argmin(axis=1)
    radius = np.array([
        max((np.linalg.norm(space[i] - np.sqrt(pivots[c])) for i in np.flatnonzero(cell == c)), default=-1.0)
        for c in range(len(pivots))
    ])
    visits = kernels.cells_to_visit(rows, pivots, radius, 3, "kl")
    truth = kernels.kl_matrix(rows, rows).round(9).argsort(axis=1, kind="stable")[:, :3]
    assert all(visits[i, cell[j]] for i in range(300) for j in truth[i])
    assert visits.mean() < 0.5


def test_unequal_lengths_are_never_compared(spark):
    schema = "id string, topic_distribution array<double>"
    a = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.2, 0.3, 0.5])], schema)
    rows = similarity.nearest(a, a, 5).collect()
    assert {(r["id1"], r["id2"]) for r in rows} == {("a", "a"), ("b", "b")}


def test_vector_csv(spark, tmp_path):
    rows = spark.createDataFrame(
        [("Row(oid='x')", 1, [0.25, 0.75]), ("Row(oid='y')", None, [0.0, 1e-9])],
        "id string, topic_num int, topic_distribution array<double>",
    )
    write_vector_csv(rows, str(tmp_path / "v"))
    back = read_vector_csv(spark, str(tmp_path / "v"), rendered_ids=True)
    assert sorted(map(tuple, back.collect())) == [("x", 1, [0.25, 0.75]), ("y", None, [0.0, 1e-9])]


@pytest.mark.parametrize("metric", ["kl", "euclid"])
def test_copies_follow_the_rows_and_not_the_cells(spark, metric):
    """Of vectors without clusters every cell is visited: a query goes once to each of a bounded number of groups."""
    rng = np.random.default_rng(5)
    points = rng.random((1200, 6)) + 0.05
    points[:400] = points[0] + rng.random((400, 6)) * 1e-3  # one cell larger than a group
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, topic_distribution array<double>")
    usable = similarity.usable_vectors(df, "id", "topic_distribution", metric)
    side = similarity._side(1200, 4)
    visiting, placed, _ = similarity._in_cells(usable, usable, 5, metric, 256, 6, side)
    assert visiting.count() <= 3 * similarity.GRID * 1200
    assert placed.groupBy("group").count().agg(F.max("count")).first()[0] <= 2 * side
    got = {}
    for row in similarity.nearest(df, df, 5, metric, candidate_block=4, query_block=64).orderBy("id1", "rank").collect():
        got.setdefault(row["id1"], []).append(row["id2"])
    unit = points / points.sum(axis=1, keepdims=True)
    away = kernels.kl_matrix(unit, unit) if metric == "kl" else np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    key = np.round(np.maximum(away, 0), 9)
    assert got == {i: list(np.lexsort((np.arange(1200), key[i]))[:5]) for i in range(1200)}
