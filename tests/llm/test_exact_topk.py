import numpy as np
import pytest

from inkwell.llm.exact_topk import SortedLists, integers, top_k
from inkwell.session import materialize

CASES = [(500, 20, 90, 0), (30, 40, 3, 0), (300, 5, 2, 0), (300, 5, 40, 1000), (64, 8, 1 << 28, 0), (40, 3, 1 << 29, 0)]


@pytest.mark.parametrize(("n", "k", "top", "shift"), CASES)
def test_block_equals_brute_force(n, k, top, shift):
    rng = np.random.default_rng(n)
    ids, values = rng.permutation(10 * n)[:n], rng.integers(-top, top + 1, (n, 6)) + shift
    values[:, 2] = shift  # a list of one value
    ids[n // 2 :] = ids[: n - n // 2]  # rows that repeat an id are rows of their own
    rows = rng.permutation(n)
    lists = SortedLists(rows, ids, values)
    queries = np.vstack([values[:4], rng.integers(-top, top + 1, (1, 6)), np.zeros((1, 6), np.int64)])
    for own, query in zip([*rows[:4], -7, -7], queries, strict=True):
        at, score = lists.best(own, query, k)
        every = sorted((-int(v @ query), int(i), int(r)) for r, i, v in zip(rows, ids, values, strict=True) if r != own)[:k]
        assert [(-int(s), int(ids[a]), int(rows[a])) for a, s in zip(at, score, strict=True)] == every


def test_most_queries_stop_before_they_have_read_everything(spark):
    rows = integers(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas()
    values = np.array(rows["v"].tolist(), np.int64)
    early, resolved = [], []
    for i in np.flatnonzero(rows["vec_id"] % 20 == 0):
        lists = SortedLists(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), values) if not early else lists
        lists.reads = lists.resolved = 0
        at, score = lists.best(rows["row"][i], values[i], 20)
        every = values @ values[i]
        every[i] = every.min() - 1
        assert sorted(score, reverse=True) == sorted(every, reverse=True)[:20] and len(at) == 20
        early.append(lists.reads / values.size)
        resolved.append(lists.resolved / values.size)
    assert np.median(early) < 0.8 and max(early) < 0.95 and np.median(resolved) < 0.1


def test_odd_vectors_take_no_part_and_cells_agree(spark):
    rows = [(i, [float((i * 7 + d * 3) % 11) / 8 - 0.6 for d in range(4)], i) for i in range(60)]
    rows += [(100, None, 0), (101, [1.0, None, 0.0, 0.0], 0), (102, [float("nan")] * 4, 0), (103, [float("inf")] + [0.0] * 3, 0), (104, [1.0, 2.0], 0), (105, [], 0), (None, [1.0] * 4, 0), (106, [1e30] * 4, 0)]
    v = materialize(integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")), "vectors")
    queries = v.where("vec_id % 20 = 0")
    one = sorted(map(tuple, top_k(queries, v, 7).collect()))
    assert one == sorted(map(tuple, top_k(queries, v, 7, cell_rows=9, chunk_rows=2).collect()))
    assert {r[0] for r in one} == {0, 20, 40} and not {r[2] for r in one} & set(range(100, 110))
    assert top_k(queries.limit(0), v, 3).count() == 0 and top_k(queries, v.limit(0), 3).count() == 0


def test_rows_that_repeat_an_id_are_ranked_one_by_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, -1.0])]
    v = materialize(integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vectors")
    got = sorted(map(tuple, top_k(v.where("vec_id = 0"), v, 2).collect()))
    assert got == [(0, 1, 1, 4096), (0, 1, 2, 8192), (0, 2, 0, 0), (0, 2, 1, 4096)]
