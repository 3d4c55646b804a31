import pytest

from inkwell.operators.aggregates import combine_by_key


def lists(df, **options):
    found = combine_by_key(df, "k", "v", lambda v: [v], lambda c, v: sorted([*c, v], key=repr), lambda a, b: sorted(a + b, key=repr), "array<int>", **options)
    return {r.k: r.combined for r in found.collect()}


@pytest.mark.parametrize(("salts", "held_keys", "parts"), [(32, 100_000, 3), (1, 1, 7), (4, 3, 16)])
def test_a_callers_functions_with_a_hot_key(spark, salts, held_keys, parts):
    rows = [("hot", i % 5) for i in range(900)] + [(f"k{i % 40}", i) for i in range(200)] + [(None, 1), (None, None), ("one", None)]
    expected = {}
    for k, v in rows:
        expected.setdefault(k, []).append(v)
    df = spark.createDataFrame(rows, "k string, v int").repartition(parts)
    assert lists(df, salts=salts, held_keys=held_keys) == {k: sorted(v, key=repr) for k, v in expected.items()}
    assert lists(df.limit(0)) == {}


def test_a_hot_keys_rows_are_combined_where_they_are_read(spark):
    """One task never gets more than a row per key from each task and salt, whatever the number of the key's rows."""
    df = spark.range(100_000).selectExpr("'hot' AS k", "cast(id AS int) AS v").repartition(8)
    most = spark.sparkContext.accumulator(0)

    def merged(a, b):
        most.add(1)
        return a + b

    found = combine_by_key(df, "k", "v", lambda v: v, lambda c, v: c + v, merged, "bigint", salts=4)
    assert [tuple(r) for r in found.collect()] == [("hot", sum(range(100_000)))]
    assert most.value == 7  # eight partial results of one key
