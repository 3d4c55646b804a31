import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm import language_id
from inkwell.llm.exact_dedup import CuckooIndex, apply_changes, build_index, dedup, digests, kept
from inkwell.llm.jaccard_join import representatives

ROWS = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "x" * 200_000), (9, "ab "), (9, "zz"), (9, "zz")]


def test_index_against_a_dictionary():
    rng, index, live = random.Random(3), CuckooIndex(2), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    for step in range(12_000):
        key = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(key) == live.pop(key, None)
        else:
            index.insert(key, step)
            live[key] = step
    assert dict(index.items()) == live and len(index) == len(live) and index.resizes > 0
    assert all(index.find(k) == live.get(k) for k in keys)


def test_index_with_keys_alike_in_what_the_filter_sees():
    index = CuckooIndex(2)
    keys = [b"\0" * 8 + bytes([i, 0, 0]) for i in range(60)]
    for i, key in enumerate(keys):
        index.insert(key, i)
    assert all(index.find(k) == i for i, k in enumerate(keys)) and index.find(b"\0" * 8 + b"\xff\0\0") is None


def test_largest_id_of_equal_texts_stays(frame):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup(frame(ROWS)).collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 8, 2, False), (8, 8, 2, True),
                   (9, 9, 1, True), (9, 9, 2, True), (9, 9, 2, True)]
    stays = kept(frame(ROWS))
    assert stays.columns == frame(ROWS).columns and sorted((r.doc_id, (r.text or "")[:2]) for r in stays.collect()) == [(2, "aB"), (3, "É"), (4, "é"), (6, ""), (8, "xx"), (9, "ab"), (9, "zz")]
    assert dedup(frame([])).count() == 0 and kept(frame([])).count() == 0


def test_missing_ids(frame):
    rows = [(None, "a"), (None, "a"), (1, "a"), (None, "only"), (None, "only")]
    assert sorted((r.doc_id is None, r.kept, r.group_size) for r in dedup(frame(rows)).collect()) == [(False, True, 3), (True, False, 3), (True, False, 3), (True, True, 2), (True, True, 2)]
    assert sorted(r.text for r in kept(frame(rows)).collect()) == ["a", "only"]


def test_changes_keep_the_index_live(frame):
    index = build_index(digests(frame([(1, "a"), (2, "b"), (3, "c"), (4, "A")])))
    changed = apply_changes(index, digests(frame([(5, "b"), (6, "d"), (7, "c")])), digests(frame([(0, "a"), (0, "c"), (0, "nowhere")])), 3)
    assert sorted((r.keep_id, r.group_size) for r in changed.collect()) == [(5, 2), (6, 1), (7, 1)]


def test_changes_without_ids(frame):
    index = build_index(digests(frame([(None, "a"), (None, "b"), (3, "c")])))
    changed = apply_changes(index, digests(frame([(5, "a"), (None, "b"), (None, "c")])), digests(frame([(None, "nowhere")])), 2)
    assert sorted((r.keep_id or 0, r.group_size) for r in changed.collect()) == [(0, 2), (3, 2), (5, 2)]


def test_columns_of_any_name_come_back_as_they_were(spark):
    names = ["_kept_id", "_digest", "_stay_id", "_stay_digest", "id", "digest", "times", "Times_", "mark", "_has_letter", "letters", "text_sha256", "kept"]
    docs = spark.createDataFrame([(1, "hello there all", "en"), (2, "Hello there all", "en"), (2, "hello there all", "en")], "doc_id long, text string, lang string")
    docs = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for made in (kept(docs), language_id.accepted(docs, language_id.fit(docs)), representatives(docs)):
        rows = made.collect()
        assert made.columns == docs.columns and rows and all(r[n] == n for r in rows for n in names)
    assert sorted(r.doc_id for r in kept(docs).collect()) == [2] and representatives(docs).count() == 1


@pytest.mark.parametrize("part_rows", [1, 100])
def test_number_of_parts_changes_nothing(frame, part_rows):
    rows = [(i, f"t{i % 7}") for i in range(40)]
    assert sorted(r.keep_id for r in build_index(digests(frame(rows)), part_rows).collect()) == [33, 34, 35, 36, 37, 38, 39]
