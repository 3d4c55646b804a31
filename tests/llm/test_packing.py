import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkwell.llm.packing import pack, places, plan
from inkwell.llm.queries import BYTE_BPE, QUERIES


def check_plan(histogram, capacity, runs):
    table = places(runs)
    for length, count in histogram.items():
        own = table["length"] == length
        ranks = sorted((int(r), int(r) + b) for r, b in zip(table["rank"][own], sizes(runs, table, own), strict=True))
        assert ranks[0][0] == 0 and ranks[-1][1] == count and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))
    assert all(sum(n for n, _ in r.items) <= capacity and r.bins > 0 for r in runs)


def sizes(runs, table, own):
    first = np.cumsum([0, *(r.bins for r in runs)])
    return [runs[int(np.searchsorted(first, s, "right")) - 1].bins for s in table["sequence"][own]]


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_has_one_place(seed):
    rng, capacity = random.Random(seed), 256
    histogram = {}
    for _ in range(rng.choice([1, 5, 400, 3000])):
        n = min(capacity, max(1, int(rng.lognormvariate(4, 1))))
        histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 1, 40])
    runs = plan(histogram, capacity, groups=rng.choice([3, 24, 200]))
    check_plan(histogram, capacity, runs)
    assert sum(r.bins for r in runs) <= 1.3 * sum(n * c for n, c in histogram.items()) / capacity + 2


def test_no_pieces_no_runs():
    assert plan({}) == []


def check_rows(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {i for i, _ in texts}
    for i, text in texts:
        ids, own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_odd_texts(frame):
    rows = [(1, None), (2, ""), (3, "a b c " * 900), (4, "x"), (5, "x"), (6, "é 全 😀\n"), (7, " ".join(map(str, range(700))))]
    check_rows(pack(frame(rows), BYTE_BPE, capacity=512).collect(), rows, 512)
    assert pack(frame([]), BYTE_BPE).count() == 0
    repeated = pack(frame([(1, "a"), (1, "a"), (1, "a")]), BYTE_BPE).collect()
    assert sorted(r.offset for r in repeated) == [0, 2, 4] and len({r.sequence_id for r in repeated}) == 1
    with_ids = pack(frame(rows[:4]), BYTE_BPE, capacity=64, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_query_is_near_the_least_number(spark, small):
    rows = QUERIES["op6_best_fit_packing"](spark, small).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert check_rows(rows, texts, 2048) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
