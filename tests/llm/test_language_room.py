import tracemalloc

import numpy as np
import pyarrow as pa

from inkwell.llm import language_id


def test_the_fit_holds_one_square_matrix_and_no_second():
    rng = np.random.default_rng(0)
    x, y = rng.random((60, 1500)).astype(np.float16), np.arange(60) % 3
    tracemalloc.start()
    model = language_id.learn(x, y, ["de", "en", "fr"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 1501 * 1501 * 8
    assert (language_id.decode(model, x.astype(np.float32))[0] == y).all()


def test_features_come_in_order_from_several_chunks():
    rows = np.arange(40, dtype=np.float16).reshape(10, 4)
    whole = pa.array([r.tobytes() for r in rows], pa.binary())
    column = pa.chunked_array([whole.slice(0, 3), whole.slice(3, 0), whole.slice(3, 7)])
    order = np.array([9, 0, 4, 3, 2, 1, 8, 7, 6, 5])
    assert (language_id.feature_rows(column, order, 4) == rows[order]).all()
