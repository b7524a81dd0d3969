import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftledger.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int, q string, rank int, score double, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, "long " * 10) for r in rows], VECTORS)


def plain(rows, every=10, positives=5, wanted=10):
    own = []
    for vec_id, vector, label in rows:
        if None in (vec_id, label) or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((vec_id, [math.floor(256 * x) for x in vector], label))
    found = []
    for a_id, a, label in own:
        if a_id % every:
            continue
        others = sorted((-sum(x * y for x, y in zip(a, q)), i, lab) for i, q, lab in own if i != a_id)
        for score, pos_id, _ in [o for o in others if o[2] == label][:positives]:
            band = [o for o in others if o[2] != label and 30 * -score <= 100 * -o[0] <= 90 * -score]
            found += [(a_id, pos_id, k + 1, o[1], -score, -o[0]) for k, o in enumerate(band[:wanted])]
    return sorted(found)


def mined(df, every=10):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % every == 0).collect())


def odd_rows(n=260, dims=20, seed=5):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(dims)], rng.randrange(3)) for k in range(n)]
    same = [0.5] * dims
    rows += [(1000 + k, same, k % 2) for k in range(60)]  # ties
    rows += [(20, rows[20][1], rows[20][2])] * 2 + [(30, same, 2)]  # repeated rows and ids
    rows += [
        (2000, None, 1), (2010, same, None), (None, same, 1), (2020, [None] + same[1:], 1), (2030, [math.nan] + same[1:], 1),
        (2040, [math.inf] + same[1:], 0), (2050, [], 0), (2060, same[:7], 1), (2070, same + same, 2), (2080, [-900.5] * dims, 0),
        (2090, [0.0] * dims, 1), (2100, [900.25] + same[1:], 77),
    ]
    return rows


def test_results_equal_the_plain_ones(spark, monkeypatch):
    rows = odd_rows()
    expected = plain(rows)
    assert len(expected) > 500
    assert mined(frame(spark, rows)) == expected
    for name, value in {"MAX_COMPONENTS": 200, "CHUNK_ROWS": 40, "SLICE_ROWS": 16, "ANCHORS_A_TABLE": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    assert mined(frame(spark, rows).repartition(5)) == expected


def test_empty_table_and_anchors_alone(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(10, [1.0], 1), (11, [1.0], 2)])) == []
    too_large = [(10, [1.0], 1), (11, [1e30], 1), (12, [1.0], 1), (13, [0.5], 2)]
    assert mined(frame(spark, too_large)) == [(10, 12, 1, 13, 65536, 32768)]


@pytest.mark.parametrize("size", [1, 7, 8, 64, 65])
def test_lookups_give_inner_products(size):
    rng = np.random.default_rng(size)
    q = rng.integers(-(2**24), 2**24, (30, size))
    a = rng.integers(-(2**24), 2**24, (9, size))
    packed = next(negatives.pack(iter([pd.DataFrame({"id": range(30), "label": 1, "q": list(q)})])))
    small = next(negatives.pack(iter([pd.DataFrame({"id": range(30), "label": 1, "q": list(q % 5 - 2)})])))
    bits = negatives.unpack(pd.concat([packed, small], ignore_index=True))
    tables = negatives.subset_sums(negatives.matrix(list(a)), np.int64)
    assert (negatives.scores(bits, tables) == np.concatenate([q, q % 5 - 2]) @ a.T).all()
