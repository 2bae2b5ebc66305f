import numpy as np
import pytest

from vitalforms.llm.maxscore import Shard, postings, quantised, top_k


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(40, 3), (300, 16), (900, 64)])
def test_shard_equals_brute_force(shape):
    rng = np.random.default_rng(5)
    rows = rng.integers(-60, 60, shape)
    rows[::7] = rows[0]      # ties
    rows[5] = 0
    rows[6] = -np.abs(rows[6])
    ids = rng.permutation(10 * len(rows))[:len(rows)]
    columns = np.ascontiguousarray(rows.T)
    shard = Shard(ids.astype(np.int64), columns, **postings(columns))
    for i in range(0, len(rows), 9):
        found, scores = shard.top(int(ids[i]), rows[i], 5)
        assert [(int(ids[i]), r, a, b) for r, (a, b) in enumerate(zip(found.tolist(), scores.tolist()), 1)] == brute(
            list(zip(ids.tolist(), rows)), [(int(ids[i]), rows[i])], 5)
        if len(scores) and scores[-1] > 0:  # a threshold from elsewhere leaves what reaches it
            kept, values = shard.top(int(ids[i]), rows[i], 5, int(scores[1]))
            assert set(zip(kept.tolist(), values.tolist())) == {(a, b) for a, b in zip(found.tolist(), scores.tolist()) if b >= scores[1]}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, None), (2, [nan, 0.1]), (3, [0.1, None]), (4, [inf, 0.0]), (5, [0.25, -0.25]), (6, [0.25, -0.25]),
            (None, [1.0, 1.0]), (50, [-0.01, 0.9]), (50, [-0.01, 0.9]), (7, []), (8, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, block int")
    vectors = quantised(df)
    got = sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=3, block_rows=1).collect()))
    floor = lambda v: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
    good = [(i, (floor(v) + [0, 0])[:2]) for i, v in rows if i in (0, 5, 6, 50, 7, 8)]
    assert got == brute(good, [(0, good[0][1]), (50, floor([-0.01, 0.9]))], 5)
    empty = vectors.where("false")
    assert top_k(empty, empty).count() == 0


def test_buckets_and_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-128, 128, 12 - i % 3) / 128).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]                        # ties
    rows += [(2000 + i, [float(1 << 40) * (1 + i % 3)] + [0.5] * 11) for i in range(5)]  # sums beyond a double's whole numbers
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = vectors.where("vec_id % 20 = 0 AND vec_id < 2000")
    whole = {i: [int(np.floor(256 * x)) for x in v] + [0] * (12 - len(v)) for i, v in rows}
    exact = []
    for q in sorted(i for i in whole if i % 20 == 0 and i < 2000):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:5]
        exact += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    got = top_k(vectors, asked, 5, shard_rows=32, bucket_rows=100, block_rows=7)
    assert sorted(map(tuple, got.collect())) == exact
