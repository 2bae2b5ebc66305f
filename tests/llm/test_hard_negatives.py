import numpy as np
import pytest

from vitalforms.llm import hard_negatives as hn


def brute(rows, anchors, n_pos=5, n_neg=5, percent=80):
    """``rows`` and ``anchors``: (id, label, vector)."""
    out = []
    for a, label, q in anchors:
        scored = [(-sum(int(x) * int(y) for x, y in zip(q, v)), i, other) for i, other, v in rows if i != a]
        positives = sorted({(i, -s) for s, i, _ in sorted(x for x in scored if x[2] == label)[:n_pos]})
        for p, score in positives:
            fits = sorted((s, i) for s, i, other in scored if other != label and percent * score <= -100 * s <= 100 * score)
            out += [(a, p, r, i, score, -s) for r, (s, i) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, [int(x) for x in v], 1, 2) for i, lab, v in rows],
                                 "vec_id long, label long, terms array<long>, score int, bucket int")


@pytest.mark.parametrize("n, dims, labels, spread", [(60, 3, 2, 40), (500, 20, 4, 40), (700, 64, 10, 40), (300, 9, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, n, dims, labels, spread):
    monkeypatch.setattr(hn, "SHARD_ROWS", 97)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(n)
    rows = rng.integers(-spread, spread, (n, dims))
    rows[::9] = rows[0]  # ties and equal vectors
    rows[5] = 0
    table = [(int(i), int(rng.integers(labels)), v) for i, v in zip(rng.permutation(3 * n)[:n], rows)]
    anchors = [r for r in table if r[0] % 7 == 0]
    got = hn.hard_negatives(frame(spark, table).repartition(3), frame(spark, anchors))
    want = brute(table, anchors)
    assert sorted(map(tuple, got.collect())) == want and (want or n == 60)


def test_scan_keeps_exactly_what_can_enter():
    rng = np.random.default_rng(2)
    columns = rng.integers(-50, 50, (32, 400))
    shard = hn.Shard(np.arange(400), np.arange(400) % 3, columns)
    for a in range(0, 400, 11):
        best, window = hn.Best(5), (100, 4000, hn.Best(5))
        hn.same_label(shard, a, a % 3, columns[:, a], best)
        hn.in_windows(shard, a, a % 3, columns[:, a], [window])
        scores = columns[:, a] @ columns
        own = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != a and i % 3 == a % 3)[:5]
        other = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i % 3 != a % 3 and 100 <= s <= 4000)[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == own
        assert list(zip((-window[2].scores).tolist(), window[2].ids.tolist())) == other


def test_large_components_are_exact():
    columns = np.array([[1 << 30, (1 << 30) + 1, 3], [7, 7, 1]])
    shard = hn.Shard(np.array([1, 2, 3]), np.zeros(3, np.int64), columns)
    best = hn.Best(2)
    hn.same_label(shard, 9, 0, np.array([(1 << 30) + 1, 1]), best)
    assert best.ids.tolist() == [2, 1] and best.scores.tolist() == [((1 << 30) + 1) ** 2 + 7, (1 << 30) * ((1 << 30) + 1) + 7]


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(0, 1, [0.5, 0.5]), (1, 1, None), (2, 1, [nan, 0.1]), (3, 2, [0.1, None]), (4, None, [0.1, 0.2]), (None, 1, [1.0, 1.0]),
           (5, 1, [0.5, 0.25]), (6, 2, [0.5, 0.24]), (6, 2, [0.5, 0.24]), (7, 2, [0.5]), (8, 2, []), (9, 1, [inf, 1.0]),
           (100, 2, [0.4, 0.2]), (100, 2, [0.4, 0.2]), (200, 3, [0.1, 0.1]), (300, 1, [-1.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in raw], "vec_id long, label int, embedding array<float>, rank int, body string")
    vectors = hn.labelled(df)
    floor = lambda v: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] + [0, 0]
    good = [(i, lab, floor(v)[:2]) for i, lab, v in raw if i in (0, 5, 6, 7, 8, 100, 200, 300)]
    anchors = {r[0]: r for r in good if r[0] % 100 == 0}
    got = hn.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(good, anchors.values())
    empty = vectors.where("false")
    assert hn.hard_negatives(empty, empty).count() == 0
    assert hn.hard_negatives(vectors, empty).count() == 0
