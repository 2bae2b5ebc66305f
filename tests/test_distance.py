import random

import pytest

from vitalforms.functions import distance


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs():
    rng = random.Random(8)
    text = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    out = [(None, "a"), ("a", None), ("", ""), ("", "abc"), ("x" * 90, ""), ("same" * 40, "same" * 40), ("é" * 80 + "x", "é" * 80 + "y"),
           ("ab" * 50, "ba" * 50), ("kitten", "sitting"), ("a" * 100, "a" * 140), ("𝒳y" * 60, "y𝒳" * 60)]
    for n in (3, 40, 70, 150):
        for chars in ("ab", "abcdefgh é"):
            base = text(n, chars)
            out.append((base, text(n, chars)))
            out.append((base, base.translate(str.maketrans("ae", "4c"))))
            edited = list(base)
            for _ in range(1 + n // 20):
                at = rng.randrange(len(edited))
                rng.choice((lambda: edited.pop(at), lambda: edited.insert(at, "z"), lambda: edited.__setitem__(at, "a")))()
            out += [(base, "".join(edited)), ("".join(edited), base + text(9, chars)), (base[::-1] + base, base + base[::-1])]
    return out


@pytest.mark.parametrize("small", [0, distance.SMALL_TABLE])
def test_distance_equals_the_full_table(spark, monkeypatch, small):
    monkeypatch.setattr(distance, "SMALL_TABLE", small)
    rows = pairs()
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, pred string, truth string")
    got = dict(map(tuple, df.select("i", distance.char_distance("pred", "truth")).collect()))
    for i, (a, b) in enumerate(rows):
        assert got[i] == (None if a is None or b is None else plain(a, b)), (a, b)
