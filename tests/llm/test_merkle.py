from hashlib import sha256
from zlib import crc32

import pytest

from vitalforms.llm import merkle


def sha(parts):
    return sha256(parts.encode()).hexdigest()


def leaf_of(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    found = []
    for level in levels[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        found.append((run[:i % 8], run[i % 8 + 1:]))
        i //= 8
    return found


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[name] = levels_of([leaf_of(r, r["text"]) for r in groups[name]])
    top = levels_of([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            steps = path(trees[name], i) + path(top, k)
            text = r["text"]
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in steps:
                node = sha("".join(left) + node + "".join(right))
            out.append((r["doc_id"], leaf_of(r, r["text"]), trees[name][-1][0], top[-1][0],
                        sha("".join("".join(a + b) for a, b in steps)), node, node == top[-1][0]))
    return out


def same(got, rows):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_fill_the_block_and_keep_halves_together(levels):
    height = levels - 1
    at = merkle.places(height)
    assert sorted(p for level in at for p in level) == list(range(merkle.nodes_in(levels)))
    assert at[height] == [0]
    bottom = levels - levels // 2
    if levels > 1:  # every bottom part is one stretch
        for part in range(merkle.FAN ** (levels // 2)):
            own = [p for level in range(bottom)
                   for p in at[level][part * 8 ** (bottom - 1 - level):(part + 1) * 8 ** (bottom - 1 - level)]]
            assert sorted(own) == list(range(min(own), min(own) + merkle.nodes_in(bottom)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 500, 512])
def test_block_equals_plain_levels(n):
    leaves = [sha(str(i)) for i in range(n)]
    height = merkle.height_of(n)
    nodes = merkle.build([x.encode() for x in leaves], height)
    plain = levels_of(leaves)
    assert height == len(plain) - 1 and nodes[0].decode() == plain[-1][0]
    beside = merkle.siblings(nodes, height, n)
    for i in range(0, n, 7):
        want = [("".join(a), "".join(b)) for a, b in path(plain, i)]
        assert [(a[i >> 3 * k].decode(), b[i >> 3 * k].decode()) for k, (a, b) in enumerate(beside)] == want


def test_proofs_equal_brute_force_over_several_block_levels(spark, docs_of, monkeypatch):
    langs = ["en"] * 5 + ["de", None, "", "Ü", "z"]  # 'en' has more leaves than one block
    texts = [(None if i % 41 == 0 else ("Ab" * (i % 5) + "é" if i % 7 else "low"), langs[i % 10], None if i % 11 == 0 else f"s{i % 3}")
             for i in range(1500)]
    texts[3] = ("Xy " * 200_000, "en", "s")
    ids = [i // 2 if i < 40 else i for i in range(1500)]  # repeated ids
    df = docs_of(texts, ids).withColumnRenamed("row", "grp").withColumnRenamed("size", "digest")
    same(merkle.proofs(df), [r.asDict() for r in df.collect()])


def test_many_groups_and_deep_upper_tree(spark, docs_of):
    df = docs_of([(f"T{i}", f"lang{i}", "s") for i in range(1100)])  # more groups than one block holds
    same(merkle.proofs(df), [r.asDict() for r in df.collect()])


def test_small_tables(spark, docs_of):
    for texts, ids in ([("A", "en", "s")], [5]), ([(None, None, None)], [None]), ([("A", "en", "s")] * 9, [1] * 9):
        df = docs_of(texts, ids)
        same(merkle.proofs(df), [r.asDict() for r in df.collect()])
    assert merkle.proofs(docs_of(["x"]).where("false")).count() == 0
