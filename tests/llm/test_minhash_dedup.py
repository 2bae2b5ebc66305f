import random
import tracemalloc

from vitalforms.llm import minhash_dedup
from vitalforms.llm.minhash_dedup import HALVES, MINIMA, deduplicate, halves_for, near_duplicates, shingle_sets


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def varied(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or not texts:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))))
        elif kind < 0.5:
            texts.append(rng.choice(texts))
        else:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(1, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts


def test_components_equal_brute_force(docs_of):
    texts = varied(3, 300) + [None, "", "  \n", "one", "ONE", "one two", "One\ttwo", "É é", "é É", "x " * 20000]
    got = sorted(map(tuple, near_duplicates(docs_of(texts)).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == brute(list(enumerate(texts)), 3, 85)


def test_halves_follow_the_similarity():
    assert halves_for(85) == HALVES
    for percent in (50, 80, 85, 90, 100):
        missed = lambda m: 1 - (1 - (1 - (percent / 100) ** MINIMA) ** m) ** 2
        assert missed(halves_for(percent)) < 1e-4


def test_blocks_of_few_words():
    for width in (3, 5):
        for n in range(7):
            for texts in (["a b c d e f".split()[:n]], [["a"] * (n // 2), ["b"] * (n - n // 2)]):
                sets = shingle_sets([" ".join(t).encode() for t in texts], width)
                assert [len(s) for s in sets] == [
                    len({tuple(t[k:k + width]) for k in range(max(1, len(t) - width + 1))}) if t else 0 for t in texts]


def test_short_last_text(docs_of):
    long = " ".join(f"w{k}" for k in range(300000))
    assert len(long) > 1_500_000
    assert sorted(r.doc_id for r in deduplicate(docs_of([long, "two words", "Two words"]).coalesce(1)).collect()) == [0, 1]
    assert [r.doc_id for r in deduplicate(docs_of(["only three words"])).collect()] == [0]


def test_crowded_group_loses_no_link(docs_of):
    # Many variants of one text, alike at less than the threshold, with a few close pairs among them.
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), 7):
            w[k] = f"n{i}x{k}"
        texts.append(" ".join(w))
        if i % 11 == 0:
            w[5] = "close"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = sorted(map(tuple, near_duplicates(docs_of(texts)).collect()))
    assert got == brute(list(enumerate(texts)), 3, 85)


def test_edges_and_kept_rows(docs_of):
    rows = near_duplicates(docs_of(["a b c d", "a b c d", "a b c d", "z"], [5, 5, None, 9])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(5, 5, True), (5, 5, True), (9, 9, True)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert near_duplicates(docs_of([])).count() == 0
    texts = ["a b c d e f", "a b c d e f", None, "", "q"]
    docs = docs_of(texts)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_a_block_of_texts_needs_little_memory():
    """Beside a full JVM heap the workers of an executor have little left."""
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(300)).encode() for _ in range(minhash_dedup.BLOCK // 1700)]
    minhash_dedup._half_keys(minhash_dedup.shingle_sets(texts[:2], 5), 11, 2)
    tracemalloc.start()
    minhash_dedup._half_keys(minhash_dedup.shingle_sets(texts, 5), 11, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32_000_000
