import zlib
from collections import Counter

import numpy as np

from vitalforms.llm import queries
from vitalforms.llm.language import Chain, fit, identify, marginals, predict, training_rows, word_features


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op7_language(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    scores, firsts = rng.normal(size=(7, 3)), np.array([0, 4, 4, 7])
    chain = Chain(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    got, _ = marginals(scores, firsts, chain)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            weight = np.exp(chain.first[path[0]] + sum(scores[a + t, y] for t, y in enumerate(path))
                            + sum(chain.moves[x, y] for x, y in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += weight
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_switch_inside_a_text(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.text.encode(), r.lang) for r in docs.where("lang IN ('en', 'de')").collect()]
    chain = fit([t for t, _ in rows[:200]], [x for _, x in rows[:200]])
    en, de = (next(t for t, x in rows[200:] if x == lang and len(t.split()) > 60).split()[:60] for lang in ("en", "de"))
    features, firsts = word_features([b" ".join(en + de)])
    likely, _ = marginals(chain.weights[features].sum(axis=1).astype(float), firsts, chain)
    half = np.array(chain.languages)[likely.argmax(axis=1)]
    assert (half[:50] == "en").mean() > 0.9 and (half[-50:] == "de").mean() > 0.9
    assert np.all(np.diag(chain.moves)[:, None] >= chain.moves)


def test_training_rows_are_shared_among_languages(docs_of):
    texts = [("the of and " * 50000, "en", "s")] + [(f"the of and {chr(97 + i % 26)} " * 20, "en", "s") for i in range(2400)]
    texts += [("le la les " * 20, "fr", "s")] * 4 + [("x" * 100000, "xx", "s")] * 8 + [("12 34", "zz", "s")] * 8
    ids = [i for i in range(20000) if zlib.crc32(str(i).encode()) % 4 != 2][:len(texts)]
    rows = training_rows(docs_of(texts, ids), 300)
    assert all(len(word_features([t])[0]) <= 40 and len(t) <= 4000 for t, _ in rows)
    counts = Counter(lang for _, lang in rows)
    assert counts["en"] == 100 and counts["fr"] == 8 and counts["xx"] == 8 and "zz" not in counts
    assert sum(t.decode().split() == "the of and".split() * 13 + ["the"] for t, _ in rows) <= 4


def test_edges(docs_of):
    texts = [("the of and " * 20, "en", "s"), ("le la les " * 20, "fr", "s"), (None, "en", "s"), ("", "en", "s"), ("12 34 !!", "fr", "s"),
             ("x", None, "s"), ("the " * 40000, "en", "s")] * 6
    rows = {i: r for i, r in enumerate(identify(docs_of(texts)).orderBy("doc_id").collect())}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in rows if i % 7 in (2, 3, 4))
    assert all(rows[i].lang_pred == {0: "en", 1: "fr", 6: "en"}[i % 7] for i in rows if i % 7 in (0, 1, 6))
    assert {r.lang_pred for r in identify(docs_of([("a b", None, "s")])).collect()} == {"und"}
    assert identify(docs_of([])).count() == 0
    assert predict(docs_of(["x"]).select("text"), Chain()).first().lang_pred == "und"
