import random

from pyspark.sql import functions as F

from vitalforms.functions import spans as sp
from vitalforms.operators import spans as ops
from vitalforms.sources import pages

SPANS = "array<struct<start:int,end:int,label:string>>"


def greedy(spans):
    kept = []
    for s in sorted((s for s in spans if s[1] > s[0]), key=lambda s: (s[0] - s[1], s)):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_drop_overlaps_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        n = rng.randint(0, 14)
        rows.append((i, [(a, a + rng.randint(0, 9), rng.choice("AB")) for a in (rng.randint(0, 40) for _ in range(n))]))
    df = spark.createDataFrame(rows, f"doc_id int, spans {SPANS}")
    got = {r.doc_id: [tuple(s) for s in r.k] for r in df.select("doc_id", sp.drop_overlaps(F.col("spans")).alias("k")).collect()}
    assert all(got[i] == greedy(spans) for i, spans in rows)


def reference_locate(text, pairs):
    last, out = {}, []
    for phrase, label in pairs:
        phrase = phrase.strip()
        start = text.find(phrase, last.get(phrase, 0))
        if start < 0:
            start = text.find(phrase)
        if start < 0 or not phrase:
            continue
        if any(not (start + len(phrase) <= s or start >= e) for s, e, _ in out):
            start = text.find(phrase, start + len(phrase))
            if start < 0:
                continue
        last[phrase] = start + len(phrase)
        out.append((start, start + len(phrase), label))
    return out


def test_locate_phrases(spark):
    cases = [
        ("Ana Cruz, mother Ana, citizen Filipino and Filipino", [("Ana", "A"), ("Ana", "B"), ("Filipino", "C"), ("Filipino", "D")]),
        ("dela Cruz Santos Cruz", [("dela Cruz", "M"), ("Cruz", "L"), ("Santos", "S")]),
        ("abc", [("zzz", "Z"), (" abc ", "A"), ("b", "B")]),
        ("x 88 88", [("88", "A"), ("88", "B"), ("88", "C")]),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(cases)],
                               "i int, text string, pairs array<struct<phrase:string,label:string>>")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", sp.locate_phrases(F.col("text"), F.col("pairs")).alias("s")).collect()}
    assert all(got[i] == reference_locate(t, p) for i, (t, p) in enumerate(cases))


def test_span_corpus_rules(spark):
    text = "  Lea Ramos : born 1999  "
    spans = [(0, 11, "NAME"), (12, 13, "PUNCT"), (3, 3, "EMPTY"), (0, 2, "BLANK"), (19, 21, "CUT"), (2, 5, "INSIDE")]
    df = spark.createDataFrame([(1, text, spans), (2, "x" * 300, [(0, 300, "LONG")])], f"doc_id int, text string, spans {SPANS}")
    out = {r.doc_id: r for r in ops.span_corpus(df, max_length=200).collect()}
    assert [tuple(s) for s in out[1].spans] == [(2, 11, "NAME"), (19, 23, "CUT")]
    assert out[1].skipped == 3 and out[2].spans == [] and out[2].skipped == 1
    assert [tuple(s) for s in ops.span_corpus(df).filter("doc_id = 2").first().spans] == [(0, 300, "LONG")]


def test_contract_leaves_the_cut_word_out(spark):
    df = spark.createDataFrame([("alpha beta gamma",)], "t string")
    wide = ops.snap(F.col("t"), sp.span(F.lit(8), F.lit(13), F.lit("X")))
    tight = ops.snap(F.col("t"), sp.span(F.lit(8), F.lit(13), F.lit("X")), "contract")
    row = df.select(wide.alias("w"), tight.alias("n")).first()
    assert tuple(row.w) == (6, 16, "X") and tuple(row.n) == (10, 11, "X")


def test_pages_read_from_nested_folders(spark, tmp_path):
    import json
    page = {"form": [{"label": "question", "words": [{"text": " Name: "}, {"text": ""}], "id": 0},
                     {"label": "odd", "words": [{"text": "Lea"}], "id": 1}, {"label": "answer", "words": [], "id": 2}]}
    for folder in ("a/training_data/annotations", "b/c/training_data/annotations", "b/testing_data/annotations"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "p1.json").write_text(json.dumps(page))
    rows = pages.page_examples(pages.read_pages(spark, str(tmp_path), "training")).collect()
    assert [(r.page_id, r.text) for r in rows] == [("p1", "Name: Lea")]
    assert [tuple(s) for s in rows[0].spans] == [(0, 5, "FORM_QUESTION"), (6, 9, "FORM_OTHER")]


def test_different_pages_of_one_name_stay(spark, tmp_path):
    import json
    for folder, word in (("a/training/annotations", "one"), ("b/training/annotations", "two"), ("c/training/annotations", "two")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "0001.json").write_text(json.dumps({"form": [{"label": "answer", "words": [{"text": word}], "id": 0}]}))
    rows = pages.page_examples(pages.read_pages(spark, str(tmp_path), "training")).collect()
    assert sorted((r.page_id, r.text) for r in rows) == [("a/training/annotations/0001", "one"), ("b/training/annotations/0001", "two")]


def test_broken_pages_go_to_the_rejects(spark, tmp_path):
    import json
    folder = tmp_path / "a/training/annotations"
    folder.mkdir(parents=True)
    block = {"label": "answer", "words": [{"text": "one", "box": [1, 2, 3, 4]}], "id": 0}
    texts = {"good": json.dumps({"form": [block]}), "empty": json.dumps({"form": []}), "cut": json.dumps({"form": [block]})[:-3],
             "blank": " \n", "none": json.dumps({"pages": 1}), "text": json.dumps({"form": "x"}), "null": json.dumps({"form": None}),
             "type": json.dumps({"form": [block | {"id": "first"}]}), "tail": json.dumps({"form": [block]}) + " }", "words": "not json at all"}
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    (folder / "bytes.json").write_bytes(b"\xff\xfe{")
    good, bad = pages.read_pages_checked(spark, str(tmp_path), "training")
    assert {r.page_id: len(r.form) for r in good.collect()} == {"good": 1, "empty": 0}
    assert {r.path.rsplit("/", 1)[1][:-5]: r.reason for r in bad.collect()} == {
        "cut": "not json", "blank": "blank", "none": "no form", "text": "form is no list", "null": "no form", "type": "wrong type",
        "tail": "not json", "words": "not json", "bytes": "not json"}
    assert [(r.page_id, r.text) for r in pages.page_examples(good.where("page_id = 'good'")).collect()] == [("good", "one")]
