"""Queries through the file formats: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalforms.operators import spans as span_ops
from vitalforms.plans import tables as t
from vitalforms.plans.registry import DOCS, query, with_ctes
from vitalforms.session import work_dir
from vitalforms.sources import annotations as ann
from vitalforms.sources import pages as pg
from vitalforms.sources import requests, writers

_ANN = ["'form' || (doc_id % 3 + 1) || 'a/scan_' || doc_id || '.jpg' AS image_path",
        "CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE ' ' || source || ' ' END AS text"]
_ANN_CTE = "a AS (SELECT doc_id, " + ", ".join(_ANN) + " FROM documents)"


def _annotations(spark, d):
    path = work_dir(spark, "annotations")
    writers.write_annotations(t.read(spark, d, "documents").selectExpr(*_ANN), path)
    files = t.read(spark, d, "documents").filter("doc_id % 7 <> 0").selectExpr(_ANN[0])
    return ann.usable_annotations(ann.read_annotations(spark, path, lines=True), files, "form2a")


@query("annotation_scan", with_ctes(_ANN_CTE) + """
SELECT image_path, trim(text) AS text FROM a WHERE contains(image_path, 'form2a') AND doc_id % 7 <> 0 AND trim(text) <> ''""")
def annotation_scan(spark, d):
    return _annotations(spark, d)[0]


@query("annotation_missing", with_ctes(_ANN_CTE) + """
SELECT count(*) AS missing FROM a WHERE contains(image_path, 'form2a') AND doc_id % 7 = 0""")
def annotation_missing(spark, d):
    return _annotations(spark, d)[1]


@query("sidecar_labels", """
SELECT 'scans/img_' || page_id || '.png' AS image_path, CASE WHEN page_id % 2 = 0 THEN 'label ' || page_id ELSE 'img ' || page_id END AS text
FROM pages WHERE page_id % 10 <> 0""")
def sidecar_labels(spark, d):
    p = t.read(spark, d, "pages")
    images = p.selectExpr("'/data/scans/img_' || page_id || '.png' AS path").unionByName(
        p.selectExpr("'/data/scans/notes_' || page_id || '.doc' AS path"))
    sidecars = p.filter("page_id % 2 = 0").selectExpr(
        "'/data/scans/img_' || page_id || '.txt' AS path",
        "CASE WHEN page_id % 10 = 0 THEN '' ELSE 'label ' || page_id END AS label")
    return ann.folder_annotations(images, sidecars, "/data")


_WORD = ("CASE WHEN l_linenumber = 7 THEN '# comment' WHEN l_linenumber = 6 THEN '' ELSE 'a' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') "
         "|| '-' || l_orderkey || '-00-0' || l_linenumber || CASE WHEN l_partkey % 4 = 0 THEN ' err' ELSE ' ok' END || ' 154 1 2 3 4 AT ' "
         "|| repeat(l_returnflag, CAST(l_quantity AS INT)) END")


@query("word_list", f"""
WITH p AS (SELECT string_split(trim({_WORD}), ' ') AS p FROM lineitem WHERE l_linenumber < 6)
SELECT string_split(p[1], '-')[1] || '/' || string_split(p[1], '-')[1] || '-' || string_split(p[1], '-')[2] || '/' || p[1] || '.png' AS image_path, p[len(p)] AS text
FROM p WHERE p[2] = 'ok' AND length(p[len(p)]) <= 32 AND len(p) >= 9""")
def word_list(spark, d):
    path = work_dir(spark, "words")
    t.read(spark, d, "lineitem").selectExpr(f"{_WORD} AS value").write.text(path)
    return ann.read_word_file(spark, path, max_length=32)


@query("upload_gate", """
WITH f AS (SELECT page_id, 'in.box/File_' || page_id || split_part('.JPG,.pdf,.docx,.Png,,.jpeg', ',', CAST(page_id % 6 + 1 AS INT)) AS path FROM pages)
SELECT page_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, CASE WHEN path LIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS route
FROM f WHERE page_id % 6 NOT IN (2, 4)""")
def upload_gate(spark, d):
    files = t.read(spark, d, "pages").selectExpr(
        "page_id", "'in.box/File_' || page_id || split_part('.JPG,.pdf,.docx,.Png,,.jpeg', ',', CAST(page_id % 6 + 1 AS INT)) AS path")
    return ann.upload_gate(files).select("page_id", "extension", "route")


@query("request_decode", """
SELECT event_id AS doc_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS status, 'k' AS field_name, CAST(json_extract(props, '$.k') AS VARCHAR) AS value
FROM events WHERE user_id % 5 <> 0""", casts="doc_id INT")
def request_decode(spark, d):
    body = F.to_json(F.struct(
        F.when(F.col("user_id") % 5 != 0, F.col("event_id").cast("int")).alias("doc_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"),
        F.from_json("props", "map<string,string>").alias("formData")))
    decoded = requests.decode_requests(t.read(spark, d, "events").select(body.alias("body")))
    return decoded.select("doc_id", "status", F.explode("form_data").alias("field_name", "value"))


@query("page_examples", """
WITH l AS (SELECT conv_id * 100 + turn AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
i AS (SELECT page_id, n, array_to_string(list_filter([trim(w) FOR w IN string_split(regexp_replace(line, '[^!-~]+', ' ', 'g'), ' ')], lambda w: w <> ''), ' ') AS block FROM l)
SELECT page_id, string_agg(block, ' ' ORDER BY n) AS text, string_agg(CASE n % 3 WHEN 0 THEN 'FORM_OTHER' WHEN 1 THEN 'FORM_QUESTION' ELSE 'FORM_ANSWER' END, ',' ORDER BY n) AS labels
FROM i WHERE block <> '' GROUP BY 1""")
def page_examples(spark, d):
    """Turns written as nested page JSON (a line per block), read back, joined."""
    lines = F.split("text", "\n")

    def item(line, i):
        words = F.transform(F.split(F.regexp_replace(line, "[^!-~]+", " "), " "),
                            lambda w: F.struct(F.concat(F.lit(" "), w).alias("text")))
        full = F.filter(words, lambda w: w["text"] != " ")
        label = F.when(i % 3 == 0, "question").when(i % 3 == 1, "Answer").otherwise("stamp")
        return F.struct(label.alias("label"), full.alias("words"), i.alias("id"))

    built = t.read(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), F.transform(lines, item).alias("form"))
    path = work_dir(spark, "pages")
    built.write.json(path)
    done = pg.page_examples(spark.read.schema("page_id long, " + pg.PAGE).json(path))
    return done.select("page_id", "text", F.array_join(F.transform("spans", lambda s: s["label"]), ",").alias("labels"))


@query("word_page_examples", """
WITH w AS (SELECT item_id, list_filter([trim(x) FOR x IN string_split(regexp_replace(text, '[^!-~]+', ' ', 'g'), ' ')], lambda x: x <> '') AS w FROM benchmark)
SELECT item_id AS page_id, array_to_string(w, ' ') AS text, CAST(len(w) AS INT) AS spans, CAST(length(array_to_string(w, ' ')) AS INT) AS last_end FROM w""")
def word_page_examples(spark, d):
    words = F.split(F.regexp_replace("text", "[^!-~]+", " "), " ")
    pages = t.read(spark, d, "benchmark").select(
        F.col("item_id").alias("page_id"), words.alias("words"),
        F.transform(words, lambda _, i: i % 5).alias("labels"))
    done = pg.word_page_examples(pages)
    return done.select("page_id", "text", F.size("spans").alias("spans"),
                       F.element_at("spans", -1)["end"].alias("last_end"))


@query("name_pools", """
SELECT 'first' AS pool, p_name AS name FROM (SELECT DISTINCT p_name FROM part) UNION ALL
SELECT p, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer), (VALUES ('last'), ('middle')) v(p)""")
def name_pools(spark, d):
    """A name file without middle names, which then repeat the last names."""
    names = t.read(spark, d, "part").selectExpr("'first' AS pool", "p_name AS name").unionByName(
        t.read(spark, d, "customer").selectExpr("'last' AS pool", "c_mktsegment AS name")).distinct()
    path = work_dir(spark, "names")
    names.write.json(path)
    return ann.read_name_lines(spark, path)


@query("prediction_rows", """
SELECT p_name AS truth, translate(p_name, 'e', '3') AS pred, CASE WHEN p_name = translate(p_name, 'e', '3') THEN '✓' ELSE '✗' END AS mark FROM part""")
def prediction_rows(spark, d):
    path = work_dir(spark, "predictions")
    writers.write_predictions(t.read(spark, d, "part").selectExpr("p_name AS truth", "translate(p_name, 'e', '3') AS pred"), path)
    back = spark.read.option("sep", "\t").option("header", "true").csv(path)
    return back.toDF("truth", "pred", "mark")


@query("result_json", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS name, c_mktsegment AS segment FROM customer""")
def result_json(spark, d):
    path = work_dir(spark, "results")
    writers.write_results(t.read(spark, d, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS name", "c_mktsegment AS segment"), path)
    return spark.read.schema("c_custkey long, name string, segment string").json(path)


@query("span_corpus_file", """
SELECT 'train' AS split, count(*) AS docs FROM conversations WHERE turn > 0 AND trim(text, ' ' || chr(10)) <> '' UNION ALL SELECT 'dev', count(*) FROM conversations WHERE turn = 0 AND trim(text, ' ' || chr(10)) <> ''""")
def span_corpus_file(spark, d):
    from vitalforms.functions import spans as sp

    turns = t.read(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text",
        F.array(sp.span(F.lit(0), F.length("text"), F.lit("TEXT"))).alias("spans"),
        F.when(F.col("turn") == 0, "dev").otherwise("train").alias("split"))
    path = work_dir(spark, "corpus")
    writers.write_span_corpus(span_ops.span_corpus(turns).filter(F.trim(F.regexp_replace("text", "\n", " ")) != ""), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("docs"))


@query("upload_insert", with_ctes(DOCS) + """
SELECT (SELECT max(doc_id) FROM docs) + row_number() OVER (ORDER BY md5('|' || page_id)) AS doc_id, page_id % 10 AS user_id,
  'Pending' AS status, url AS raw_text FROM pages""")
def upload_insert(spark, d):
    pages = t.read(spark, d, "pages")
    uploads = pages.selectExpr("page_id AS upload_key", "page_id % 10 AS user_id", "CAST(page_id % 4 + 1 AS INT) AS type_id",
                               "TIMESTAMP '2026-01-01 00:00:00' AS uploaded_at")
    docs = writers.upload_rows(uploads, t.documents(spark, d))
    logs = writers.log_rows(docs, pages.selectExpr("page_id AS upload_key", "url AS text"))
    return docs.join(logs.select("doc_id", "raw_text"), "doc_id").select("doc_id", "user_id", "status", "raw_text")


@query("label_json", """
SELECT doc_id, quality, toxic FROM labels""")
def label_json(spark, d):
    """Rows through JSON text and back."""
    rows = t.read(spark, d, "labels").select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("j"))
    return rows.select(F.from_json("j", "doc_id long, quality int, toxic int").alias("r")).select("r.*")


@query("page_rejects", """
WITH p AS (SELECT conv_id * 100 + turn AS page_id, conv_id * 7 + turn AS k, len(string_split(text, chr(10))) AS lines FROM conversations)
SELECT page_id, CASE k % 8 WHEN 0 THEN 'not json' WHEN 1 THEN 'no form' WHEN 2 THEN 'form is no list' WHEN 3 THEN 'wrong type' WHEN 4 THEN 'blank' END AS reason,
  CASE WHEN k % 8 > 4 THEN CAST(lines AS INT) END AS blocks FROM p""")
def page_rejects(spark, d):
    """Turns as page texts, five of eight of them broken in one of five ways; the others are read whole."""
    turns = t.read(spark, d, "conversations")
    block = lambda x, i: F.struct(F.array(F.lit(0)).alias("box"), x.alias("text"), F.lit("other").alias("label"), i.alias("id"))
    page = F.to_json(F.struct(F.transform(F.split("text", "\n"), block).alias("form")))
    k = (F.col("conv_id") * 7 + F.col("turn")) % 8
    value = (F.when(k == 0, F.expr("substring(page, 1, length(page) - 2)")).when(k == 1, F.concat(F.lit('{"pages": '), "page", F.lit("}")))
             .when(k == 2, F.concat(F.lit('{"form": '), "page", F.lit("}"))).when(k == 3, F.replace("page", F.lit('"id":0'), F.lit('"id":"first"')))
             .when(k == 4, F.lit(" \n")).otherwise(F.col("page")))
    rows = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), k.alias("k"), page.alias("page"), "conv_id", "turn")
    done = pg.checked(rows.select("page_id", value.alias("value")))
    return done.select("page_id", "reason", F.when(F.col("form").isNotNull(), F.size("form")).alias("blocks"))
