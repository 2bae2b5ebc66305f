"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.llm import (
    hard_negatives, language, licenses, maxscore, merkle, minhash_dedup, mixing, packing, personal_data, quality, sharding,
    suffix_dedup, token_counts,
)
from vitalforms.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"

_WORDS = r"'[^\x20\x09-\x0D]+'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(f"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM d),
x AS (SELECT doc_id, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * c >= 85 * (len(sa.g) + len(sb.g) - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, t.b FROM reach r JOIN both_ways t ON t.a = r.other)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) m USING (doc_id)""")
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, folder), width=3, percent=85)


@query()
def op2_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.removed_runs(documents(spark, folder), 50))


@query()
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path(VOCABULARY))


@query()
def op4_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.histogram_shards(documents(spark, folder), 24)


@query()
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.spans_by_document(documents(spark, folder))


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path(VOCABULARY))


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


@query(f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
  md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
y AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM z),
l AS (SELECT *, (CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100.0 - 2 * coalesce(sum(source_size) OVER (ORDER BY
    source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM y),
t AS (SELECT source, source_size, coalesce(least(weight * (SELECT level FROM l WHERE level * weight < 2 * source_size
    ORDER BY source_size / weight, source NULLS LAST LIMIT 1), CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target FROM l),
q AS (SELECT d.doc_id, d.size, d.draw, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN target > 0 THEN (sent + epoch * source_size) / target ELSE epoch END AS finish
  FROM q, (VALUES (0), (1)) v(epoch)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, draw, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN run <= (SELECT floor(sum(size) * 150 / 100) FROM d)
  THEN size ELSE 0 END) AS BIGINT) AS taken FROM r GROUP BY ALL""")
def op8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(documents(spark, folder), (5, 2, 1), 150, 2).drop("copies")


@query()
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.quality(documents(spark, folder), labels).drop("llr")


@query("""WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS t FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
c AS (SELECT vec_id, unnest(t) AS x, generate_subscripts(t, 1) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM c q JOIN c ON c.d = q.d
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op10_top_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = maxscore.quantised(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
c AS (SELECT vec_id, label, unnest(t) AS x, generate_subscripts(t, 1) AS d FROM v),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score FROM c a JOIN c ON c.d = a.d
  WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id GROUP BY 1, 2, 3),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled(rows.select("vec_id", "embedding", moved.alias("label")))
    return hard_negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


@query()
def op12_license_labels(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_labels(documents(spark, folder))


_LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
                    for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
    lambda x, unused: xor(x >> 1, (x & 1) * 3988292384))))"""


@query(f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE ':' || lang END AS g,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
l AS (SELECT g, doc_id, sha256({_LEAF.format(text="text")}) AS leaf, sha256({_LEAF.format(text="lowered")}) AS low,
  coalesce({_CRC32} % 3 = 0, false) AS tampered FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS id FROM l),
t(g, lvl, i, h, n) AS (SELECT g, 0, i, leaf, n FROM r UNION ALL
  SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY g, lvl, i // 8, n),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, h, n) AS (SELECT 0, i, h, n FROM sub UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, i // 8, n),
tn AS (SELECT DISTINCT g, lvl FROM t WHERE n > 1), un AS (SELECT DISTINCT lvl FROM u WHERE n > 1),
below AS (SELECT r.id, r.g, tn.lvl, r.i // CAST(pow(8, tn.lvl) AS BIGINT) AS me FROM r JOIN tn USING (g)),
above AS (SELECT r.id, un.lvl, sub.i // CAST(pow(8, un.lvl) AS BIGINT) AS me FROM r JOIN sub USING (g) CROSS JOIN un),
beside AS (SELECT b.id, 0 AS phase, b.lvl, b.me, t.i, t.h FROM below b LEFT JOIN t ON t.g = b.g AND t.lvl = b.lvl AND t.i // 8 = b.me // 8 AND t.i <> b.me
  UNION ALL SELECT a.id, 1, a.lvl, a.me, u.i, u.h FROM above a LEFT JOIN u ON u.lvl = a.lvl AND u.i // 8 = a.me // 8 AND u.i <> a.me),
steps AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY phase, lvl) - 1 AS k,
  coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < me), '') AS lefts,
  coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > me), '') AS rights FROM beside GROUP BY id, phase, lvl),
proof AS (SELECT id, count(*) AS m, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS p FROM steps GROUP BY id),
f(id, k, node) AS (SELECT id, 0, CASE WHEN tampered THEN low ELSE leaf END FROM r UNION ALL
  SELECT f.id, CAST(f.k + 1 AS INT), sha256(lefts || node || rights) FROM f JOIN steps s ON s.id = f.id AND s.k = f.k)
SELECT r.doc_id, r.leaf, sub.h AS subroot, u.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = u.h AS verified
FROM r JOIN sub USING (g) JOIN u ON u.n = 1 LEFT JOIN proof p ON p.id = r.id JOIN f ON f.id = r.id AND f.k = coalesce(p.m, 0)""")
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.proofs(documents(spark, folder))
