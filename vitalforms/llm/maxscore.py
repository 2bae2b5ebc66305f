"""Exact top-k inner products by MaxScore over postings of signed dimensions.

A term is a dimension with a sign; the postings of (d, +) are the vectors with
a positive component d.  For a query only the lists whose sign agrees with its
own component can raise a score, each by at most |q_d| times the largest
magnitude in the list.  Terms are ordered by that bound; the tail whose bounds
together stay below the current k-th score is non-essential: a vector found in
no essential list cannot enter the result.  Vectors from essential lists are
probed in the other terms only while their partial score and the remaining
bounds can still reach the k-th score.

Every vector is packed into a shard where it is read; the postings of a shard
are built once, stored with it, and the shard moves once, to a bucket of
shards.  Blocks of queries are copied to the buckets and stream past them; the
k-th score found in one shard of a bucket is the starting threshold in the
next.  Only the k best of each bucket leave a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.llm.common import staged

HITS = "query_id long, vec_id long, score long"
HEAD, STEP = 32, 8
SHARD_ROWS = 4096
BUCKET_ROWS = 65_536
BLOCK_ROWS = 256      # queries of a block


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each finite vector; others take no part."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("terms"))


def _columns(terms: pa.Array) -> np.ndarray:
    """dimensions x rows; missing trailing terms are 0."""
    lengths = np.diff(terms.offsets.to_numpy())
    values = terms.flatten().to_numpy()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((int(lengths.max(initial=0)), len(lengths)), np.int64)
    out[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows] = values
    return out


def postings(columns: np.ndarray) -> dict:
    """For each signed dimension the rows with a component of that sign, largest first, and that largest magnitude."""
    lists, most = {}, np.zeros((2, len(columns)), np.int64)
    for d, column in enumerate(columns):
        for side, own in enumerate((column, -column)):
            found = np.flatnonzero(own > 0)
            found = found[np.argsort(-own[found], kind="stable")]
            lists[side, d] = found.astype(np.int32)
            most[side, d] = own[found[0]] if len(found) else 0
    return {"lists": lists, "most": most}


class Shard:
    """Vectors of one shard by dimension, with their postings."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, lists: dict, most: np.ndarray):
        self.ids, self.lists, self.most, self.columns = ids, lists, most, columns
        self.greatest = int(most.max(initial=0))
        self.doubles = columns.astype(np.float64) if self.greatest < 1 << 26 else columns

    def top(self, query_id: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, without rows below ``floor``, a score that k rows elsewhere reach."""
        width = min(len(q), len(self.columns))
        q = q[:width]
        # products are summed as doubles only while every sum stays below 2^53, so they are exact either way
        small = int(np.abs(q).max(initial=0)) * self.greatest * max(1, width) < 1 << 53
        columns = self.doubles if small else self.columns
        side = (q < 0).astype(np.int64)
        bound = np.abs(q) * self.most[side, np.arange(width)]
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what terms[i:] can still add
        q = q.astype(columns.dtype)
        least = floor
        heads = np.unique(np.concatenate([self.lists[side[d], d][:HEAD] for d in terms[:STEP]] or [[]])).astype(np.int64)
        heads = heads[self.ids[heads] != query_id]
        if len(heads) >= k and (least is None or rest[0] >= least):
            kth = int(np.partition(q @ columns[:width, heads], len(heads) - k)[len(heads) - k])
            least = kth if least is None else max(least, kth)
        if least is None or least <= 0:
            found = np.arange(len(self.ids))  # a vector in no list of the query scores 0 at most
        else:
            essential = int(np.argmax(rest < least))
            hit = np.zeros(len(self.ids), bool)
            for d in terms[:essential]:
                hit[self.lists[side[d], d]] = True
            found = np.flatnonzero(hit)
        found = found[self.ids[found] != query_id]
        score = np.zeros(len(found), columns.dtype)
        for i in range(0, width, STEP):
            dims = terms[i:i + STEP]
            part = columns[dims] if len(found) == len(self.ids) else columns[np.ix_(dims, found)]
            score += q[dims] @ part
            if least is not None:
                keep = score + rest[min(i + STEP, width)] >= least
                if not keep.all():
                    found, score = found[keep], score[keep]
            if not len(found):
                break
        if len(found) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]  # ties of the k-th are ordered below
            found, score = found[near], score[near]
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[best]], score[best].astype(np.int64)


def _packed(rows: DataFrame, size: int, more: Callable[[np.ndarray], dict] | None = None) -> DataFrame:
    """(number, body): up to ``size`` rows of a partition as ids, columns and what ``more`` makes of the columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, count = TaskContext.get().partitionId() << 32, [], 0

        def body() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = _columns(table.column("terms").combine_chunks())
            content = {"ids": table.column("vec_id").to_numpy(), "columns": columns, **(more(columns) if more else {})}
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([pickle.dumps(content)], pa.binary())],
                                              names=["number", "body"])

        for batch in batches:
            while len(batch):
                taken = batch.slice(0, size - count)
                batch = batch.slice(len(taken))
                held.append(taken)
                count += len(taken)
                if count == size:
                    yield body()
                    first, held, count = first + 1, [], 0
        if count:
            yield body()

    return rows.select("vec_id", "terms").mapInArrow(work, "number long, body binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS,
          bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each query.

    Both inputs have vec_id and terms (``quantised``); other columns are
    ignored.  Ties go to the smaller vec_id.  A vector with the query's vec_id
    is its own and never returned; repeated candidates are candidates each,
    repeated queries are asked once, with the smallest vector.  A shorter
    vector has 0 in the terms it lacks.  With fewer than k candidates all are
    returned; empty inputs give no rows.

    A task holds one bucket of shards and one block of queries.  Vectors are
    moved once, whatever the number of queries.
    """
    spark = vectors.sparkSession
    shards = staged(_packed(vectors, shard_rows, postings), "products-shards")
    buckets = max(1, spark.sparkContext.defaultParallelism, -(-shards.count() * shard_rows // bucket_rows))
    asked = _packed(queries.groupBy("vec_id").agg(F.min("terms").alias("terms")), block_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for here, is_query, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                content = pickle.loads(body.as_py())
                if here != bucket:
                    bucket, held = here, []
                if not is_query:
                    held.append(Shard(**content))
                    continue
                out: list[tuple[np.ndarray, ...]] = []
                for query, q in zip(content["ids"].tolist(), content["columns"].T):
                    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
                    for shard in held:
                        found = shard.top(query, q, k, int(scores[-1]) if len(scores) == k else None)
                        ids, scores = np.concatenate([ids, found[0]]), np.concatenate([scores, found[1]])
                        best = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[best], scores[best]
                    out.append((np.full(len(ids), query), ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)],
                                                 names=["query_id", "vec_id", "score"])

    sides = shards.select(F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("is_query"),
                          "number", "body").unionByName(asked.select(
                              F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(True).alias("is_query"),
                              "number", "body"))
    hits = sides.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "is_query", "number").mapInArrow(work, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
