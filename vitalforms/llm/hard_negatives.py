"""Hard negatives by a BOND scan over vertically stored vectors.

Vectors lie in shards that keep one array per dimension.  For an anchor the
dimensions are read in the order of the anchor's descending magnitudes, a few
at a time.  What the unread dimensions can still add to a candidate lies
between the sums of their least and greatest contributions (from the smallest
and largest component of each dimension in the shard), so every candidate has
a lower and an upper score, and the candidates that cannot enter a result any
more leave the bitmap.  Two scans of this kind find

* the positives: the best rows of the anchor's own label,
* the negatives: rows of other labels whose score lies in the window that
  each positive sets; a candidate stays while its interval meets a window.

Every vector is packed into a shard where it is read and moves once, to a
bucket of shards.  Blocks of anchors are copied to the buckets and stream past
them; the k-th score found in one shard of a bucket is the starting threshold
in the next.  Only the best k of each bucket leave a task.
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

STEP = 8             # dimensions read between two prunings
SHARD_ROWS = 4096
BUCKET_ROWS = 65_536
BLOCK_ROWS = 256     # anchors of a block

HITS = "anchor_id long, bound long, vec_id long, score long"
_HITS = ("anchor_id", "bound", "vec_id", "score")


def labelled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, terms): floor(scale * x) of each finite vector that has a label; others take no part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("terms"))


def columns_of(terms: pa.Array) -> np.ndarray:
    """dimensions x rows; missing trailing terms are 0."""
    lengths = np.diff(terms.offsets.to_numpy())
    values = terms.flatten().to_numpy()
    width = int(lengths.max(initial=0))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((width, len(lengths)), np.int64)
    out[dims, rows] = values
    return out


class Shard:
    """Vectors of one shard, one array per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low = columns.min(axis=1, initial=0)    # 0 stands for the terms that shorter vectors lack
        self.high = columns.max(axis=1, initial=0)
        self.most = int(max(-self.low.min(initial=0), self.high.max(initial=0)))
        self.exact = columns.astype(np.float64) if self.most < 1 << 26 else columns

    def scan(self, q: np.ndarray, found: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]
             ) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates ``found`` that ``keep(lower, upper)`` left to the end."""
        width = min(len(q), len(self.columns))
        q = q[:width]
        # products are summed as doubles only while every sum stays below 2^53, so they are exact either way
        small = int(np.abs(q).max(initial=0)) * self.most * max(1, width) < 1 << 53
        columns = self.exact if small else self.columns
        q = q.astype(columns.dtype)
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.low[:width], q * self.high[:width]])
        rest = [np.append(np.cumsum(side[order][::-1])[::-1], 0) for side in (ends.min(axis=0), ends.max(axis=0))]
        score = np.zeros(len(found), columns.dtype)
        for i in range(0, width, STEP):
            dims = order[i:i + STEP]
            part = columns[dims] if len(found) == columns.shape[1] else columns[np.ix_(dims, found)]
            score += q[dims] @ part
            after = min(i + STEP, width)
            stays = keep(score + rest[0][after], score + rest[1][after])
            if not stays.all():
                found, score = found[stays], score[stays]
            if not len(found):
                break
        return found, score.astype(np.int64)


class Best:
    """The k best (score, id) met so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> int | None:
        return int(self.scores[-1]) if len(self.ids) == self.k else None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        chosen = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[chosen], scores[chosen]


def _kth(values: np.ndarray, k: int) -> float | None:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _threshold(*bounds):
    return max((b for b in bounds if b is not None), default=None)


def same_label(shard: Shard, anchor: int, label: int, q: np.ndarray, best: Best) -> None:
    """Adds the shard's rows of the anchor's label to ``best``."""
    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        least = _threshold(best.floor, _kth(lower, best.k))
        return np.ones(len(upper), bool) if least is None else upper >= least

    found, scores = shard.scan(q, np.flatnonzero((shard.labels == label) & (shard.ids != anchor)), keep)
    best.add(shard.ids[found], scores)


def in_windows(shard: Shard, anchor: int, label: int, q: np.ndarray, windows: list[tuple[int, int, Best]]) -> None:
    """Adds the shard's rows of other labels to the windows (least, greatest score, best) that hold their score."""
    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(upper), bool)
        for least, most, best in windows:
            inside = lower[(lower >= least) & (upper <= most)]
            stays |= (upper >= _threshold(least, best.floor, _kth(inside, best.k))) & (lower <= most)
        return stays

    found, scores = shard.scan(q, np.flatnonzero((shard.labels != label) & (shard.ids != anchor)), keep)
    for least, most, best in windows:
        chosen = (scores >= least) & (scores <= most)
        best.add(shard.ids[found[chosen]], scores[chosen])


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(number, body): up to ``size`` rows of a partition with their vectors as columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0

        def body(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            content = {n: table.column(n).to_numpy() for n in table.column_names if n not in ("terms", "bounds")}
            content["columns"] = columns_of(table.column("terms").combine_chunks())
            if "bounds" in table.column_names:
                content["bounds"] = table.column("bounds").to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([pickle.dumps(content)], pa.binary())],
                                              names=["number", "body"])

        held, count = [], 0
        for batch in batches:
            while len(batch):
                taken = batch.slice(0, size - count)
                batch = batch.slice(len(taken))
                held.append(taken)
                count += len(taken)
                if count == size:
                    yield body(held)
                    made, held, count = made + 1, [], 0
        if count:
            yield body(held)

    return rows.mapInArrow(work, "number long, body binary")


def _meet(shards: DataFrame, buckets: int, anchors: DataFrame, own: Callable, find: Callable, k: int) -> DataFrame:
    """HITS: every block of anchors against every bucket of shards.

    ``own(content, i, k)`` makes the state of an anchor, {bound: (…, Best)};
    ``find(shard, anchor, label, q, state)`` adds to it.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for at in range(len(batch)):
                here, is_anchor = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                content = pickle.loads(batch.column(3)[at].as_py())
                if here != bucket:
                    bucket, held = here, []
                if not is_anchor:
                    held.append(Shard(content["vec_id"], content["label"], content["columns"]))
                    continue
                out: list[list[int]] = [[], [], [], []]
                for i, (anchor, label) in enumerate(zip(content["vec_id"].tolist(), content["label"].tolist())):
                    states, q = own(content, i, k), content["columns"][:, i]
                    for shard in held:
                        find(shard, anchor, label, q, states)
                    for bound, state in states.items():
                        best = state[-1]
                        for values, new in zip(out, ([anchor] * len(best.ids), [bound] * len(best.ids), best.ids.tolist(),
                                                     best.scores.tolist())):
                            values += new
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=_HITS)

    sides = shards.select(F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("is_anchor"),
                          "number", "body").unionByName(anchors.select(
                              F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(True).alias("is_anchor"),
                              "number", "body"))
    return sides.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "is_anchor", "number").mapInArrow(work, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "bound").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positive_state(content: dict, i: int, k: int) -> dict:
    return {0: (Best(k),)}


def _find_positives(shard: Shard, anchor: int, label: int, q: np.ndarray, states: dict) -> None:
    same_label(shard, anchor, label, q, states[0][0])


def _negative_state(content: dict, i: int, k: int) -> dict:
    return {high: (low, high, Best(k)) for low, high in ((b["low"], b["high"]) for b in content["bounds"][i])}


def _find_negatives(shard: Shard, anchor: int, label: int, q: np.ndarray, states: dict) -> None:
    in_windows(shard, anchor, label, q, list(states.values()))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5,
                   least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both inputs have vec_id, label and terms (``labelled``); other columns are
    ignored.  Scores are integer inner products and must fit a long; a shorter
    vector has 0 in the terms it lacks.  An anchor's positives are its best
    other rows of the same label, negatives the best rows of other labels with
    least_percent * positive <= 100 * negative <= 100 * positive; ties go to
    the smaller vec_id.  A negative positive score has an empty window.  A row
    with the anchor's vec_id is the anchor itself; repeated candidates are
    candidates each, repeated anchors are asked once, with the smallest label
    and vector, and a positive returned twice with one score is answered once.
    Anchors without positives or negatives give no rows, and so do empty inputs.
    """
    spark = vectors.sparkSession
    packed = staged(_packed(vectors.select("vec_id", "label", "terms"), SHARD_ROWS), "negatives-shards")
    buckets = max(1, spark.sparkContext.defaultParallelism, -(-packed.count() * SHARD_ROWS // BUCKET_ROWS))
    asked = staged(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "terms")).alias("a")).select(
        "vec_id", "a.label", "a.terms"), "negatives-anchors")
    hits = _meet(packed, buckets, _packed(asked, BLOCK_ROWS), _positive_state, _find_positives, n_positives)
    positives = staged(_ranked(hits, n_positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col(
        "score").alias("positive_score")).distinct(), "negatives-positives")
    least = F.expr(f"(positive_score * {least_percent} + 99) div 100")  # only scores from 0 on have a window
    windows = positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_set(F.struct(least.alias("low"), F.col("positive_score").alias("high"))).alias("bounds"))
    wanted = _packed(asked.join(windows, "vec_id"), BLOCK_ROWS)
    found = _ranked(_meet(packed, buckets, wanted, _negative_state, _find_negatives, n_negatives), n_negatives)
    return positives.join(found.withColumnRenamed("bound", "positive_score"), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
