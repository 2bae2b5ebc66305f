"""Near-duplicates by MinHash with tensored banding.

Two small collections of hashes are computed per document: M left halves and
M right halves of R minima each.  Table (i, j) uses left half i and right half
j as its key, so M * M tables need only 2 * M * R minima.  Two documents meet
in some table exactly when they agree in any left and in any right half.  M
follows from the similarity asked for, so that a pair at it is missed with a
probability of at most 7.1e-5: with R = 2, M = 8 at 0.85 (7.0e-5) and 11 at 0.8
(2.6e-5).  Every pair that meets is decided on the full shingle sets.

Inside a bucket documents are compared with its smallest and largest member
only, never pairwise.  For members of a bucket that still lie in different
components afterwards the pairs to compare come from their rarest shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.llm.common import in_blocks, mix, prefix_hashes, range_hashes, staged

HALVES, MINIMA = 8, 2
BLOCK = 400_000  # bytes of text hashed at once: a dozen tables of 64-bit numbers per byte or word are held for them
MISSED = 7.1e-5  # probability at most of missing a pair at the similarity asked for
_A = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    h = range_hashes(prefix_hashes(data), starts, ends)
    of_doc = np.searchsorted(starts, firsts)
    rows = np.full(len(h), np.uint64(width))
    for k in reversed(range(width)):
        shifted = np.zeros(len(h), np.uint64)
        shifted[:max(0, len(h) - k)] = h[k:]
        rows = mix(rows * _A + shifted)
    found = []
    for a, b in zip(of_doc[:-1], of_doc[1:]):
        if b - a >= width:
            found.append(np.unique(rows[a:b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a) + np.uint64(1 << 40)
            for x in h[a:b]:
                whole = mix(np.array([whole]) * _A + x)[0]
            found.append(np.array([whole], np.uint64))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def halves_for(percent: int, minima: int = MINIMA) -> int:
    """The least number of halves on a side that misses a pair at the similarity with probability ``MISSED`` at most."""
    if percent <= 0:
        raise ValueError("the similarity must be above 0")
    apart, halves = 1 - (percent / 100) ** minima, 1
    while 1 - (1 - apart ** halves) ** 2 > MISSED:
        halves += 1
    return halves


def _half_keys(sets: list[np.ndarray], halves: int, minima: int) -> np.ndarray:
    """Keys of the left and right halves, one row per (non-empty) set."""
    flat = np.concatenate(sets)
    offsets = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, 4 * halves * minima + 1, dtype=np.uint64))
    keys = np.empty((len(sets), 2 * halves), np.uint64)
    for half in range(2 * halves):
        key = np.full(len(sets), np.uint64(half + 1))
        for k in range(half * minima, (half + 1) * minima):
            least = np.minimum.reduceat(flat * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1], offsets)
            key = mix(key * _A + least)
        keys[:, half] = key
    return keys


def signatures(docs: DataFrame, width: int = 3, halves: int = HALVES, minima: int = MINIMA) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, halves): set identity and half keys per row."""
    def work(batch, texts):
        sets = shingle_sets(texts, width)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = np.zeros((len(sets), 2 * halves), np.uint64)
        if full:
            keys[full] = _half_keys([sets[i] for i in full], halves, minima)
        sums = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s + _A).sum(dtype=np.uint64))) for s in sets]
        array = pa.ListArray.from_arrays(
            pa.array(np.arange(0, keys.size + 1, 2 * halves, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
             *(pa.array(np.array([p[k] for p in sums], np.uint64).view(np.int64)) for k in (0, 1)), array],
            names=["doc_id", "n_shingles", "set_a", "set_b", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: in_blocks(batches, work, size=BLOCK),
        "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")


def shingles_of(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, shingles): the full set of each row as sorted hashes."""
    def work(batch, texts):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(texts, width)], pa.list_(pa.int64()))],
            names=["doc_id", "shingles"])

    return docs.mapInArrow(lambda batches: in_blocks(batches, work, size=BLOCK), "doc_id long, shingles array<long>")


def wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the wanted ids; the same plan at every size."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(wanted.hint("merge"), "doc_id", "left_semi")
    return staged(shingles_of(chosen, width).dropDuplicates(["doc_id"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
            .withColumn("_common", common)
            .where(100 * F.col("_common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("_common")))
            .select("a", "b"))


def across(open_docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``open_docs`` (doc_id, component) in different components that can reach the similarity.

    Two sets of that similarity share one of the rarest shingles of each: of a
    set of n, the first n - ceil(percent * n / 100) + 1 in order of frequency.
    Shingles found once come first and match nothing, so a set with enough of
    its own drops out before any pair is formed.  The first shingle that two
    such sets share has enough shingles from it on (``rest``) in both.
    """
    sized = open_docs.join(sets.hint("merge"), "doc_id").select("doc_id", "component", F.size("shingles").alias("n"), "shingles")
    tokens = sized.select("doc_id", "component", "n", F.explode("shingles").alias("s"))
    often = staged(tokens.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"), "often")
    met = tokens.join(often.hint("merge"), "s")
    own = Window.partitionBy("doc_id")
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.count("*").over(own))
    heads = met.withColumn("_allowed", allowed).where("_allowed > 0").withColumn(
        "_rank", F.row_number().over(own.orderBy("f", "s"))).where("_rank <= _allowed")
    left_over = (F.col("_allowed") + F.ceil(F.col("n") * percent / 100) - F.col("_rank")).alias("rest")
    heads = staged(heads.select("s", "doc_id", "component", "n", left_over), "heads")
    left, right = (heads.select("s", F.col("doc_id").alias(k), F.col("component").alias(f"{k}_c"),
                                F.col("n").alias(f"{k}_n"), F.col("rest").alias(f"{k}_rest")) for k in "ab")
    reach = (100 + percent) * F.least("a_rest", "b_rest") >= percent * (F.col("a_n") + F.col("b_n"))
    return left.join(right, "s").where(
        (F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & reach).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in an edge.

    Each round every id takes the smallest label among its neighbours and then
    the label of its label, so a chain shortens by half or more.
    """
    edges = edges.distinct()
    both = staged(edges.union(edges.select("b", "a")).toDF("id", "other"), "edges")
    labels = staged(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        hooked = staged(labels.join(near, "id").select(
            "id", F.least("component", "near").alias("component"), F.col("component").alias("before")), "labels")
        roots = hooked.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = staged(hooked.join(roots, "component").select(
            "id", F.least("component", "root").alias("component"),
            (F.least("component", "root") != F.col("before")).alias("moved")), "labels")
        labels = jumped.select("id", "component")
        if jumped.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, halves: int | None = None,
                    minima: int = MINIMA) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Needs doc_id and text; other columns are ignored.  A null or blank text
    has an empty set and is linked with nothing.  Rows that repeat a doc_id
    stand for one document and share its result; a null doc_id is never
    linked, has a null component_id and is kept.
    """
    halves = halves_for(percent, minima) if halves is None else halves
    rows = staged(signatures(docs, width, halves, minima), "signatures")
    identity = ["set_a", "set_b", "n_shingles"]
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = staged(linked.groupBy(*identity).agg(F.min("doc_id").alias("first")), "groups")
    keyed = linked.select("doc_id", "halves").join(
        groups.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keys = F.array(*[F.xxhash64(F.col("halves")[i], F.col("halves")[halves + j])
                     for i in range(halves) for j in range(halves)])
    buckets = keyed.select("doc_id", F.explode(keys).alias("key"))
    ends = buckets.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    members = staged(buckets.join(staged(ends, "ends"), "key"), "members")
    pairs = staged(members.select(
        F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("doc_id").alias("b")),
                          F.struct(F.col("doc_id").alias("a"), F.col("high").alias("b")))).alias("p"))
        .select("p.*").where("a < b").distinct(), "pairs")
    sets = wanted_sets(docs, members.select("doc_id").distinct(), width)
    edges = staged(verified(pairs, sets, percent), "verified")
    labels = components(edges)

    named = members.select("key", "doc_id").join(
        labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    open_docs = staged(named.join(mixed, "key").select("doc_id", "component").distinct(), "open")
    rest = across(open_docs, sets, percent).join(pairs, ["a", "b"], "left_anti")
    more = staged(verified(staged(rest, "rest"), sets, percent), "verified")
    if not more.isEmpty():
        labels = components(edges.union(more))

    firsts = groups.join(labels, F.col("first") == F.col("id"), "left").select(
        *identity, F.coalesce("component", "first").alias("_component"))
    out = rows.select("doc_id", *identity).join(staged(firsts, "firsts"), identity, "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``.

    Of repeated rows with the kept doc_id one stays.
    """
    kept = near_duplicates(docs, width, percent).where("kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("_kept")).distinct()
    found = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return found.unionByName(docs.where(F.col("doc_id").isNull()))
