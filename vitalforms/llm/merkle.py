"""Merkle manifest of a table, kept in blocks of van Emde Boas layout.

Leaves are digests of whole rows.  Per group (language) the ordered leaves form
an eight-fold hash tree; the roots of the groups form one more tree above them.
A tree is stored as blocks: aligned subtrees of at most ``LEVELS`` levels above
their leaves, each one row with all its nodes.  Inside a block the nodes lie in
van Emde Boas order: a subtree is split at half its height, the top part comes
first, then the bottom parts, each laid out the same way.  ``address`` computes
where a node lies; building a block and reading siblings use nothing else.  The
roots of the blocks are the leaves of the next level of blocks, so a tree of n
leaves takes about log(n) / log(8 ** LEVELS) rounds.

Texts never move: the rows are hashed where they are read, and only digests are
put in order (by a range exchange, so that one group may hold all rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.llm.common import staged

FAN = 8
LEVELS = 3
SPAN = FAN ** LEVELS
DIGEST = 64  # a digest is its lowercase hex text
ABSENT = b" " * DIGEST
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = ("grp string, block long, n long, height int, count int, root string, nodes binary, "
         "ids array<long>, changed array<string>")
PATH = "grp string, block long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
         "verified boolean")


def digest(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def nodes_in(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth (root: 0) in a complete tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = FAN ** (depth - top)  # nodes of this depth in one bottom part
    return nodes_in(top) + index // width * nodes_in(levels - top) + address(levels - top, depth - top, index % width)


@lru_cache(maxsize=None)
def places(height: int) -> list[list[int]]:
    """Addresses by level above the leaves (0) and index, for a block of this height."""
    return [address(height + 1, height - level, np.arange(FAN ** (height - level))).tolist()
            for level in range(height + 1)]


def build(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a block; a run of fewer than eight nodes is hashed as it is."""
    at, nodes = places(height), [ABSENT] * nodes_in(height + 1)
    for place, leaf in zip(at[0], leaves):
        nodes[place] = leaf
    count = len(leaves)
    for level in range(1, height + 1):
        below, children = at[level - 1], count
        count = -(-count // FAN)
        for i in range(count):
            nodes[at[level][i]] = digest(b"".join(
                nodes[p] for p in below[FAN * i:min(FAN * i + FAN, children)]))
    return nodes


def siblings(nodes: list[bytes], height: int, count: int) -> list[tuple[list[bytes], list[bytes]]]:
    """Per level below the root: what stands left and right of each node in its run, joined."""
    at, out = places(height), []
    for level in range(height):
        left, right = [], []
        for start in range(0, count, FAN):
            run = [nodes[p] for p in at[level][start:min(start + FAN, count)]]
            for i in range(len(run)):
                left.append(b"".join(run[:i]))
                right.append(b"".join(run[i + 1:]))
        out.append((left, right))
        count = -(-count // FAN)
    return out


def height_of(n: int) -> int:
    """Levels above ``n`` leaves inside one block."""
    height = 0
    while height < LEVELS and FAN ** height < n:
        height += 1
    return height


def leaf_digest(text: Column | str = "text") -> Column:
    """sha256 of doc_id, source, lang, n_chars and the text: `-` for null, else bytes, `:`, value."""
    def part(x: Column) -> Column:
        x = x.cast("string")
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))

    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(*[part(F.col(c) if c != "text" else text) for c in FIELDS]), 256)


def is_tampered() -> Column:
    """The rows whose text the check tampers with: 3 divides crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, slices) of rows that come sorted by ``keys``; holds one key at a time."""
    key, held = None, []
    for batch in batches:
        values = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]))
        start = 0
        for own, rows in groupby(values):
            size = len(list(rows))
            if own != key and held:
                yield key, held
                held = []
            key = own
            held.append(batch.slice(start, size))
            start += size
    if held:
        yield key, held


def _column(slices: list[pa.RecordBatch], name: str) -> list:
    return [x for s in slices for x in s.column(s.schema.get_field_index(name)).to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``pos``: the number of rows of the same group before it in its partition."""
    last, pos = None, 0
    for batch in batches:
        groups, out = batch.column(batch.schema.get_field_index("grp")).to_pylist(), []
        for own, rows in groupby(groups):
            size = len(list(rows))
            pos = pos if own == last else 0
            out.append(np.arange(pos, pos + size))
            last, pos = own, pos + size
        numbers = np.concatenate(out) if out else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())],
                                         names=[*batch.schema.names, "pos"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (staged, with a column grp) and at: the place in the group by ``order``; n: rows of the group.

    One range exchange by (grp, order); places count on from the partitions
    before, of which there is one row each.  ``order`` must end in a column
    without repeats, so that equal rows are spread as well.
    """
    keys = ["grp", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    ranged = staged(ranged.mapInArrow(_counted, f"{fields}, pos long"), "merkle-order")
    own = Window.partitionBy("grp")
    starts = ranged.groupBy("grp", "part").agg(F.count("*").alias("size")).select(
        "grp", "part",
        F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("size").over(own).alias("n"))
    return ranged.join(starts, ["grp", "part"]).withColumn("at", F.col("start") + F.col("pos")).drop("part", "pos", "start")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block from rows (grp, at, n, digest, doc_id, changed)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block), slices in _runs(batches, ("grp", "block")):
            n = _column(slices[:1], "n")[0]
            leaves = [d.encode() for d in _column(slices, "digest")]
            height = height_of(n)
            nodes = build(leaves, height)
            values = (grp, block, n, height, len(leaves), nodes[0].decode(), b"".join(nodes),
                      _column(slices, "doc_id"), _column(slices, "changed"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, (
                    pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(),
                    pa.list_(pa.int64()), pa.list_(pa.string())))],
                names=["grp", "block", "n", "height", "count", "root", "nodes", "ids", "changed"])

    cut = rows.select("grp", F.expr(f"at div {SPAN}").alias("block"), "at", "n", "digest", "doc_id", "changed")
    return cut.repartition("grp", "block").sortWithinPartitions("grp", "block", "at").mapInArrow(work, BLOCK)


def manifest(leaves: DataFrame) -> list[DataFrame]:
    """Tables of blocks, lowest first, from numbered leaves; each is written to the shared folder."""
    levels = [staged(_blocks(leaves), "merkle-blocks")]
    while levels[-1].where(F.col("n") > SPAN).limit(1).count():
        roots = levels[-1].where(F.col("n") > SPAN).select(
            "grp", F.col("block").alias("at"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed"))
        levels.append(staged(_blocks(roots), "merkle-blocks"))
    return levels


def group_roots(levels: list[DataFrame]) -> DataFrame:
    """(grp, root) of every group: its only block on the level where it has one."""
    roots = None
    for level in levels:
        found = level.where(F.col("n") <= SPAN).select("grp", "root")
        roots = found if roots is None else roots.unionByName(found)
    return roots


def _descend(blocks: DataFrame, paths: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """Blocks met by the paths above their roots; ``emit`` gets each block, its siblings and its path."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                blob = row["nodes"]
                nodes = [blob[p:p + DIGEST] for p in range(0, len(blob), DIGEST)]
                yield emit(row, nodes, siblings(nodes, row["height"], row["count"]))

    met = blocks.withColumnRenamed("root", "top").join(paths, ["grp", "block"])
    return met.mapInArrow(work, schema)


def _paths_below(row: dict, nodes: list[bytes], beside: list[tuple[list[bytes], list[bytes]]]) -> pa.RecordBatch:
    """The paths of a block's leaves, which are the roots of the blocks below."""
    count, out = row["count"], [[], []]
    for side in (0, 1):
        above = row[("lefts", "rights")[side]]
        for i in range(count):
            out[side].append([b[side][i >> 3 * level].decode() for level, b in enumerate(beside)] + above)
    first = row["block"] * SPAN
    texts = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([row["grp"]] * count, pa.string()), pa.array(range(first, first + count), pa.int64()),
         pa.array(out[0], texts), pa.array(out[1], texts),
         pa.array([row["subroot"]] * count, pa.string()), pa.array([row["root"]] * count, pa.string())],
        names=["grp", "block", "lefts", "rights", "subroot", "root"])


def _proofs(row: dict, nodes: list[bytes], beside: list[tuple[list[bytes], list[bytes]]]) -> pa.RecordBatch:
    """Digest of the siblings of each leaf, and the root that follows from its tampered or original form."""
    count, leaf_at = row["count"], places(row["height"])[0]
    above = [(a.encode(), b.encode()) for a, b in zip(row["lefts"], row["rights"])]
    shared = b"".join(a + b for a, b in above)
    both = [[a + b for a, b in zip(*level)] for level in beside]
    leaves, proofs, folded = [], [], []
    for i in range(count):
        leaf = nodes[leaf_at[i]]
        proofs.append(sha256(b"".join([level[i >> 3 * k] for k, level in enumerate(both)]) + shared).hexdigest())
        own = row["changed"][i]
        node = leaf if own is None else own.encode()
        for k, (left, right) in enumerate(beside):
            node = digest(left[i >> 3 * k] + node + right[i >> 3 * k])
        for left, right in above:
            node = digest(left + node + right)
        leaves.append(leaf.decode())
        folded.append(node.decode())
    text = pa.string()
    return pa.RecordBatch.from_arrays(
        [pa.array(row["ids"], pa.int64()), pa.array(leaves, text), pa.array([row["subroot"]] * count, text),
         pa.array([row["root"]] * count, text), pa.array(proofs, text), pa.array(folded, text),
         pa.array([f == row["root"] for f in folded], pa.bool_())],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _paths_to(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the lowest blocks of a manifest; ``tops`` (grp, lefts, rights, subroot, root) leads to the groups' roots."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].where(F.col("n") <= SPAN).select("grp", "block").join(tops, "grp")
        paths = own if paths is None else paths.unionByName(own)
        if k:
            paths = staged(_descend(levels[k], paths, _paths_below, PATH), "merkle-paths")
    return paths


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    ``docs`` has doc_id, source, lang, n_chars and text; any of them may be
    null, other columns are ignored.  Leaves ascend by doc_id (null first);
    repeated ids go by leaf, equal rows in any order, which changes which of
    them has which proof, never a root.  Languages go by their UTF-8 bytes,
    null before the empty one.  A language of one row has its leaf as subroot;
    without other languages that is the root and the proof is the digest of
    nothing.  A text without A-Z is not changed by tampering and verifies.
    Texts of any length are hashed whole.  An empty table gives no rows.
    """
    rows = staged(docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col("lang"))).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"),
        F.when(is_tampered(), leaf_digest(_lowered(F.col("text")))).alias("changed"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    levels = manifest(numbered(rows, ["doc_id", "digest", "row"]))
    none = F.array().cast("array<string>")
    roots = staged(group_roots(levels).select(
        F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("string").alias("changed")), "merkle-roots")
    ranked = staged(numbered(roots, ["name"]), "merkle-groups")
    upper = manifest(ranked)
    whole = group_roots(upper).select("grp", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), "root")
    ends = _descend(upper[0], _paths_to(upper, whole), _paths_below, PATH)  # one path per group, by its place
    tops = staged(ranked.select(F.col("name").alias("own"), F.col("at").alias("block"), "digest").join(
        ends.drop("grp"), "block").select(F.col("own").alias("grp"), "lefts", "rights", F.col("digest").alias("subroot"), "root"),
        "merkle-tops")
    return _descend(levels[0], _paths_to(levels, tops), _proofs, PROOF)
