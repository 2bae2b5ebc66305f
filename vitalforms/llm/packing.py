"""Packing documents into fixed windows by the sum-of-squares rule.

Pieces arrive online.  A level array counts the open windows at each fill
level; a piece goes to the level (or a new window) for which the sum of the
squared counts grows least.  A document longer than a window first gives whole
windows.  When a task's documents end, the windows still open stay as the rule
filled them, fullest first, and are closed with pieces cut to fit from the
emptiest; less than one window is left over, which is cut into sequences whose
lengths are powers of two, so nothing needs padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalforms.llm.common import in_blocks
from vitalforms.llm.token_table import tokenizer

END_ID = (2).to_bytes(4, "little")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[object, int, bytes, int]  # doc_id, start, packed ids, tokens of the document


def tokens(pieces: Iterable[Piece]) -> int:
    return sum(len(p[2]) // 4 for p in pieces)


class SumOfSquares:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level whose window takes a piece of ``size`` (0: a new window)."""
        count, top = self.count, self.window - size
        # change of the sum of squares, halved: leaving level h and reaching h + size
        gain = count[size:] - count[:top + 1] + 1.0
        gain[top] = 0.5 - count[top]            # the window closes and leaves the array
        gain[0] = count[size] + 0.5             # nothing leaves level 0
        gain[1:][count[1:top + 1] == 0] = np.inf
        if size == self.window:
            return 0
        best = top - int(np.argmin(gain[::-1]))  # of equals the fullest
        return best

    def place(self, piece: Piece) -> list[Piece] | None:
        """The finished window, if the piece closes one."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        return None

    def remainder(self) -> Iterator[list[Piece]]:
        """The open windows, the fullest closed with pieces of the emptiest; the rest as powers of two."""
        held = deque(pieces for level in reversed(self.open) for pieces in level)
        spare: deque[Piece] = deque()

        def filled(pieces: list[Piece], room: int) -> int:
            """Moves spare tokens to ``pieces``; returns the room that stays."""
            while room and (spare or held):
                if not spare:
                    spare.extend(held.pop())
                doc, start, ids, total = spare.popleft()
                part, ids = ids[:4 * room], ids[4 * room:]
                pieces.append((doc, start, part, total))
                room -= len(part) // 4
                if ids:
                    spare.appendleft((doc, start + len(part) // 4, ids, total))
            return room

        while held:
            pieces = held.popleft()
            if filled(pieces, self.window - tokens(pieces)):
                spare.extend(pieces)
            else:
                yield pieces
        while left := tokens(spare):
            pieces = []
            filled(pieces, 1 << (left.bit_length() - 1))
            yield pieces


def pack(docs: DataFrame, vocabulary: str, window: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Each task packs the documents of its input split as they come, without a
    shuffle; a sequence is numbered by task and running number, so a repeated
    task gives the same rows.  A null or empty text is the end id alone;
    repeated rows are packed each; columns other than doc_id and text are
    ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        windows, number, rows = SumOfSquares(window), TaskContext.get().partitionId() << 32, []
        types: list[pa.DataType] = [pa.int64()]

        def close(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset))
                offset += len(ids) // 4
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, types[0] if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=names)

        def block(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            types[0] = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = encode(text.decode()) + END_ID
                total, start = len(ids) // 4, 0
                while total - start >= window:
                    close([(doc, start, ids[4 * start:4 * (start + window)], total)])
                    start += window
                if start < total and (done := windows.place((doc, start, ids[4 * start:], total))):
                    close(done)
            return out()

        yield from in_blocks(batches, block)
        for pieces in windows.remainder():
            close(pieces)
        if rows:
            yield out()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"doc_id {kind}, {PIECE}")
