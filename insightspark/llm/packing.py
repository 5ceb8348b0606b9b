"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import table_of, text_of
from insightspark.llm.mixing import stretch
from insightspark.llm.tokens import encoder, vocabulary

WINDOW = 1024
#: Open windows a task keeps; beyond them the open ones are closed by cutting.
OPEN_WINDOWS = 4096

#: One piece: document, ids before it, ids of the whole document, its ids.
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Online packing with one counter for each fill level.

    A remainder goes to the fill level (or a new window) for which the sum of squares of the counters of partially
    filled windows becomes least. Full stretches of a document are windows of their own. Windows that stay open are
    closed by :meth:`drain`: their pieces are laid end to end and cut at window ends, the last ids into windows of
    powers of two, so nothing needs padding.
    """

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next = window, first
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.closed: list[tuple[int, int, Piece]] = []

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for piece in pieces:
            self.closed.append((self.next, offset, piece))
            offset += len(piece[3]) // 4
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, size = len(ids) // 4, self.window
        for start in range(0, total - size + 1, size):
            self._close([(doc_id, start, total, ids[4 * start: 4 * (start + size)])])
        if rest := total % size:
            self._place((doc_id, total - rest, total, ids[4 * (total - rest):]), rest)
        if self.levels.sum() > OPEN_WINDOWS:
            self.drain()

    def _place(self, piece: Piece, size: int) -> None:
        # Moving a window from level h to h + s changes the sum of squares by 2 (N[h+s] - N[h]) + 2, a new window by
        # 2 N[s] + 1; a full window no longer counts.
        levels, full = self.levels, self.window
        change = 2 * (levels[1 + size:] - levels[1: full - size + 1]) + 2
        change[-1] = 1 - 2 * levels[full - size]
        change[levels[1: full - size + 1] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change)) if len(change) else -1
        level = best + 1 if best >= 0 and change[best] < 2 * levels[size] + 1 else 0
        pieces = self.open[level].pop() if level else []
        self.levels[level] -= bool(level)
        pieces.append(piece)
        if level + size == full:
            self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.levels[level + size] += 1

    def drain(self) -> None:
        """Close all open windows without padding."""
        loose: list[Piece] = []
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                if level & (level - 1):
                    loose += pieces
                else:
                    self._close(pieces)
            self.open[level] = []
        self.levels[:] = 0
        left = sum(len(p[3]) // 4 for p in loose)
        at = 0
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            pieces, need = [], size
            while need:
                doc_id, start, total, ids = loose[at]
                n = min(need, len(ids) // 4)
                pieces.append((doc_id, start, total, ids[: 4 * n]))
                need -= n
                if 4 * n == len(ids):
                    at += 1
                else:
                    loose[at] = (doc_id, start + n, total, ids[4 * n:])
            self._close(pieces)
            left -= size

    def take(self) -> pa.RecordBatch:
        rows, self.closed = self.closed, []
        return pa.record_batch({
            "doc_id": pa.array([p[0] for _, _, p in rows], pa.int64()), "start": pa.array([p[1] for _, _, p in rows], pa.int64()),
            "length": pa.array([len(p[3]) // 4 for _, _, p in rows], pa.int64()), "doc_tokens": pa.array([p[2] for _, _, p in rows], pa.int64()),
            "sequence_id": pa.array([s for s, _, _ in rows], pa.int64()), "offset": pa.array([o for _, o, _ in rows], pa.int64()),
            "ids": pa.array([p[3] for _, _, p in rows], pa.binary())})


def _pack(path: str, spaced: bool, end: int, window: int):
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, spaced)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1).to_pylist()), strict=True):
                packer.add(doc_id, ids + tail)
                if len(packer.closed) >= 4096:
                    yield packer.take()
        packer.drain()
        yield packer.take()
        tokens.task_over()

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, spaced: bool = True, end: int = 0, window: int = WINDOW, order: str | None = None, places: int | None = None) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (ids: little-endian unsigned 32 bit).

    Every partition packs its own documents in the order in which it reads them, so there is no shuffle and a retried
    task gives the same pieces. Sequence ids are the partition's number times 2^32 plus a running number. NULL texts
    are empty and have the end id only. With ``order`` (a column) the rows are first dealt into ranges of it and sorted inside,
    so sequence ids follow it from range to range, and inside a range but for the windows still open. Where ``order`` numbers the rows
    from 0 without gaps, ``places`` (their count) spares the sampling of ranges, which would run all before it once more. Each row is a document, whether or not its ``doc_id`` is NULL or repeated.
    Texts of any length are cut into full windows and one remainder. An empty table gives no rows.
    """
    if order is not None:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.col(order).alias("order"))
        docs = docs.repartitionByRange(parts, "order") if places is None else docs.repartitionById(parts, stretch(F.col("order"), places, parts))
        docs = docs.sortWithinPartitions("order")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    return rows.mapInArrow(_pack(path, spaced, end, window), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of the packing contract, from the packed ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table_of(spark, sf_dir, "documents")))
