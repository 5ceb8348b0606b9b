"""Token shards as wavelet matrices: one compressed file with access, counting and occurrence lookup."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insightspark.llm.common import stored, table_of, text_of
from insightspark.llm.tokens import encoder, vocabulary
from insightspark.session import work_path

MAGIC = b"WMTX0001"
_HEAD = struct.Struct("<8sQQB")
#: Bits between two entries of a plane's rank directory.
BLOCK = 512
#: Ids of a shard, more only if its last document is longer.
SHARD_IDS = 1 << 22


class WaveletMatrix:
    """Bit-planes from the top bit down, each a stable split of the ids before it into zeros, then ones."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: np.ndarray, ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.bits = len(planes)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], np.zeros(bits, np.int64), []
        for level in range(bits):
            bit = (values >> (bits - 1 - level)) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ranks.append(cls._directory(packed))
            low = values[~bit]
            zeros[level] = len(low)
            values = np.concatenate([low, values[bit]])
        return cls(len(values), planes, zeros, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        step = BLOCK // 8
        padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        plane, step = self.planes[level], BLOCK // 8
        block = at // BLOCK
        out = self.ranks[level][block].astype(np.int64)
        cells = (block * step)[:, None] + np.arange(step)
        keep = np.clip(at[:, None] - cells * 8, 0, 8)
        data = plane[np.minimum(cells, len(plane) - 1)] if len(plane) else np.zeros(cells.shape, np.uint8)
        return out + np.bitwise_count(data & ((1 << keep) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def access(self, positions) -> np.ndarray:
        """The ids at some positions."""
        at = np.atleast_1d(np.asarray(positions, np.int64)).copy()
        out = np.zeros(len(at), np.uint32)
        for level in range(self.bits):
            bit = (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._rank1(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = (out << 1) | bit
        return out

    def all(self) -> np.ndarray:
        """All ids, by undoing the splits from the last plane up."""
        values = np.zeros(self.n, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(values)
            before[~bit] = values[: self.zeros[level]]
            before[bit] = values[self.zeros[level]:] | np.uint32(1 << (self.bits - 1 - level))
            values = before
        return values

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's run starts after the last plane, and how many of it lie before ``end``."""
        start = 0
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([start, end]))
            if (token >> (self.bits - 1 - level)) & 1:
                start, end = int(self.zeros[level] + a), int(self.zeros[level] + b)
            else:
                start, end = int(start - a), int(end - b)
        return start, end - start

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token from ``start`` to ``end``."""
        if not self.n or token >> self.bits:
            return 0
        return self._range(token, self.n if end is None else end)[1] - self._range(token, start)[1]

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, ascending."""
        total = self.count(token)
        return np.array([self.select(token, k) for k in range(total)], np.int64)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, counted from 0."""
        start, total = self._range(token, self.n) if self.n else (0, 0)
        if not 0 <= k < total:
            raise IndexError(k)
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            one = (token >> (self.bits - 1 - level)) & 1
            at = self._select_bit(level, at - int(self.zeros[level]) if one else at, one)
        return at

    def _select_bit(self, level: int, k: int, one: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        cells = np.unpackbits(self.planes[level][block * BLOCK // 8: (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.nonzero(cells == one)[0][k - before[block]])


def to_file(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, bits: int) -> bytes:
    """A shard: head, then one zstandard frame of documents, zero counts, planes and rank directories."""
    matrix = WaveletMatrix.build(ids, bits)
    known = np.array([d is not None for d in doc_ids], bool)
    body = [np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), starts.astype("<u8").tobytes(), matrix.zeros.astype("<u8").tobytes()]
    body += [p.tobytes() for p in matrix.planes] + [r.astype("<u4").tobytes() for r in matrix.ranks]
    return _HEAD.pack(MAGIC, matrix.n, len(doc_ids), bits) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def from_file(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the documents and where each starts in it."""
    magic, n, docs, bits = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    body = zstandard.ZstdDecompressor().decompress(memoryview(data)[_HEAD.size:])
    at = 0

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    known = np.unpackbits(take((docs + 7) // 8, "u1"), count=docs)
    names = take(docs, "<i8")
    starts = take(docs, "<u8").astype(np.int64)
    zeros = take(bits, "<u8").astype(np.int64)
    planes = [take((n + 7) // 8, "u1") for _ in range(bits)]
    blocks = -(-((n + 7) // 8) // (BLOCK // 8)) + 1
    ranks = [take(blocks, "<u4") for _ in range(bits)]
    return WaveletMatrix(n, planes, zeros, ranks), [d if k else None for d, k in zip(names.tolist(), known.tolist(), strict=True)], starts


def _write(path: str, spaced: bool, end: int, bits: int, folder: str, shard_ids: int):
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, spaced)
        store, root = fs.FileSystem.from_uri(folder)
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, total
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"shard-{part:08d}-{shard:06d}"
            partial = f"{root}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(partial) as out:
                out.write(to_file(ids.astype(np.uint16) if bits <= 16 else ids, doc_ids, starts, bits))
            store.move(partial, f"{root}/{name}.wm")  # a retried task writes the same bytes to the same name
            row = pa.record_batch({"part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()), "file": pa.array([f"{name}.wm"]), "ids": pa.array([total], pa.int64())})
            shard, total = shard + 1, 0
            doc_ids.clear()
            parts.clear()
            return row

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, ids in zip(names, tokens.ids(texts), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids + tail)
                total += len(ids) // 4 + 1
                if total >= shard_ids:
                    yield flush()
        if parts:
            yield flush()
        tokens.task_over()

    return run


def write_shards(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, spaced: bool = False, end: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts and write shards to ``folder`` in ascending ``doc_id`` order; the list of files comes back.

    The list has ``part, shard, file, ids, before`` (ids of all files before it). Order over the shards is
    ``(part, shard)``; documents are dealt by ranges of ``doc_id`` (NULL first, rows that repeat an id by their text) and
    sorted within a range. NULL texts are empty and have the end id only. No row: no file.
    """
    path = tokenizer or vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    bits = max(1, (Tokenizer.from_file(path).get_vocab_size() - 1).bit_length())
    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions("doc_id", "text")
    files = stored(dealt.mapInArrow(_write(path, spaced, end, bits, folder, shard_ids), "part long, shard long, file string, ids long"), "shards")
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))  # one row for each partition
    inner = Window.partitionBy("part").orderBy("shard")
    return files.join(earlier, "part").select("part", "shard", "file", "ids", (F.col("earlier") + F.sum("ids").over(inner) - F.col("ids")).alias("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            matrix, doc_ids, starts = from_file(data.as_buffer().to_pybytes())
            raw = memoryview(matrix.all().astype("<u4", copy=False)).cast("B")
            ends = [*starts[1:].tolist(), matrix.n]
            yield pa.record_batch({
                "file": pa.array([path.rsplit("/", 1)[-1]] * len(doc_ids)), "doc_id": pa.array(doc_ids, pa.int64()), "at": pa.array(starts), "n_tokens": pa.array(np.array(ends, np.int64) - starts),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends, strict=True)], pa.int64())})


def read_digests(spark, folder: str) -> DataFrame:
    """``file, doc_id, at, n_tokens, ids_crc32`` of every document, read from the shards alone."""
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    return shards.mapInArrow(_digests, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")


def op5_wavelet(spark, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "tokens")
    files = write_shards(table_of(spark, sf_dir, "documents"), folder)
    return read_digests(spark, folder).join(files.select("file", "before"), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
