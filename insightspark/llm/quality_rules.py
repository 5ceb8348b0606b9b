"""Quality rules: counts over whole texts and zstandard compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import table_of, text_of

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
#: (bytes below, least, most): limits of raw bytes over compressed bytes of a whole document, by its length.
BANDS = [(256, 0.6, 2.0), (512, 1.1, 2.3), (1024, 1.2, 2.7), (2048, 1.3, 3.0), (4096, 1.4, 3.2), (8192, 1.45, 3.5), (16384, 1.5, 4.0), (65536, 1.5, 4.5), (1 << 62, 1.5, 5.5)]
#: Fixed chunks, their limits, and the share of chunks beyond them that rejects. A shorter last chunk belongs to the one before.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (1.25, 3.5), 0.3
_LEVEL = 3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = sum(code[i: i + n] * _MULTIPLIERS[i] for i in range(window))  # equal windows have equal keys
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    starts = np.nonzero(np.isin(keys, twice))[0].tolist()
    seen: dict[tuple[bytes, ...], int] = {}
    for at in starts:  # by the words themselves
        gram = tuple(words[at: at + window])
        seen[gram] = seen.get(gram, 0) + 1
    change = np.zeros(len(words) + 1, np.int64)
    for at in starts:
        if seen[tuple(words[at: at + window])] > 1:
            change[at] += 1
            change[at + window] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    data = text.encode()
    words = data.split()
    white = len(data) - len(data.translate(None, WHITE))
    lines = [x for x in text.split("\n") if x.encode().strip(WHITE)]
    return len(words), len(text) - white, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def band_of(size: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if size < below)


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Ratio of the whole text, number of chunks, and chunks out of their band; empty: (1, 0, 0)."""
    if not data:
        return 1.0, 0, 0
    ratio = len(data) / len(packer.compress(data))
    if len(data) < 2 * CHUNK:
        return ratio, 0, 0
    cuts = [*range(0, len(data) - CHUNK + 1, CHUNK), len(data)]
    if len(data) % CHUNK:
        cuts.pop(-2)
        cuts.insert(-1, (len(data) // CHUNK - 1) * CHUNK)
    cuts = sorted(set(cuts))
    out = 0
    for a, b in zip(cuts, islice(cuts, 1, None), strict=False):
        part = (b - a) / len(packer.compress(data[a:b]))
        out += not CHUNK_BAND[0] <= part <= CHUNK_BAND[1]
    return ratio, len(cuts) - 1, out


def in_bands(size: int, ratio: float, chunks: int, out: int) -> bool:
    low, high = band_of(size)
    return low <= ratio <= high and out <= CHUNK_SHARE * chunks


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=_LEVEL)
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            n_words, word_chars, n_symbols, n_dup_lines, n_repeat = counts(text)
            data = text.encode()
            ratio, chunks, out = compression(data, packer)
            failed = n_words < 10 or 100 * n_repeat > 20 * n_words
            rows.append((n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, not failed and in_bands(len(data), ratio, chunks, out), ratio, chunks, out))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 10
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        yield pa.record_batch([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=_NAMES)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_chunks_out"]


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed``, the verdict ``kept`` and the compression figures.

    A document fails with fewer than 10 words or with over a fifth of its words in repeated windows of 5 words. The
    rest is kept if the zstandard ratio of the whole text lies in the band of its length and at most ``CHUNK_SHARE`` of
    its chunks lie beyond the chunk band: repetitive text lies above, incompressible text below. NULL and empty
    texts have no words and fail; every text is read whole; rows that repeat or lack a ``doc_id`` each get a row.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(_rules, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_out long")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table_of(spark, sf_dir, "documents"))
