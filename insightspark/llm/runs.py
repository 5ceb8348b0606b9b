"""Periodic runs of words by online dyadic square catching."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm.common import free_name, slices, table_of

#: Least number of words of a run and of its periods.
LEAST, PERIODS = 24, 3
#: Words appended at once.
APPEND = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64 for i below ``count``; the first ones are kept by the worker."""
    known = _KEPT.get(base)
    if known is None or len(known) < count:
        known = np.full(max(count, 1 << 12), np.uint64(base & _WORD))
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= APPEND:
            _KEPT[base] = known
    return known[:count]


def _scattered(ids: np.ndarray) -> np.ndarray:
    """Word numbers as well-mixed 64-bit values."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Catchers:
    """Runs of a sequence that only grows.

    A catcher belongs to a completed block of ``b`` words, ``b`` a power of two, at a multiple of ``b``. It compares its block
    with the last ``b`` words after every appended word; equality at a distance ``p`` is a square of period ``p`` in the
    making, extended to both sides and, while it touches the end, by every further word. Squares of one run extend to the
    same run and merge. The catchers of a level watch the distances from ``b`` to ``2 b - 1``, those of the lowest level also
    the shorter ones. A run of period ``p`` and ``max(least, periods p)`` words (``periods`` 3 or more) holds a whole block of
    its level and the copy of that block a period later, so none is missed; at any word a level has one or two catchers
    that can still catch. Words appended together are compared as arrays; how a text is cut into appends changes nothing.
    """

    def __init__(self, least: int = LEAST, periods: int = PERIODS):
        if periods < 3:
            raise ValueError("runs have at least three periods")
        self.least, self.periods = max(least, periods), periods
        self.lowest = 1 << ((self.least // 3).bit_length() - 1)
        self.n = 0
        self.words = np.empty(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.back = np.empty(0, np.uint64)
        self.open: list[tuple[int, int, int]] = []
        self.done: dict[tuple[int, int], int] = {}

    def _grow(self, new: np.ndarray) -> None:
        n, size = self.n, self.n + len(new)
        if size > len(self.words):
            room = size if not n else max(size, 2 * len(self.words))
            words, sums, back = np.empty(room, np.int64), np.zeros(room + 1, np.uint64), _powers(_INVERSE, room)
            words[:n], sums[: n + 1] = self.words[:n], self.sums[: n + 1]
            self.words, self.sums, self.back = words, sums, back
            self.forth = _powers(_BASE, room)
        self.words[n:size] = new
        self.sums[n + 1: size + 1] = self.sums[n] + np.cumsum(_scattered(new) * self.forth[n:size], dtype=np.uint64)
        self.n = size

    def _windows(self, start: np.ndarray | slice, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each start on."""
        if isinstance(start, slice):
            return (self.sums[start.start + size: start.stop + size] - self.sums[start]) * self.back[start]
        return (self.sums[start + size] - self.sums[start]) * self.back[start]

    def _right(self, end: int, period: int) -> int:
        """The end of the stretch before ``end`` when it goes on with its period."""
        step = 64
        while end < self.n:
            to = min(self.n, end + step)
            differ = np.nonzero(self.words[end:to] != self.words[end - period: to - period])[0]
            if len(differ):
                return end + int(differ[0])
            end, step = to, 2 * step
        return end

    def _left(self, start: int, period: int) -> int:
        step = 64
        while start > 0:
            to = max(0, start - step)
            differ = np.nonzero(self.words[to:start] != self.words[to + period: start + period])[0]
            if len(differ):
                return to + int(differ[-1]) + 1
            start, step = to, 2 * step
        return start

    def _settle(self, start: int, end: int, period: int) -> None:
        if end == self.n:
            self.open.append((start, end, period))
        elif end - start >= max(self.least, self.periods * period):
            self.done[start, end] = min(period, self.done.get((start, end), period))

    def append(self, words: np.ndarray) -> None:
        """Take further words (as numbers; equal words have equal numbers)."""
        if not len(words):
            return
        first = self.n
        self._grow(np.asarray(words, np.int64))
        waiting, self.open = self.open, []
        near: list[tuple[int, int, int]] = []
        for start, end, period in waiting:
            near.append((start, self._right(end, period), period))
            self._settle(*near[-1])
        size = self.lowest
        while 2 * size <= self.n:
            self._level(size, first, near)
            size *= 2

    def _level(self, size: int, first: int, near: list[tuple[int, int, int]]) -> None:
        """What the catchers of one level catch at the words from ``first`` on."""
        low, high = max(0, first - size + 1), self.n - size + 1
        at = np.arange(low, high)
        last = self._windows(slice(low, high), size)
        starts, blocks = [], []
        for back in (1, 0) if size == self.lowest else (1,):
            block = (at // size - back) * size
            usable = (block >= 0) & (block < at)
            lead = int(np.argmax(usable)) if usable.any() else len(at)
            keys = np.arange(block[lead] if lead < len(at) else 0, high, size)
            prints = self._windows(keys, size)
            hit = np.nonzero(usable[lead:] & (last[lead:] == prints[(block[lead:] - (keys[0] if len(keys) else 0)) // size]))[0] + lead
            starts.append(at[hit])
            blocks.append(block[hit])
        at, block = np.concatenate(starts), np.concatenate(blocks)
        if not len(at):
            return
        order = np.lexsort((at - block, at))
        at, block = at[order], block[order]
        left = np.ones(len(at), bool)

        def strike(start: int, end: int, period: int) -> None:
            """Squares inside a known run whose period is a multiple of the run's."""
            span = slice(int(np.searchsorted(at, start)), int(np.searchsorted(at, end - size, side="right")))
            left[span] &= (block[span] < start) | ((at[span] - block[span]) % period != 0)

        for run in near:
            strike(*run)
        for k in range(len(at)):
            if not left[k]:
                continue
            i, s = int(at[k]), int(block[k])
            period = i - s
            if not np.array_equal(self.words[s: s + size], self.words[i: i + size]):
                continue
            run = (self._left(s, period), self._right(i + size, period), period)
            near.append(run)
            self._settle(*run)
            strike(*run)

    def runs(self) -> list[tuple[int, int, int]]:
        """``start, length, period`` of every run so far, by start, then period.

        Two periods of one stretch of three of the longer one are multiples, so the smallest that was caught is the smallest.
        """
        found = dict(self.done)
        for start, end, period in self.open:
            if end - start >= max(self.least, self.periods * period):
                found[start, end] = min(period, found.get((start, end), period))
        return sorted(((start, end - start, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Runs of a whole sequence of word numbers."""
    catchers = Catchers(least, periods)
    for at in range(0, len(words), APPEND):
        catchers.append(words[at: at + APPEND])
    return catchers.runs()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: no run holds it after the run's first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return keep


Rewrite = Callable[[int | None, int], np.ndarray | None]


def _collapse(columns: list[str], text: str, doc_id: str, names: tuple[str, str, str], least: int, periods: int, rewrite: Rewrite | None):
    at, key = columns.index(text), columns.index(doc_id)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            split = [(t or "").encode().split() for t in batch.column(at).to_pylist()]
            ends = np.cumsum([len(w) for w in split])
            numbers = pc.dictionary_encode(pa.array(list(chain.from_iterable(split)), pa.binary())).indices.to_numpy().astype(np.int64)
            found, texts = [], []
            for doc, words, end in zip(batch.column(key).to_pylist(), split, ends.tolist(), strict=True):
                ids = numbers[end - len(words): end]
                order = rewrite(doc, len(words)) if rewrite else None
                if order is not None:
                    ids, words = ids[order], [words[i] for i in order.tolist()]
                runs = runs_of(ids, least, periods)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                if runs:
                    words = [words[i] for i in np.nonzero(kept_words(len(words), runs))[0].tolist()]
                texts.append(b" ".join(words).decode())
            yield pa.record_batch([*batch.columns, pa.array([len(w) for w in split], pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], names=[*columns, *names])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, periods: int = PERIODS, rewrite: Rewrite | None = None) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with all rows and columns, and the number of words, the runs and the text without repeats.

    The names of the three are returned (chosen so as not to clash): a long, an array of ``start, length, period`` by start,
    then period, and the words that no run holds after its first period, joined by blanks. Words lie between ASCII white
    space and are compared as they are. A run is a stretch with smallest period q and at least ``max(least, periods * q)`` words that no
    neighbouring word extends. NULL counts as empty: no words, no runs, an empty text. Rows that repeat an id are
    judged one by one; an empty table gives no rows. ``rewrite(doc_id, n)`` may give the word numbers to read instead of 0 to n - 1.

    A text is one sequence, so it is the work of one task: O(n log n) array steps for n words, in appends of ``APPEND`` words.
    """
    names = tuple(free_name(docs, n) for n in ("n_words", "runs", "collapsed"))
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], kind), T.StructField(names[2], T.StringType())])
    return docs.mapInArrow(_collapse(docs.columns, text, doc_id, names, least, periods, rewrite), schema), names


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's planted loops: every tenth document by CRC-32 of its id goes round a stretch of its words to its end."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def op11_runs(spark, sf_dir: str) -> DataFrame:
    found, (n_words, runs, collapsed) = periodic_runs(table_of(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=looped)
    first = F.expr(f"""array_sort({runs}, (l, r) -> case when l.length * r.period <> r.length * l.period then if(l.length * r.period > r.length * l.period, -1, 1)
        when l.start <> r.start then if(l.start < r.start, -1, 1) when l.period <> r.period then if(l.period < r.period, -1, 1) else 0 end)[0]""")
    listed = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.when(F.size(runs) > 0, first).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col(collapsed), 256).alias("collapsed_sha256"), F.col(n_words).alias("n_words"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
