"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm.common import free_name, slices, stored, table_of
from insightspark.llm.graph import components

RADIUS = 4
#: Keys of one prefix bucket and rows of one task, on average, and variants expanded at once inside a bucket (8 bytes each).
BUCKET_KEYS = 8000
PART_ROWS = 1_000_000
VARIANTS = 1 << 20
_ROW = np.dtype([("bucket", "<u4"), ("key", "<u8"), ("node", "<i8")])


# ---- fingerprints ------------------------------------------------------------------------------------------------
def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole sequence if it is shorter; none for no words."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(words_of(text), size, seed))


# ---- variants ----------------------------------------------------------------------------------------------------
def flips(low: int, high: int, count: int) -> np.ndarray:
    """All masks with ``count`` of the bits ``low`` to ``high - 1``."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(low, high), count)], np.uint64)


def spread(base: np.ndarray, budget: np.ndarray, owner: np.ndarray, low: int, high: int, half: int):
    """Every variant on the bits ``low`` to ``high - 1`` within each row's budget of flips, with the budget left."""
    bases, budgets, owners = [], [], []
    for j in range(half + 1):
        rows = np.nonzero(budget >= j)[0]
        masks = flips(low, high, j)
        if len(rows) and len(masks):
            bases.append((base[rows, None] ^ masks[None, :]).ravel())
            budgets.append(np.repeat(budget[rows] - j, len(masks)))
            owners.append(np.repeat(owner[rows], len(masks)))
    return np.concatenate(bases), np.concatenate(budgets), np.concatenate(owners)


def collisions(base: np.ndarray, budget: np.ndarray, owner: np.ndarray, low: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(first owner, other owner)`` of the rows that share a variant, one for each further owner of it.

    Bits below ``low`` are settled. What would expand to too many variants is first dealt out by the next bits, the same
    way the shuffle deals by the first ones, so memory stays bounded whatever a bucket holds.
    """
    if len(base) < 2:
        return
    ways = np.array([sum(len(flips(low, 64, j)) for j in range(b + 1)) for b in range(half + 1)]) if low > 40 else np.array([1, 65 - low, 1 + (64 - low) * (65 - low) // 2])[: half + 1]
    if low < 56 and ways[budget].sum() > VARIANTS:
        step = 6
        at, left, who = spread(base, budget, owner, low, low + step, half)
        part = (at >> np.uint64(low)) & np.uint64((1 << step) - 1)
        for value in np.unique(part):
            rows = part == value
            yield from collisions(at[rows], left[rows], who[rows], low + step, half)
        return
    values, _, owners = spread(base, budget, owner, low, 64, half)
    ordered = np.sort(values)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return
    at = np.searchsorted(met, values)
    at[at == len(met)] = 0
    rows = np.nonzero(met[at] == values)[0]
    group, who = at[rows], owners[rows]
    order = np.lexsort((who, group))
    group, who = group[order], who[order]
    starts = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
    first = np.repeat(who[starts], np.diff(np.append(starts, len(who))))
    other = first != who
    yield first[other], who[other]


def _emit(bits: int, half: int, parts: int):
    """Send every key to each bucket (the low ``bits`` of a variant) that holds one of its variants.

    Variants that agree in these bits travel as one row and are expanded after the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate([flips(0, bits, j) for j in range(half + 1)])
        low = np.uint64((1 << bits) - 1)
        step = max(1, (1 << 20) // len(masks))
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1)
            tables = len(keys[0]) if len(keys) else 0
            flat = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, max(1, tables))
            for table in range(tables):
                for at in range(0, len(node), step):
                    key = flat[at: at + step, table]
                    rows = np.empty(len(key) * len(masks), _ROW)
                    rows["bucket"] = ((key[:, None] ^ masks[None, :]) & low).ravel()
                    rows["key"] = np.repeat(key, len(masks))
                    rows["node"] = np.repeat(node[at: at + step], len(masks))
                    target = (rows["bucket"].astype(np.int64) * 2654435761 + table * 40503) % (1 << 32) % parts
                    order = np.argsort(target, kind="stable")
                    rows, target = rows[order], target[order]
                    starts = np.nonzero(np.concatenate([[True], target[1:] != target[:-1]]))[0]
                    ends = np.append(starts[1:], len(target))
                    yield pa.record_batch({"part": pa.array(target[starts].astype(np.int32)), "hash_table": pa.array(np.full(len(starts), table, np.int32)),
                                           "rows": pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())})

    return run


class Forest:
    """Union-find over the nodes that a task has met in a link."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, node: int) -> int:
        up = self.up
        while (parent := up.setdefault(node, node)) != node:
            up[node] = up[parent]
            node = up[node]
        return node

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _collide(bits: int, half: int):
    """Expand the buckets of one task, find shared variants, verify the pairs, give a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            for table, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got.setdefault(table, []).append(rows)
        found: list[tuple[int, int, int]] = []
        low = np.uint64((1 << bits) - 1)
        ways = np.array([1, 65 - bits, 1 + (64 - bits) * (65 - bits) // 2])
        for table in sorted(got):
            rows = np.concatenate([np.frombuffer(r, _ROW) for r in got.pop(table)])
            rows = rows[np.argsort(rows["bucket"], kind="stable")]
            key, node, bucket = rows["key"], rows["node"], rows["bucket"].astype(np.uint64)
            base = (key & ~low) | bucket
            budget = half - np.bitwise_count(key ^ base).astype(np.int64)
            starts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
            upto = np.cumsum(np.add.reduceat(ways[budget], starts))
            links: list[tuple[int, int, int]] = []
            within = Forest()
            at = 0
            while at < len(starts):  # whole buckets, as many as fit
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + VARIANTS, side="right")))
                span = slice(starts[at], starts[to] if to < len(starts) else len(rows))
                index = np.arange(span.start, span.stop)
                for a, b in collisions(base[span], budget[span], index, bits, half):
                    far = np.bitwise_count(key[a] ^ key[b])
                    near = np.nonzero(far <= 2 * half)[0]
                    near = near[np.argsort(far[near], kind="stable")]
                    pairs = np.unique(np.stack([far[near].astype(np.int64), node[a][near], node[b][near]], 1), axis=0)
                    links += [(d, x, y) for d, x, y in pairs.tolist() if x != y and within.join(x, y)]
                at = to
            del rows, key, node, bucket, base, budget
            found += links
        forest = Forest()  # over all tables of the task, nearest pairs first
        links = [(x, y) for _, x, y in sorted(found) if forest.join(x, y)]
        if links:
            yield pa.record_batch({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def ball_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between the rows of ``nodes(node long, keys array<long>)`` with a key within ``radius`` bits in the same place.

    Two keys at most ``radius`` bits apart share a variant at most half of that from either. Every key emits its variants;
    equal variants meet after the shuffle and the pairs are verified. Of the links of one task a spanning forest is
    given (nearest pairs first), which has the same components as all of them. ``radius`` is 2 or 4.
    """
    spark = nodes.sparkSession
    half = radius // 2
    count = nodes.agg(F.count(F.lit(1)), F.max(F.size("keys"))).first()
    n, tables = count[0], count[1] or 1
    bits = min(24, max(4, int(n // BUCKET_KEYS).bit_length()))
    copies = 1 + bits + bits * (bits - 1) // 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * copies * tables // PART_ROWS)
    rows = nodes.select(F.col("node").cast("long"), "keys").mapInArrow(_emit(bits, half, parts), "part int, hash_table int, rows binary")
    return rows.repartition(parts, "part").mapInArrow(_collide(bits, half), "a long, b long")


# ---- documents -----------------------------------------------------------------------------------------------------
def _marked(columns: list[str], text: str, name: str, size: int, seed: int):
    """The rows with a fingerprint (as a signed long) beside them."""
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            prints = np.fromiter((fingerprint(t or "", size, seed) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([*batch.columns, pa.array(prints.view(np.int64))], names=[*columns, name])

    return run


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 4, seed: int = 42) -> tuple[DataFrame, str]:
    """``docs`` with all rows and columns and the fingerprint of each text, whose name is returned. NULL is the empty text."""
    name = free_name(docs, "fp")
    return docs.mapInArrow(_marked(docs.columns, text, name, size, seed), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])), name


def fingerprint_groups(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root`` for every row of ``nodes(fp)``: equal for fingerprints joined by links of ``radius`` bits or fewer."""
    links = ball_links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("keys")), radius)
    roots = components(links).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: fingerprint (signed long) and the smallest ``doc_id`` linked to it.

    Equal fingerprints are one node, so a group of copies costs one node. NULL text is the empty text; texts without
    words have fingerprint zero and are linked like any other. Rows that repeat a ``doc_id`` each get a row; NULL ids
    never name a component (a component of NULL ids only has NULL). Empty table: no rows.
    """
    prints, name = with_fingerprints(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", size, seed)
    prints = stored(prints.select("doc_id", F.col(name).alias("fp")), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    placed = nodes.join(fingerprint_groups(nodes.select("fp"), radius), "fp")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(placed.join(lows, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """Of each group of :func:`simhash_groups` the document with the smallest ``doc_id``, with exactly the columns of ``docs``.

    A row goes if its group has a smaller id than its own: rows without an id stay, rows that share an id and a group
    count as one document. The rows are stored with their fingerprints once; which go is decided on narrow rows only.
    """
    marked, fp = with_fingerprints(docs, text, size, seed)
    marked = stored(marked, "marked")
    prints = marked.select(F.col(fp).alias("fp"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    placed = nodes.join(fingerprint_groups(nodes.select("fp"), radius), "fp")
    lows = placed.groupBy("root").agg(F.min("low").alias("first"))
    named = stored(placed.join(lows, "root").select("fp", "first"), "named")
    gone = stored(prints.join(named, "fp").where("id <> first").select("fp", "id").distinct(), "gone")
    gone = gone.toDF(*(names := [free_name(marked, "gone_fp"), free_name(marked, "gone_id")]))
    return marked.join(gone, (F.col(fp) == F.col(names[0])) & (F.col(f"`{doc_id}`") == F.col(names[1])), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table_of(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
