"""Shards on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm.common import free_name, stored, table_of

#: Virtual nodes of a shard and rows of an ordering bucket on average.
NODES, BUCKET_ROWS = 128, 2048


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes clockwise, and their shards. A further shard adds nodes and moves none."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}:{v}") for s in range(shards) for v in range(nodes)], np.uint64)
    owner = np.repeat(np.arange(shards), nodes)
    order = np.argsort(at, kind="stable")
    return at[order], owner[order]


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    """Most rows of each shard: with no slack the rows shared out evenly, the first shards taking what is left over."""
    if slack:
        return np.full(shards, int(np.ceil((1 + slack) * rows / shards)), np.int64)
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def walk(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``arc, from, to, shard``: which rows of each arc, by rank, come to which shard.

    All rows step together. A row first asks the shard of the node that ends its arc; a shard with room takes the rows asking at the
    same step in the order of the ring, and within an arc by rank; the others go on to the next node clockwise. There is room for all, so
    it ends after one turn of the ring. Works on one number for each virtual node, however many rows there are.
    """
    waiting, begun, room, plan = counts.copy(), np.zeros(len(counts), np.int64), room.copy(), []
    arcs = np.arange(len(counts))
    for step in range(len(counts)):
        if not waiting.any():
            break
        asked = owner[(arcs + step) % len(counts)]
        for shard in np.unique(asked[waiting > 0]).tolist():
            mine = arcs[(asked == shard) & (waiting > 0)]
            taken = np.diff(np.minimum(np.concatenate([[0], np.cumsum(waiting[mine])]), room[shard]))
            room[shard] -= taken.sum()
            some = taken > 0
            plan += zip(mine[some].tolist(), begun[mine][some].tolist(), (begun[mine] + taken)[some].tolist(), [shard] * int(some.sum()), strict=True)
            begun[mine] += taken
            waiting[mine] -= taken
    return plan


def _arcs(positions: np.ndarray, names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            arc = np.searchsorted(positions, keys) % len(positions)
            yield pa.record_batch([*batch.columns, pa.array(arc.astype(np.int32))], names=names)

    return run


def ranked(rows: DataFrame, arc: str, hashed: str, row: str, total: int, nodes: int) -> tuple[DataFrame, str]:
    """``rows`` with their rank from 0 inside ``arc``, by ``hashed``, then ``row``; the rank's name is returned.

    Arcs are cut by the hash into buckets of about ``BUCKET_ROWS`` rows; a bucket that equal hashes make large is cut again by the
    row number. Ranks are running sums of bucket counts plus a row number inside a bucket.
    """
    bits = min(40, max(0, int(total // BUCKET_ROWS).bit_length()))
    bucket, piece, rank = (free_name(rows, n) for n in ("ring_bucket", "ring_piece", "ring_rank"))
    cut = rows.withColumn(bucket, F.shiftrightunsigned(F.col(hashed), 64 - bits) if bits else F.lit(0).cast("long"))
    large = cut.groupBy(F.col(arc).alias("x_arc"), F.col(bucket).alias("x_bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 16 * BUCKET_ROWS)
    large = stored(large.select("x_arc", "x_bucket", F.ceil(F.col("n") / BUCKET_ROWS).alias("pieces")), "large")  # empty unless a key repeats very often
    cut = cut.join(large, (F.col(arc) == F.col("x_arc")) & (F.col(bucket) == F.col("x_bucket")), "left")
    cut = cut.withColumn(piece, F.coalesce(F.pmod(F.xxhash64(row), F.col("pieces")), F.lit(0).cast("long"))).drop("x_arc", "x_bucket", "pieces")
    sums = cut.groupBy(F.col(arc).alias("s_arc"), F.col(bucket).alias("s_bucket"), F.col(piece).alias("s_piece")).agg(F.count(F.lit(1)).alias("n"))
    group = F.shiftright(F.col("s_bucket"), max(0, bits - nodes.bit_length() - 8))  # runs of buckets, so that no window holds all buckets of an arc at 2048 rows each
    sums = stored(sums.withColumn("s_group", group), "sums")
    whole = sums.groupBy("s_arc", "s_group").agg(F.sum("n").alias("total"))
    whole = whole.select("s_arc", "s_group", (F.sum("total").over(Window.partitionBy("s_arc").orderBy("s_group")) - F.col("total")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("s_arc", "s_group").orderBy("s_bucket", "s_piece")) - F.col("n")
    before = sums.withColumn("inside", inside).join(whole, ["s_arc", "s_group"]).select("s_arc", "s_bucket", "s_piece", (F.col("earlier") + F.col("inside")).alias("before"))
    placed = cut.withColumn(rank, F.row_number().over(Window.partitionBy(arc, bucket, piece).orderBy(hashed, row)) - 1)
    placed = placed.join(before, (F.col(arc) == F.col("s_arc")) & (F.col(bucket) == F.col("s_bucket")) & (F.col(piece) == F.col("s_piece")))
    return placed.withColumn(rank, F.col(rank) + F.col("before")).drop(bucket, piece, "s_arc", "s_bucket", "s_piece", "before"), rank


def sharded(keys: DataFrame, shards: int, key: str = "doc_id", slack: float = 0.0, nodes: int = NODES) -> tuple[DataFrame, tuple[str, str]]:
    """``keys`` with all rows and columns, and the shard (int) and the slot inside it (long, gapless from 0); their names are returned.

    A row's key hashes to a place on a ring of ``shards * nodes`` virtual nodes and goes clockwise to the first node whose
    shard is not full (:func:`walk`). No shard gets more than ``1 + slack`` times its even share; with no slack counts differ
    by one at most. A further shard moves only rows that its nodes take or that its relief lets stay nearer to their place. A NULL
    key has a place like any other; rows with equal keys are neighbours on the ring and may be parted at a full shard; an empty table gives no rows.

    Rows are numbered and stored first, so the narrower ``keys`` are, the better. The plan is made from one count for each virtual node.
    """
    spark = keys.sparkSession
    row, hashed, arc = (free_name(keys, n) for n in ("ring_row", "ring_hash", "ring_arc"))
    positions, owner = ring(shards, nodes)
    rows = keys.withColumns({row: F.monotonically_increasing_id(), hashed: F.xxhash64(F.col(f"`{key}`"))})
    rows = rows.mapInArrow(_arcs(positions, [*rows.columns, arc], len(rows.columns) - 1), T.StructType([*rows.schema.fields, T.StructField(arc, T.IntegerType())]))
    rows = stored(rows, "ring")
    counts = np.zeros(len(owner), np.int64)
    for r in rows.groupBy(arc).agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row for each virtual node
        counts[r[0]] = r[1]
    total = int(counts.sum())
    plan = walk(counts, owner, capacities(total, shards, slack))
    used, table = [0] * shards, []
    for a, low, high, shard in plan:
        table.append((a, low, high, shard, used[shard] - low))
        used[shard] += high - low
    plan_of = {}
    for a, *span in sorted(table):
        plan_of.setdefault(a, []).append(tuple(span))
    spans = spark.createDataFrame(list(plan_of.items()), "p_arc int, spans array<struct<low:long,high:long,shard:int,shift:long>>")
    placed, rank = ranked(rows, arc, hashed, row, total, shards * nodes)
    names = tuple(free_name(keys, n) for n in ("shard", "slot"))
    met = placed.join(F.broadcast(spans), F.col(arc) == F.col("p_arc"))  # bounded by the ring: a row for each virtual node
    met = met.withColumn("spans", F.filter("spans", lambda s: (s["low"] <= F.col(rank)) & (F.col(rank) < s["high"]))[0])
    return met.select(*[F.col(f"`{c}`") for c in keys.columns], F.col("spans.shard").alias(names[0]), (F.col("spans.shift") + F.col(rank)).alias(names[1])), names


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed, (shard, slot) = sharded(keys, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
