"""Mixing sources to target weights by a Pfair schedule of blocks."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insightspark.llm.common import free_name, table_of

#: Documents of a block, slots of a period (weights are multiples of one over this), rows of an ordering bucket on average.
BLOCK, PERIOD, BUCKET_ROWS = 64, 1024, 2048
#: Slots for each source where there are more sources than ``PERIOD``.
SLOTS_EACH = 4
#: Without given targets a source's weight is its number of rows to this power.
TEMPER = 0.7


def running_before(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``df`` and ``before``: the sum of ``value`` over smaller ``order`` (integers from 0) of the same keys.

    Runs of 1,024 are summed first, so no window holds more than a thousandth of a key's rows.
    """
    chunked = df.withColumn("chunk", F.floor(F.col(order) / 1024))
    sums = chunked.groupBy(*keys, "chunk").agg(F.sum(value).alias("total"))
    earlier = sums.select(*keys, "chunk", (F.sum("total").over(Window.partitionBy(*keys).orderBy("chunk")) - F.col("total")).alias("earlier"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l.chunk") == F.col("r.chunk")]
    met = chunked.alias("l").join(earlier.alias("r"), same)
    inside = F.sum(f"l.{value}").over(Window.partitionBy(*[f"l.{k}" for k in keys], "l.chunk").orderBy(f"l.{order}"))
    return met.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("r.earlier") + inside - F.col(f"l.{value}")).alias("before"))


def shares(sizes: DataFrame, targets: dict[str | None, float] | None, period: int, temper: float) -> DataFrame:
    """``slots`` of each source in a period: one, and the rest by weight with largest remainders, ``period`` in all."""
    if targets is None:
        weight: Column = F.pow(F.col("n"), F.lit(temper))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    every = Window.partitionBy(F.lit(0))  # one row for each source, at most ``period``
    wanted = sizes.withColumn("w", weight).withColumn("spare", F.lit(period) - F.count(F.lit(1)).over(every)).withColumn("part", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(every)), F.lit(0.0)) * F.col("spare"))
    whole = wanted.withColumn("slots", F.lit(1) + F.floor("part"))
    left = F.lit(period) - F.sum("slots").over(every)
    place = F.row_number().over(every.orderBy((F.col("part") - F.floor("part")).desc(), "source"))
    return whole.withColumn("left", left).withColumn("place", place).select("source", "n", (F.col("slots") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("int").alias("slots"))


def timetable(shared: DataFrame, period: int) -> DataFrame:
    """One row for each slot of a period: ``source, turn, slot`` and, by source, ``ahead`` (blocks scheduled before), ``slots, n``.

    Block i of a source with a of T slots is released at floor(i T / a) and due at ceil((i + 1) T / a); in every slot the
    released block with the earliest deadline is taken. The slots of all sources sum to T, so every deadline is met and
    no source is ever a whole block away from its weight. The period repeats, so the timetable never grows with the data.
    """
    row = shared.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("k"), "source", "n", "slots"))).alias("s")).where("size(s) > 0")
    row = row.select(F.expr("transform(s, x -> x.source)").alias("names"), F.expr("transform(s, x -> x.n)").alias("n"), F.expr("transform(s, x -> x.slots)").alias("slots"))
    due = f"((acc.done[i] + 1) * {period} + slots[i] - 1) div slots[i]"
    free = f"filter(sequence(0, size(slots) - 1), i -> (acc.done[i] * {period}) div slots[i] <= t)"
    pick = f"array_min(transform({free}, i -> struct({due} as due, i as i))).i"
    step = f"transform(array({pick}), p -> named_struct('done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)), 'plan', array_append(acc.plan, named_struct('p', p, 'ahead', acc.done))))[0]"
    start = "named_struct('done', transform(slots, x -> 0L), 'plan', cast(array() as array<struct<p:int,ahead:array<bigint>>>))"
    plan = row.select("names", "n", "slots", F.expr(f"aggregate(sequence(0, {period - 1}), {start}, (acc, t) -> {step}).plan").alias("plan"))
    return plan.select("names", "n", "slots", F.posexplode("plan").alias("slot", "x")).select(
        F.expr("names[x.p]").alias("source"), F.expr("x.ahead[x.p]").alias("turn"), F.col("slot").cast("long").alias("slot"), F.col("x.ahead").alias("ahead"), "slots", "n", F.expr("slots[x.p]").alias("own"))


def many_turns(shared: list[tuple[str | None, int]], period: int) -> list[tuple[int, int]]:
    """``(place in shared, turn)`` of each slot: the choice of :func:`timetable` by two heaps, for any number of sources."""
    order = sorted(range(len(shared)), key=lambda i: ((shared[i][0] or "").encode(), shared[i][0] is not None))
    slots = [shared[i][1] for i in order]
    done, plan, waiting, due = [0] * len(order), [], [(0, k) for k in range(len(order))], []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(due, (((done[k] + 1) * period + slots[k] - 1) // slots[k], k))
        k = heapq.heappop(due)[1]
        plan.append((order[k], done[k]))
        done[k] += 1
        heapq.heappush(waiting, (done[k] * period // slots[k], k))
    return plan


def many_blocks(shared: DataFrame, period: int, block: int) -> DataFrame:
    """``t_source, t_block, t_own, t_slot, before`` of every block: its slot and the rows in earlier slots, as running sums."""
    rows = [(r.source, r.slots) for r in shared.select("source", "slots").collect()]  # one row for each source
    plan = many_turns(rows, period)
    table = shared.sparkSession.createDataFrame(pa.table({
        "p_source": pa.array([rows[i][0] for i, _ in plan], pa.string()), "turn": pa.array([turn for _, turn in plan], pa.int64()), "at": pa.array(range(period), pa.int64())}))
    blocks = shared.select("source", "n", F.col("slots").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))).alias("block"))
    blocks = blocks.join(table, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") % F.col("own") == F.col("turn")))
    blocks = blocks.select("source", "block", "own", (F.floor(F.col("block") / F.col("own")) * period + F.col("at")).alias("slot"), F.least(F.lit(block).cast("long"), F.col("n") - F.col("block") * block).alias("size"))
    return running_before(blocks, [], "slot", "size").select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), F.col("own").alias("t_own"), F.col("slot").alias("t_slot"), F.col("before").alias("t_before"))


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", targets: dict[str | None, float] | None = None, block: int = BLOCK, period: int | None = None, temper: float = TEMPER) -> tuple[DataFrame, str]:
    """``docs`` with all rows and columns and a struct of its place in the mix; the struct's name is returned.

    The struct holds ``weight, rank, block, slot, position``. Inside a source documents are ordered by the MD5 of their
    id (a fixed shuffle; NULL ids last; rows that tie follow in any order) and cut into blocks of ``block``; the blocks go
    to the slots of the Pfair timetable. ``position`` numbers all rows from 0 in slot order. While every source has blocks
    left, each has less than one block more or less than its weight asks for; a source that has run out gives up its
    slots and the others go on, so every row has exactly one place. NULL is a source of its own; an empty table gives no
    rows. A period has ``PERIOD`` slots, with more sources than that ``SLOTS_EACH`` for each; a ``period`` that is given has to
    hold all sources.

    Ranks come from counts of (source, bucket of the hash) and a row number inside a bucket, so a source with a third of
    all rows is spread over as many tasks as it has buckets.
    """
    added = {n: free_name(docs, n) for n in ("mix_source", "mix_hash", "mix_bucket", "mix_rank", "mix_block", "mix")}
    src, digest, bucket, rank, blk, out = added.values()
    sizes = docs.groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    sizes_at = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = period is None and sizes_at[0] > PERIOD
    period = (SLOTS_EACH * sizes_at[0] if many else PERIOD) if period is None else period
    if sizes_at[0] > period:
        raise ValueError(f"{sizes_at[0]} sources, but a period has {period} slots")
    bits = min(28, int(sizes_at[1] // BUCKET_ROWS).bit_length())
    key = F.md5(F.col(f"`{doc_id}`").cast("string"))
    of_hash = F.coalesce(F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits), F.lit((1 << bits) - 1).cast("long"))
    counts = docs.groupBy(F.col(f"`{source}`").cast("string").alias("source"), of_hash.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = running_before(counts, ["source"], "bucket", "n").select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.col("before").alias("b_before"))
    tagged = docs.withColumns({src: F.col(f"`{source}`").cast("string"), digest: key, bucket: of_hash})
    ranked = tagged.withColumn(rank, F.row_number().over(Window.partitionBy(src, bucket).orderBy(F.col(digest).asc_nulls_last(), F.col(f"`{doc_id}`"))))
    ranked = ranked.join(before, F.col(src).eqNullSafe(F.col("b_source")) & (F.col(bucket) == F.col("b_bucket"))).withColumn(rank, F.col("b_before") + F.col(rank) - 1).withColumn(blk, F.floor(F.col(rank) / block))
    if many:
        blocks = many_blocks(shares(sizes, targets, period, temper), period, block)
        placed = ranked.join(blocks, F.col(src).eqNullSafe(F.col("t_source")) & (F.col(blk) == F.col("t_block")))
        struct = F.struct((F.col("t_own") / period).alias("weight"), F.col(rank).alias("rank"), F.col(blk).alias("block"), F.col("t_slot").alias("slot"), (F.col("t_before") + F.col(rank) % block).alias("position"))
        return placed.select(*[F.col(f"`{c}`") for c in docs.columns], struct.alias(out)), out
    table = timetable(shares(sizes, targets, period, temper), period).select(*[F.col(c).alias(f"t_{c}") for c in ("source", "turn", "slot", "ahead", "slots", "n", "own")])
    own = shares(sizes, targets, period, temper).select(F.col("source").alias("s_source"), F.col("slots").alias("s_slots"))
    placed = ranked.join(F.broadcast(own), F.col(src).eqNullSafe(F.col("s_source")))  # one row for each source, at most ``period``
    placed = placed.join(F.broadcast(table), F.col(src).eqNullSafe(F.col("t_source")) & (F.col(blk) % F.col("s_slots") == F.col("t_turn")))  # ``period`` rows
    turn = F.floor(F.col(blk) / F.col("t_own"))
    filled = F.expr(f"aggregate(sequence(0, size(t_n) - 1), 0L, (acc, i) -> acc + least(t_n[i], {block} * (floor(`{blk}` / t_own) * t_slots[i] + t_ahead[i])))")
    struct = F.struct((F.col("t_own") / period).alias("weight"), F.col(rank).alias("rank"), F.col(blk).alias("block"), (turn * period + F.col("t_slot")).alias("slot"), (filled + F.col(rank) % block).alias("position"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], struct.alias(out)), out


def stretch(position: Column, rows: int, parts: int) -> Column:
    """Which of ``parts`` equal stretches a place among ``rows``, numbered from 0, lies in."""
    return F.floor(position * F.lit(parts) / F.lit(max(1, rows))).cast("int")


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with exactly its columns, laid out in the order of the mix: stretches of positions, sorted inside.

    Positions are numbers from 0 without gaps, so a row's stretch is known from its own: no range has to be sampled.
    """
    placed, name = mixed(docs, **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(parts, stretch(F.col(f"{name}.position"), docs.count(), parts)).sortWithinPartitions(F.col(f"{name}.position")).drop(name)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs, name = mixed(table_of(spark, sf_dir, "documents").select("doc_id", "source"))
    return docs.select("doc_id", "source", f"{name}.*")


SQL = f"""
with recursive sizes as (select source, count(*) as n from documents group by 1),
weighed as (select source, n, pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) over () * ({PERIOD} - count(*) over ()) as part from sizes),
whole as (select *, 1 + floor(part) as base, row_number() over (order by part - floor(part) desc, source) as place from weighed),
shared as (select source, n, cast(base + case when place <= {PERIOD} - sum(base) over () then 1 else 0 end as bigint) as slots from whole),
lists as (select list(slots order by source) as slots, list(source order by source) as names from shared),
steps as (
  select 0 as t, list_transform(slots, lambda x: cast(0 as bigint)) as done, cast(null as bigint) as pick from lists
  union all
  select t + 1, list_transform(done, lambda d, i: d + case when i = p then 1 else 0 end), p
  from (select t, done, list_sort(list_transform(list_filter(range(1, len(slots) + 1), lambda i: done[i] * {PERIOD} // slots[i] <= t),
                                                 lambda i: {{'due': ((done[i] + 1) * {PERIOD} + slots[i] - 1) // slots[i], 'i': i}}))[1].i as p
        from steps, lists where t < {PERIOD})),
slots as (select names[pick] as source, t - 1 as slot, row_number() over (partition by pick order by t) - 1 as turn from steps, lists where pick is not null),
ranked as (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as rank from documents),
placed as (select r.doc_id, r.source, h.slots / {PERIOD} as weight, r.rank, r.rank // {BLOCK} as block, (r.rank // {BLOCK}) // h.slots * {PERIOD} + s.slot as slot
           from ranked r join shared h on r.source is not distinct from h.source
           join slots s on s.source is not distinct from r.source and s.turn = (r.rank // {BLOCK}) % h.slots)
select *, row_number() over (order by slot, rank) - 1 as position from placed
"""
