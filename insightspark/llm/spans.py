"""Positions of regular-expression matches with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import free_name

#: Matches whose positions are summed in one go; longer lists are summed run by run, which keeps the copying linear.
RUN = 256


def with_matches(df: DataFrame, text: str, pattern: str, out: str, guard: Column) -> DataFrame:
    """Add ``out``: array of ``start, end, found, before, after`` for the leftmost non-overlapping matches, in order.

    Positions are code points, ends exclusive; ``before`` and ``after`` are the last and first 64 characters beside a
    match, up to the next match. Matches and the text between them come from the same expression, so a match starts where
    the lengths before it add up to. Where ``guard`` is false the array is empty and the text is not searched.
    """
    found, gaps, sizes = (free_name(df, f"{out}_{n}") for n in ("found", "gaps", "sizes"))
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern)).otherwise(none))
    df = df.withColumn(sizes, F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), lambda m, g: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"))))
    run, lists = "array<struct<start:bigint,end:bigint>>", free_name(df, f"{out}_lists")
    # every run is summed once, then the runs' sums, so a position costs two additions however long the text is
    df = df.withColumn(lists, F.expr(f"""transform(if(size(`{sizes}`) > 0, sequence(0, (size(`{sizes}`) - 1) div {RUN}), cast(array() as array<int>)), c -> slice(`{sizes}`, c * {RUN} + 1, {RUN}))"""))
    sums = f"transform(`{lists}`, l -> aggregate(l, 0L, (acc, x) -> acc + x.g + x.m))"
    chunked = f"""transform(if(size(`{lists}`) > 0, sequence(0, (size(`{lists}`) - 1) div {RUN}), cast(array() as array<int>)), c -> slice({sums}, c * {RUN} + 1, {RUN}))"""
    before = free_name(df, f"{out}_before")
    df = df.withColumn(before, F.expr(chunked))
    df = df.withColumn(before, F.expr(f"""flatten(aggregate(`{before}`, named_struct('at', 0L, 'o', cast(array() as array<array<bigint>>)),
        (acc, c) -> named_struct('at', acc.at + aggregate(c, 0L, (a, x) -> a + x),
                                 'o', array_append(acc.o, aggregate(c, named_struct('at', acc.at, 'o', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + x, 'o', array_append(a.o, a.at)), a -> a.o))),
        acc -> acc.o))"""))
    starts = F.expr(f"""flatten(zip_with(`{lists}`, `{before}`, (l, b) ->
        aggregate(l, named_struct('at', b, 'o', cast(array() as {run})),
                  (acc, x) -> named_struct('at', acc.at + x.g + x.m, 'o', array_append(acc.o, named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.m))),
                  acc -> acc.o)))""")
    df = df.withColumn(sizes, starts)
    made = F.transform(F.col(sizes), lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.get(F.col(found), i).alias("found"), F.right(F.get(F.col(gaps), i), F.lit(64)).alias("before"), F.left(F.get(F.col(gaps), i + 1), F.lit(64)).alias("after")))
    return df.withColumn(out, made).drop(found, gaps, sizes, lists, before)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of an array of structs in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
