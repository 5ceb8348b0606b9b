"""How far sources stray from each other and from their language, from term counts by sorted word pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insightspark.llm.common import slices, stored, table_of

#: Documents of a language that a kept term occurs in, terms listed for a group, and bytes of text sorted at once.
LEAST_DOCS, TOP, SORT_BYTES = 10, 10, 4 << 20
#: Shares are counted in parts of this.
UNIT = 1_000_000_000
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


# ---- pointers ----------------------------------------------------------------------------------------------------
def is_letter(data: np.ndarray) -> np.ndarray:
    """Bytes of terms: A-Z, a-z and all bytes of characters beyond ASCII."""
    folded = data | 0x20
    return (data >= 0x80) | ((folded >= ord("a")) & (folded <= ord("z")))


def pointers(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms of a text buffer; no term runs over a ``cut`` between two texts."""
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = is_letter(data)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    ends = ~letter
    ends[0] = False
    ends[1:] &= letter[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    inner = inner[letter[inner] & letter[inner - 1]]
    begins[inner] = ends[inner] = True
    starts = np.nonzero(begins)[0]
    return starts, np.nonzero(ends)[0] - starts


def _keys(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each term from ``depth`` on as one number that sorts like them; ended terms give zeros, which no term holds."""
    chunk = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts + depth].view(">u8").reshape(-1).astype(np.uint64)
    left = np.clip(lengths - depth, 0, 8).astype(np.uint64)
    return np.where(left > 0, chunk >> ((np.uint64(8) - np.maximum(left, np.uint64(1))) * np.uint64(8)) << ((np.uint64(8) - np.maximum(left, np.uint64(1))) * np.uint64(8)), np.uint64(0))


def sort_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of term pointers: their order by the bytes they point to, and the number of each one's equal run.

    A slice is sorted by the eight bytes at its depth and falls into runs of equal bytes; only runs with terms that go on are
    slices of the next depth. Slices of one depth are sorted together, each by its own number first. Pointers to equal terms keep their order.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order = np.argsort(_keys(padded, starts, lengths, 0), kind="stable")
    first = np.ones(len(starts), bool)
    keys = _keys(padded, starts[order], lengths[order], 0)
    first[1:] = keys[1:] != keys[:-1]
    depth, todo = 8, np.arange(len(starts))
    while True:
        run = np.cumsum(first) - 1
        longer = lengths[order[todo]] > depth
        live = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
        live[run[todo[longer]]] = True
        size = np.bincount(run, minlength=len(live))
        todo = todo[live[run[todo]] & (size[run[todo]] > 1)]
        if not len(todo):
            return order, run
        keys, group = _keys(padded, starts[order[todo]], lengths[order[todo]], depth), run[todo]
        turned = np.lexsort((keys, group))
        order[todo] = order[todo[turned]]
        keys = keys[turned]
        new = np.ones(len(todo), bool)
        new[1:] = (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])
        first[todo] |= new
        depth += 8


def _taken(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The stretches of a buffer as strings."""
    ends = np.cumsum(lengths)
    body = data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes()))


def count_terms(data: np.ndarray, cuts: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``term, group, n, docs`` of a lower-cased buffer: texts lie between ``cuts`` and belong to the numbered groups."""
    starts, lengths = pointers(data, cuts)
    order, run = sort_pointers(data, starts, lengths)
    doc = np.searchsorted(cuts, starts, side="right") - 1
    groups = int(group.max()) + 1 if len(group) else 1
    doc = doc[order]
    pair = run * groups + group[doc]
    again = np.zeros(len(order), bool)
    again[1:] = (run[1:] == run[:-1]) & (doc[1:] == doc[:-1])  # pointers of a run are in the order of the texts
    found, at, n = np.unique(pair, return_index=True, return_counts=True)
    docs = np.bincount(np.searchsorted(found, pair[~again]), minlength=len(found))
    word = order[at]
    return _taken(data, starts[word], lengths[word]), found % groups, n, docs


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as they lie in its Arrow buffer, lower-cased, and where texts are cut. NULL is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]: offsets[-1]] if body is not None else np.empty(0, np.uint8)
    upper = (data >= ord("A")) & (data <= ord("Z"))
    return data + (upper.view(np.uint8) << 5), offsets - offsets[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, SORT_BYTES):
        names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"]).to_pylist()
        known: dict[tuple[str, str], int] = {}
        group = np.array([known.setdefault((r["lang"], r["source"]), len(known)) for r in names], np.int64)
        data, cuts = _texts(batch.column(2))
        if batch.num_rows == 1 and len(data) > SORT_BYTES:  # a very long text goes in pieces, which are one document
            yield from _long(data, names[0])
            continue
        term, at, n, docs = count_terms(data, cuts, group)
        pairs = list(known)
        lang, source = pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())
        yield pa.record_batch([lang.take(pa.array(at)), source.take(pa.array(at)), term, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], schema=_COUNTS)


def _long(data: np.ndarray, name: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Counts of one text, piece by piece; pieces end between terms."""
    kept, at = [], 0
    while at < len(data):
        to = min(len(data), at + SORT_BYTES)
        while to < len(data) and is_letter(data[to: to + 1])[0]:
            to += 1
        piece = data[at:to]
        term, _, n, _ = count_terms(piece, np.array([0, len(piece)]), np.zeros(1, np.int64))
        kept.append(pa.table({"term": term, "n": pa.array(n.astype(np.int64))}))
        if len(kept) > 8:
            kept = [pa.concat_tables(kept).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])]
        at = to
    whole = pa.concat_tables(kept).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"]).combine_chunks()
    for batch in whole.to_batches():
        size = batch.num_rows
        yield pa.record_batch([pa.array([name["lang"]] * size, pa.string()), pa.array([name["source"]] * size, pa.string()), batch.column(0), batch.column(1), pa.array(np.ones(size, np.int64))], schema=_COUNTS)


# ---- tables --------------------------------------------------------------------------------------------------------
def _named(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in each group and the rows that hold it.

    Terms are runs of letters of ASCII, A-Z lower-cased, and of all characters beyond ASCII. NULL text, language and source
    are ''. Every task sorts pointers into its own text buffers and gives one row for a run; equal rows are added before and after the shuffle.
    """
    rows = docs.select(_named(lang).alias("lang"), _named(source).alias("source"), _named(text).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT (count + 2) / (total + 2 terms))``, exact for any long counts."""
    up = (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    down = total.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    return F.call_function("div", up, down) + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; shares are at most ``UNIT`` + 1, so it stays exact in longs."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, n`` (of the whole language) ``, cells``: its sources with their counts, for terms in ``least_docs`` rows of a language.

    A row's array is as long as the term's sources are many.
    """
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return by_term.where(F.col("docs") >= least_docs).select("lang", "term", "n", "cells")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``docs``: how far it is from each other source of its language
    (part ``pair``, all ranks) and the terms that it uses more than its language does (part ``term``, ranks to ``top``).

    Shares are counts plus two over their sum, in billionths, of the terms in ``least_docs`` rows of the language or more; a distance is the sum of
    ``floor((p - q)^2 / (p + q))`` over all of these, also those that neither source uses. All figures are exact. NULL text, language
    and source are ''; an empty table gives no rows; a language without kept terms has distances of 0 and no terms.

    For a term that two sources lack, the summand depends on their totals only: it is taken for all terms at once, and each
    source's terms add their difference from it. So the work follows the counts that occur, times the sources of a language (the result itself has a row
    for each pair of sources). Sums over terms are made before the shuffle, by pair.
    """
    counts = term_counts(docs, text, lang, source)
    kept = stored(kept_counts(counts, least_docs), "terms")
    groups = docs.select(_named(lang).alias("lang"), _named(source).alias("source")).distinct()
    cells = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("cells").alias("c")).select("lang", "term", "n_lang", "c.source", "c.n")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total_lang"))
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"), F.coalesce("total_lang", zero).alias("total_lang"))
    groups = stored(groups.withColumn("none", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms")))), "groups")

    sources = groups.where("terms > 0").groupBy("lang").agg(F.first("terms").alias("terms"), F.collect_list(F.struct("source", "total", "none")).alias("all"))
    spread = kept.join(sources, "lang").withColumn("have", F.map_from_arrays(F.col("cells.source"), F.col("cells.n")))
    spread = spread.withColumn("all", F.transform("all", lambda s: F.struct(
        s["source"].alias("source"), s["none"].alias("none"), F.map_contains_key("have", s["source"]).alias("has"),
        F.when(F.map_contains_key("have", s["source"]), share(F.element_at("have", s["source"]), s["total"], F.col("terms"))).otherwise(s["none"]).alias("p"))))
    pairs = spread.select("lang", "all", F.explode(F.filter("all", lambda s: s["has"])).alias("x"))
    # of two sources that both have the term the smaller name counts it; of one that has it and one that lacks it the former
    pairs = pairs.select("lang", "x", F.explode(F.filter("all", lambda s: (s["source"] != F.col("x.source")) & (~s["has"] | (s["source"] > F.col("x.source"))))).alias("y"))
    extra = gap(F.col("x.p"), F.col("y.p")) - gap(F.col("x.none"), F.col("y.none"))
    extras = pairs.select("lang", F.least("x.source", "y.source").alias("a"), F.greatest("x.source", "y.source").alias("b"), extra.alias("extra")).groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))
    one, two = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("a_none"), "terms"), groups.select("lang", F.col("source").alias("b"), F.col("none").alias("b_none"))
    both = one.join(two, "lang").where("a < b").join(extras, ["lang", "a", "b"], "left")
    both = both.select("lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("a_none"), F.col("b_none")) + F.coalesce("extra", zero)).otherwise(zero).alias("value"))
    pair = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(ranks))

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    term = cells.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term = term.select("lang", "source", "part", "item", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
    return pair.unionByName(term)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table_of(spark, sf_dir, "documents"))


SQL = r"""
with words as (select doc_id, row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
terms as (select r, lang, source, unnest(w) as term from words),
kept as (select lang, term from terms group by 1, 2 having count(distinct r) >= 10),
cells as (select lang, source, term, count(*) as n from terms join kept using (lang, term) group by 1, 2, 3),
sizes as (select lang, count(*) as v from kept group by 1),
groups as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from (select distinct lang, source from words) g left join cells c using (lang, source) group by 1, 2),
shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * s.v) as p
           from groups g join kept k using (lang) join sizes s using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
langs as (select lang, term, sum(n)::hugeint as n from cells group by 1, 2),
means as (select l.lang, l.term, 1 + 1000000000::hugeint * (l.n + 2) // (t.total + 2 * s.v) as q from langs l join sizes s using (lang) join (select lang, sum(n)::hugeint as total from cells group by 1) t using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
single as (select s.lang, s.source, s.term as item, ((p - q) * (p - q) // (p + q))::bigint as value from shares s join means m using (lang, term) where s.n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
           union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from single)
select * from ranked where part = 'pair' or rank <= 10
"""
