"""Personal data by bootstrapped contextual extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import stored, table_of, text_of
from insightspark.llm.spans import listed, with_matches

#: Base kinds in their order. Possessive repeats and the look-behinds (or ``\G``, the end of the last match) find the same
#: leftmost matches as the plain expressions, but in linear time and without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes of the same kinds, taken only in contexts learnt from the base matches.
LOOSE = {
    "email": r"(?i)\b[a-z0-9][a-z0-9._%+-]*+\x20?[\[(](?:at|@)[\])]\x20?[a-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[a-z0-9-]++)++",
    "ip": r"(?i)\b[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){7}\b",
    "phone": r"(?<![+0-9.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-]?[0-9])",
}
#: States of an instance.
REFUTED, OPEN, KNOWN = 0, 1, 2
#: Rounds of scoring at most; a pattern is trusted from this score and this number of different seeds on; seeds that a pattern
#: needs where it only confirms an instance believed already.
ROUNDS, TRUST, SUPPORT, CONFIRM = 4, 0.8, 5, 2


def _guard(text: Column, kind: str, loose: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")) if loose else F.contains(text, F.lit("@"))
    if kind == "ip":
        return F.contains(text, F.lit(":")) if loose else text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9][\x20-]?[0-9]")
    return text.rlike("[0-9]{3}") if loose else F.contains(text, F.lit("+"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    """From the right, every second digit doubled (9 taken off if over 9), the sum divisible by ten."""
    digits = F.transform(F.split(F.reverse(_digits(found)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    size = F.length(_digits(found))
    return size.between(13, 19) & F.when(size.between(13, 19), _luhn(found)).otherwise(F.lit(False)) if kind == "card" else size.between(9, 15)


def _words(kind: str, s: Column) -> Column:
    """Lexical patterns around a span: the word before, the two before, and the words on both sides. NULL where a word is missing."""
    two = F.lower(s["before"])
    last = F.nullif(F.regexp_extract(two, r"(\p{L}[\p{L}'-]*)[^\p{L}\n]*$", 1), F.lit(""))
    pair = F.nullif(F.regexp_extract(two, r"(\p{L}[\p{L}'-]*[^\p{L}\n]+\p{L}[\p{L}'-]*)[^\p{L}\n]*$", 1), F.lit(""))
    first = F.nullif(F.regexp_extract(F.lower(s["after"]), r"^[^\p{L}\n]*(\p{L}[\p{L}'-]*)", 1), F.lit(""))
    made = [F.concat(F.lit(f"{kind}<"), last), F.concat(F.lit(f"{kind}<<"), F.regexp_replace(pair, r"[^\p{L}'-]+", " ")), F.concat(F.lit(f"{kind}<>"), last, F.lit("|"), first)]
    return F.filter(F.array(*made), lambda p: p.isNotNull())


def base_and_loose(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One narrow row per row of ``docs``: ``row, doc_id, base`` (kept base spans) and ``seen`` (spans with their patterns).

    ``seen`` holds the base spans as known instances, base matches that fail their check as refuted ones (they speak against a
    context), and as open ones the loose matches that overlap no base span.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    for kind, pattern in BASE.items():
        rows = with_matches(rows, "text", pattern, f"b_{kind}", _guard(F.col("text"), kind, False))
        rows = rows.withColumn(f"b_{kind}", F.transform(f"b_{kind}", _checked(kind)))
    for kind, pattern in LOOSE.items():
        rows = with_matches(rows, "text", pattern, f"l_{kind}", _guard(F.col("text"), kind, True))
    kept = [F.transform(F.filter(f"b_{kind}", lambda m: m["valid"]), _ranked(rank, kind)) for rank, kind in enumerate(BASE)]
    rows = rows.drop("text").withColumn("base", F.concat(*kept))
    seen = []
    for rank, kind in enumerate(BASE):
        seen.append(F.transform(f"b_{kind}", _instance(rank, kind)))
        if kind in LOOSE:
            seen.append(F.transform(F.filter(f"l_{kind}", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))), _instance(rank, kind, True)))
    return rows.select("doc_id", "base", F.concat(*seen).alias("seen"))


def _checked(kind: str):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), m["before"].alias("before"), m["after"].alias("after"), _valid(kind, m["found"]).alias("valid"))


def _ranked(rank: int, kind: str):
    return lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def _instance(rank: int, kind: str, loose: bool = False):
    def made(m: Column) -> Column:
        known = F.lit(OPEN) if loose else F.when(m["valid"], F.lit(KNOWN)).otherwise(F.lit(REFUTED))
        return F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), known.alias("state"), F.xxhash64(F.lit(kind), F.lower(m["found"])).alias("instance"), _words(kind, m).alias("patterns"))

    return made


def grown_patterns(seen: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT, confirm: int = CONFIRM) -> tuple[DataFrame, DataFrame]:
    """``pattern, full`` of the trusted patterns and ``instance`` of the open instances believed, from the graph of both.

    An edge joins a pattern with each different instance met in it. Known instances are the first seeds and count 1, refuted ones
    0, open ones their belief, at first 0. In each round a pattern with ``support`` seeds scores the mean of its instances; an open
    instance is believed by 1 - prod(1 - score) over its scored patterns, and from ``trust`` on it is a seed itself: it counts for
    the support of its other patterns, so contexts without any known instance can follow. It ends when no seed is new, or after ``rounds``.
    Patterns that score ``trust`` with ``support`` seeds are ``full``; others with ``confirm`` seeds only confirm instances that are believed already.
    Edges are distinct before they are counted, so a very common context or a much repeated number is aggregated in the
    map-side combine and never gathered.
    """
    edges = stored(seen.select("state", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("state").alias("state")), "edges")
    open_edges = edges.where(F.col("state") == OPEN).select("pattern", "instance")

    def scored(belief: DataFrame | None) -> DataFrame:
        valued = edges.withColumn("belief", F.lit(0.0)) if belief is None else edges.join(belief, "instance", "left")
        value = F.when(F.col("state") == KNOWN, 1.0).when(F.col("state") == OPEN, F.coalesce("belief", F.lit(0.0))).otherwise(0.0)
        seed = (F.col("state") == KNOWN) | ((F.col("state") == OPEN) & (F.coalesce("belief", F.lit(0.0)) >= trust))
        out = valued.groupBy("pattern").agg(F.avg(value).alias("score"), F.count_if(seed).alias("seeds")).where(F.col("seeds") >= confirm)
        return stored(out, "scores")

    scores, belief, before = scored(None), None, -1
    for _ in range(rounds):
        voices = scores.where(F.col("seeds") >= support)
        now = open_edges.join(voices, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("belief"))
        belief = stored(now, "belief")
        scores = scored(belief)
        seeds = belief.agg(F.count_if(F.col("belief") >= trust)).first()[0]
        if seeds == before:
            break
        before = seeds
    patterns = scores.where(F.col("score") >= trust).select("pattern", (F.col("seeds") >= support).alias("full"))
    believed = belief.where(F.col("belief") >= trust).select("instance") if belief is not None else edges.where(F.lit(False)).select("instance")
    return patterns, believed


def pii_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``rank, start, end, kind`` (code points, ends exclusive).

    Base spans are the first seeds. The words in the 64 characters before and after a span are its lexical patterns, scored on the graph of
    patterns and instances in up to ``rounds`` rounds, in which instances of high belief become seeds (:func:`grown_patterns`). Added are
    spans of a looser shape in a trusted pattern, and spans of instances believed through other contexts where the pattern confirms them.
    Base spans always stay; added ones overlap none of them.
    Every row is searched by its own whole text, also if its id is NULL or repeated; NULL texts are empty; an empty
    table gives no rows.
    """
    rows = stored(base_and_loose(docs, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "spans")
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    patterns, believed = grown_patterns(seen, rounds, trust, support)
    found = seen.where(F.col("state") == OPEN).select("row", "rank", "start", "end", "kind", "instance", F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    found = found.join(believed.withColumn("believed", F.lit(True)), "instance", "left").where("full or believed")
    added = found.groupBy("row").agg(F.collect_set(F.struct("rank", "start", "end", "kind")).alias("added"))  # bounded by the spans of one text
    return rows.join(added, "row", "left").select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", F.expr("cast(array() as array<struct<rank:int,start:bigint,end:bigint,kind:string>>)")))).alias("spans"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(table_of(spark, sf_dir, "documents"))
    number = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *number, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind
