"""Jobs over query logs, error logs and text columns."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.functions.columns import ratio
from insightspark.functions.ranks import places_in, split_count

N = lambda: F.count(F.lit(1))

# Credential patterns, matched without regard to case.
CREDENTIAL_PATTERNS = {
    "OAuth access token": r"\bya29\.[A-Za-z0-9_\-]{20,}",
    "OAuth refresh token": r"\b1//[A-Za-z0-9_\-]{20,}",
    "JWT": r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "Private key": r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
    "Password in output": r"(password|passwd|pwd)\s*[:=]\s*\S+",
    "API key in output": r"(api[_-]?key|apikey)\s*[:=]\s*\S+",
    "Secret key in output": r"(secret[_-]?key|client[_-]?secret)\s*[:=]\s*\S+",
    "Token in output": r"(access[_-]?token|auth[_-]?token|bearer)\s*[:=]\s*\S{20,}",
}
# For each pattern, lower-case strings one of which every match holds.
CREDENTIAL_GUARDS = {
    "OAuth access token": ["ya29."], "OAuth refresh token": ["1//"], "JWT": ["eyj"], "AWS access key": ["akia"], "Private key": ["-----begin"], "Password in output": ["password", "passwd", "pwd"],
    "API key in output": ["api"], "Secret key in output": ["secret"], "Token in output": ["token", "bearer"],
}
# Feedback categories and what they change in an analysis.
FEEDBACK_PRIORITY = {
    "Methodological Flaw": "P1", "Missing Confound": "P1", "Reframe": "P2", "Missing Metric": "P2", "New Analysis Needed": "P3",
    "Scope Challenge": "P3", "Output Format": "P4", "Political/Organizational": "P4",
}

#: Relative tolerance of a value match.
TOLERANCE = 0.001


def _as_number(column: str, kind: str):
    """The column as a double, NULL where it is no finite number."""
    number = F.col(column).cast("double") if kind != "string" else F.expr(f"try_cast(`{column}` AS double)")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def _is_text(column: str, kind: str):
    return F.lit(False) if kind != "string" else F.expr(f"try_cast(`{column}` AS double)").isNull()


def _band_hits(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Number and smallest id of the held values of one range that lie in the band of each probe.

    The band is one run of the sorted values, so its ends are found by bisection with the match rule itself, its number is a difference of
    running counts and its smallest id comes from minima over runs of powers of two.
    """
    held = held.sort_values("x")
    x, n, ids = held["x"].to_numpy(), held["n"].to_numpy(), held["q"].to_numpy()
    v = probes["v"].to_numpy()
    size = len(x)
    met = lambda i: np.abs(v - x[np.minimum(i, size - 1)]) / np.abs(v) < TOLERANCE
    centre = np.searchsorted(x, v)
    # first value at or after the centre that is out of the band, and first value before it that is in
    low, high = centre.copy(), np.full(len(v), size)
    while (low < high).any():
        mid = (low + high) // 2
        inside = met(mid)
        low, high = np.where((low < high) & inside, mid + 1, low), np.where((low < high) & ~inside, mid, high)
    end = low
    low, high = np.zeros(len(v), dtype=np.int64), centre.copy()
    while (low < high).any():
        mid = (low + high) // 2
        inside = met(mid)
        low, high = np.where((low < high) & ~inside, mid + 1, low), np.where((low < high) & inside, mid, high)
    start = low
    some = end > start
    totals = np.concatenate([[0], np.cumsum(n)])
    order = pc.sort_indices(pa.array(ids, pa.string()), null_placement="at_end").to_numpy().astype(np.int64)
    minima, best = np.empty(size, dtype=np.int64), np.full(len(v), size)
    minima[order] = np.arange(size)
    width = 1
    while width <= size:
        now = some & (end - start >= width) & (end - start < 2 * width)
        if now.any():
            best[now] = np.minimum(minima[start[now]], minima[end[now] - width])
        if 2 * width > size:
            break
        minima = np.minimum(minima[:-width], minima[width:])
        width *= 2
    return pd.DataFrame({"v": v[some], "n": (totals[end] - totals[start])[some], "q": pd.Series(ids[order[best[some]]], dtype=object)})


def value_bands(values: DataFrame, held: DataFrame) -> DataFrame:
    """(v, n, q) per value of ``values`` (v): number ``n`` and smallest ``q`` of the rows of ``held`` (x, n, q) within the tolerance of v.

    Both sides hold distinct values. They are cut into ranges of about equal numbers of values and band ends; the two ends of a band are searched in the
    ranges they fall in, and the ranges between them count as wholes, by running totals and minima of ranges. So neither the number of values in a
    band nor that of bands over a value makes pairs of rows.
    """
    edge = lambda k: [F.col("v") - F.abs("v") * k, F.col("v") + F.abs("v") * k]
    # an end lies between these two whatever the rounding
    (out_l, out_h), (in_l, in_h) = edge(TOLERANCE * (1 + 1e-9)), edge(TOLERANCE * (1 - 1e-9))
    splits = split_count(held)
    points = held.select("x").unionByName(values.select(F.explode(F.array(in_l, in_h)).alias("x")))
    probs = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    bounds = points.agg(F.percentile_approx("x", probs, F.lit(max(1000, 4 * splits))).alias("b")).scalar()
    held = held.withColumn("_bounds", bounds).select("x", "n", "q", places_in(F.col("_bounds"), [F.col("x")], splits)[0].alias("range"))
    probes = values.withColumn("_bounds", bounds).select("v", places_in(F.col("_bounds"), [out_l, in_l, in_h, out_h], splits).alias("p")).select("v", *[F.col("p")[i].alias(n) for i, n in enumerate(("ol", "il", "ih", "oh"))])
    ends = probes.select("v", F.explode(F.array_distinct(F.concat(F.sequence("ol", "il"), F.sequence("ih", "oh")))).alias("range"))
    at_ends = ends.groupBy("range").cogroup(held.groupBy("range")).applyInPandas(
        lambda left, right: _band_hits(left, right) if len(left) and len(right) else pd.DataFrame({"v": [], "n": [], "q": []}, dtype=object), "v double, n long, q string")
    # one row per range: the rows of the ranges before it, and the minima of the runs of 1, 2, 4, ... ranges that begin with it
    every = held.sparkSession.range(splits).select(F.col("id").cast("int").alias("range"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("q"))
    per = held.select("range", "n", "q").unionByName(every).groupBy("range").agg(F.sum("n").alias("n"), F.min("q").alias("q"))
    along = W.partitionBy(F.lit(0)).orderBy("range")
    minima = F.array(*[F.min("q").over(along.rowsBetween(0, (1 << k) - 1)) for k in range(splits.bit_length())])
    per = per.select("range", F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), minima.alias("minima"))
    whole = per.agg(F.sort_array(F.collect_list(F.struct("range", "before", "minima")))).scalar()
    first, end = F.col("il") + 1, F.col("ih")
    # the longest of these runs that fits, from the first range on and up to the last
    run = F.floor(F.log2(end - first)).cast("int")
    least = lambda w: F.least(w[first]["minima"][run], w[end - F.pow(F.lit(2), run).cast("int")]["minima"][run])
    found = F.transform(F.array("_w"), lambda w: F.struct((w[end]["before"] - w[first]["before"]).alias("n"), least(w).alias("q")))[0]
    between = probes.where("ih - il > 1").withColumn("_w", whole).select("v", found.alias("s")).select("v", "s.n", "s.q").where("n > 0")
    return at_ends.unionByName(between).groupBy("v").agg(F.sum("n").alias("n"), F.min("q").alias("q"))


def match_claims(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """Per claim: number of matching log entries, the first of them and the method.

    Explicit claim ids win. Other claims match entries whose value lies within 0.1 % of theirs (see :func:`value_bands`); where ``value`` or
    ``result_value`` is a string column, strings that are numbers count as numbers and the others match on equality. A claim of zero, NaN, an
    infinity or NULL matches nothing by its value.
    """
    explicit = (entries.select("query_id", F.explode("claim_ids").alias("claim_id")).groupBy("claim_id")
                .agg(F.count_distinct("query_id").alias("n_explicit"), F.min("query_id").alias("q_explicit")))
    base = claims.join(explicit, "claim_id", "left")
    kind, held_kind = claims.schema["value"].dataType.simpleString(), entries.schema["result_value"].dataType.simpleString()
    base = base.withColumn("_v", F.when(F.col("n_explicit").isNull(), F.nullif(_as_number("value", kind), F.lit(0.0))))
    base = base.withColumn("_t", F.when(F.col("n_explicit").isNull() & _is_text("value", kind), F.col("value").cast("string")))
    held = entries.select("query_id", _as_number("result_value", held_kind).alias("x"), F.when(_is_text("result_value", held_kind), F.col("result_value").cast("string")).alias("_t"))
    numbers = held.where("x IS NOT NULL").groupBy("x").agg(N().alias("n"), F.min("query_id").alias("q"))
    texts = held.where("_t IS NOT NULL").groupBy("_t").agg(N().alias("n_text"), F.min("query_id").alias("q_text"))
    bands = value_bands(base.where("_v IS NOT NULL").select(F.col("_v").alias("v")).distinct(), numbers)
    out = base.join(bands.select(F.col("v").alias("_v"), F.col("n").alias("n_value"), F.col("q").alias("q_value")), "_v", "left").join(texts, "_t", "left")
    return out.select(
        "claim_id", F.coalesce("n_explicit", "n_value", "n_text", F.lit(0)).alias("n_matches"), F.coalesce("q_explicit", "q_value", "q_text").alias("first_query"),
        F.when(F.col("n_explicit").isNotNull(), "explicit").when(F.col("n_value").isNotNull(), "value").when(F.col("n_text").isNotNull(), "text").otherwise("none").alias("method"))


def claim_coverage(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """Matched share of the claims and how many log entries were backfilled."""
    m = match_claims(entries, claims).agg(N().alias("total_claims"), F.count_if(F.col("n_matches") > 0).alias("matched_claims"))
    back = entries.agg(F.count_if(F.col("query_id").startswith("backfill_"))).scalar()
    cov = F.coalesce(ratio("matched_claims", "total_claims"), F.lit(1.0))
    return m.select("total_claims", "matched_claims", F.round(cov, 4).alias("coverage"), back.alias("backfilled_count"), F.when(cov >= 0.8, "PASS").otherwise("WARN").alias("status"))


def miss_summary(misses: DataFrame, top: int = 5) -> DataFrame:
    """Counts by type and the most frequent descriptions."""
    by_type = misses.groupBy(F.coalesce("type", F.lit("other")).alias("label")).agg(N().alias("n")).withColumn("part", F.lit("type"))
    desc = misses.groupBy(F.col("description").alias("label")).agg(N().alias("n")).orderBy(F.desc("n"), "label").limit(top).withColumn("part", F.lit("description"))
    return by_type.unionByName(desc)


def miss_rate(misses: DataFrame, ts: str, as_of: str, days: int = 7) -> DataFrame:
    """Misses per day in the window before ``as_of`` and the most common type."""
    end = F.lit(as_of).cast("timestamp_ntz")
    w = misses.where((F.col(ts) >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) < end))
    per = w.groupBy("type").agg(N().alias("n"))
    return per.agg(F.lit(days).alias("window_days"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_misses"),
                   F.round(F.coalesce(F.sum("n"), F.lit(0)) / float(max(days, 1)), 2).alias("misses_per_day"), F.max_by("type", F.struct("n", "type")).alias("most_common_type"))


def audit_summary(log: DataFrame) -> DataFrame:
    """Entries by server and by status from one scan."""
    g = log.groupingSets([["server"], ["status"]], "server", "status").agg(N().alias("n"), F.grouping("server").alias("_g"))
    return g.select(F.when(F.col("_g") == 0, "server").otherwise("status").alias("part"), F.coalesce(F.when(F.col("_g") == 0, F.col("server")).otherwise(F.col("status")), F.lit("unknown")).alias("label"), "n")


def last_errors(log: DataFrame, ts: str, key: str, n: int = 5) -> DataFrame:
    """The latest error entries."""
    return log.where("status = 'error'").orderBy(F.desc(ts), F.desc(key)).limit(n)


# -- text ------------------------------------------------------------------

_SEGMENTS = re.compile(r"\w+|\W+")


def _trie(aliases: list[dict]) -> dict:
    """Aliases as a tree over their segments (runs of word characters and runs of others), lower case; the key None holds (length, alias)."""
    root: dict = {}
    for a in aliases:
        node = root
        for piece in _SEGMENTS.findall(a["alias"].lower()):
            node = node.setdefault(piece, {})
        node[None] = a["alias"].lower()
    return root


def _tags(text: str, root: dict) -> list[tuple[int, str]]:
    """(segment, alias) of the matches in a text: longer aliases first, then earlier ones, no overlaps."""
    pieces = _SEGMENTS.findall(text.lower())
    hits = []
    for i in [i for i, piece in enumerate(pieces) if piece in root]:
        node, at = root[pieces[i]], i
        while node:
            at += 1
            alias = node.get(None)
            if alias is not None:
                hits.append((-len(alias), i, at, alias))
            node = node.get(pieces[at]) if at < len(pieces) else None
    hits.sort()
    used, kept = bytearray(len(pieces)), []
    for _, i, end, alias in hits:
        if 1 not in used[i:end]:
            used[i:end] = b"\x01" * (end - i)
            kept.append((i, alias))
    return kept


def entity_tagging(df: DataFrame, key: str, text: str, aliases: list[dict]) -> DataFrame:
    """Word-bounded, case-free dictionary matches over whole texts; longer aliases first, no overlaps.

    ``aliases`` is the dictionary (alias, entity, type, display_name). It goes to the tasks as a tree over the segments of its aliases, and a text is walked
    once: the work of a text depends on its own length and its matches, not on the size of the dictionary. ``position`` is the number of the
    segment, counted from 0. Nothing is shuffled. Of aliases that differ in case only the last counts; an empty alias matches nothing.
    """
    aliases = [a for a in aliases if a["alias"]]
    root = _trie(aliases)
    info = {a["alias"].lower(): (a["entity"], a["type"], 1.0 if a["alias"].lower() in (a["entity"], (a.get("display_name") or "").lower()) else 0.8) for a in aliases}

    schema = T.StructType([df.schema[key], T.StructField("position", T.IntegerType()), T.StructField("alias", T.StringType()),
                           T.StructField("entity", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def tag(batches):
        for batch in batches:
            rows, at, alias = [], [], []
            for row, content in enumerate(batch.column(1)):
                tags = _tags(content.as_py(), root)
                rows += [row] * len(tags)
                at += [i for i, _ in tags]
                alias += [a for _, a in tags]
            about = [info[a] for a in alias]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(alias, pa.string()),
                 *[pa.array([x[i] for x in about], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))]], schema.names)

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(tag, schema)


def credential_scan(df: DataFrame, text: str, keys: list[str] = ()) -> DataFrame:
    """Rows with a match per credential class, from one scan of the whole texts.

    A plain search for a string that every match holds comes before each regular expression.
    """
    low, df = F.col("_low"), df.withColumn("_low", F.lower(text))
    guard = lambda n: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in CREDENTIAL_GUARDS[n]])
    hits = [F.count_if(F.when(guard(n), F.col(text).rlike(f"(?i){p}")).otherwise(False)).alias(f"c{i}") for i, (n, p) in enumerate(CREDENTIAL_PATTERNS.items())]
    g = (df.groupBy(*keys) if keys else df.groupBy()).agg(*hits)
    return g.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.col(f"c{i}").alias("n")) for i, n in enumerate(CREDENTIAL_PATTERNS)])))


def feedback_priority(feedback: DataFrame, category: str = "category", blocks: str = "invalidates_data") -> DataFrame:
    """Feedback per priority and category; anything that invalidates the data is P0."""
    mapping = F.create_map(*[x for k, v in FEEDBACK_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    p = F.when(F.col(blocks), "P0").otherwise(F.coalesce(mapping[F.col(category)], F.lit("P3")))
    return feedback.groupBy(p.alias("priority"), category).agg(N().alias("n"))
