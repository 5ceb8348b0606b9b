"""Secret scans by a trigram inverted index over the corpus."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import stored, table_of, text_of
from insightspark.llm.spans import listed, with_matches


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; of these only those stay whose part (the whole match, or what ``part`` takes from it) has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    part: str | None = None


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The base rules, in their order. Bounded repeats stand for "match, then drop what is too short" where no longer
#: match could follow a dropped one: runs of one character class from a start that cannot recur inside them.
BASE = [
    Rule("assign", rf"{_ASSIGN}[A-Za-z0-9+/_.=-]+", 6, rf"^{_ASSIGN}"),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
]
#: Formats of keys with a fixed prefix and least length, and private key heads.
ADDED = [
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[0-9]{8,}-[A-Za-z0-9-]{16,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
#: Alternatives that a stretch of a pattern is spelt out into at most; beyond them it is cut.
_SPELLINGS = 64


def trigram_query(pattern: str) -> list[list[str]] | None:
    """A Boolean query in lower-case trigrams that every match satisfies: any of the lists, all trigrams of a list.

    Stretches of the pattern that can be spelt out (literals, small classes, alternatives, optional parts) become sets of
    strings; the stretch whose shortest spelling is longest gives the query. None: no stretch has three characters in
    every spelling, so the rule has no mandatory trigram and must read all texts.
    """
    stretches: list[set[str]] = []

    def spell(items) -> set[str]:
        """All spellings of the items if there are few; what cannot be spelt ends a stretch."""
        now: set[str] = {""}
        for op, arg in items:
            one = spell_one(op, arg)
            if one is None or len(now) * len(one) > _SPELLINGS:
                stretches.append(now)
                now = {""} if one is None else one
            else:
                now = {a + b for a in now for b in one}
        return now

    def whole(items) -> set[str] | None:
        now: set[str] = {""}
        for op, arg in items:
            one = spell_one(op, arg)
            if one is None or len(now) * len(one) > _SPELLINGS:
                return None
            now = {a + b for a in now for b in one}
        return now

    def spell_one(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.AT:
            return {""}
        if op is C.IN:
            got = {chr(v).lower() for o, a in arg if o in (C.LITERAL, C.RANGE) for v in ([a] if o is C.LITERAL else range(a[0], min(a[1], a[0] + 99) + 1))}
            return got if len(got) <= 8 and all(o in (C.LITERAL, C.RANGE) for o, _ in arg) else None
        if op is C.SUBPATTERN:
            return whole(arg[-1])
        if op is C.BRANCH:
            parts = [whole(b) for b in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = whole(inner)
            if one is None or high is C.MAXREPEAT or high > 8 or len(one) ** max(1, int(high)) > _SPELLINGS:
                return None
            out: set[str] = set()
            power = {""}
            for n in range(int(high) + 1):
                out |= power if n >= low else set()
                power = {a + b for a in power for b in one}
            return out
        return None

    stretches.append(spell(parser.parse(pattern)))
    best = max(stretches, key=lambda s: (min(map(len, s)), -len(s)))
    if min(map(len, best)) < 3:
        return None
    clauses = {tuple(sorted({w[i: i + 3] for i in range(len(w) - 2)})) for w in best}
    return sorted(list(c) for c in clauses if not any(set(o) < set(c) for o in clauses))


def postings(docs: DataFrame, trigrams: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``trigram, doc_id`` once for every document that has the trigram, of those that some rule asks for."""
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("low"))
    every = F.array(*[F.lit(t) for t in trigrams]).cast("array<string>")
    return low.select("doc_id", F.explode(F.filter(every, lambda t: F.contains(F.col("low"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, kinds``: the documents that satisfy the trigram query of some indexed rule, from intersected postings.

    Postings of one clause are intersected by counting its trigrams per document; a trigram that a third of all documents
    have is spread by document.
    """
    clauses = [(r.kind, f"{r.kind}:{i}", t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or []) for t in c]
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(t).alias("trigram"), F.lit(n).alias("needed")) for k, c, t, n in clauses]
    wanted = docs.sparkSession.range(1).select(F.explode(F.array(*rows).cast("array<struct<kind:string,clause:string,trigram:string,needed:int>>")).alias("c")).select("c.*")
    index = stored(postings(docs, sorted({c[2] for c in clauses}), text, doc_id), "postings")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("n")).where("n = needed")  # a rule's clauses are bounded by its pattern
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _kept(matches: Column, rule: Rule, rank: int) -> Column:
    def size(m: Column) -> Column:
        return F.length(F.regexp_replace(m["found"], rule.part, "") if rule.part else m["found"])

    kept = F.filter(matches, lambda m: size(m) >= rule.least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))


def _found(df: DataFrame, rules: list[Rule], guard) -> DataFrame:
    """Add ``spans``: ``start, rank, kind, end`` of the kept matches of all rules, by start, then by the order of the rules."""
    parts = []
    for rank, rule in enumerate(rules):
        df = with_matches(df, "text", rule.pattern, f"m_{rule.kind}", guard(rule))
        parts.append(_kept(F.col(f"m_{rule.kind}"), rule, rank))
    return df.withColumn("spans", F.array_sort(F.concat(*parts))).drop(*[f"m_{r.kind}" for r in rules])


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id, spans`` for every row: array of ``start, rank, kind, end`` (code points, end exclusive), by start and rule.

    Every rule's regular expression is turned into a Boolean query in trigrams. The inverted index of those trigrams gives
    the candidates of a rule, whose texts alone are searched with the expression; rules without mandatory trigrams read
    all texts. Rows are told apart by id and text, so rows that repeat an id are each searched by their own text;
    rows with a NULL id are always candidates. NULL texts are empty; an empty table gives no rows.
    """
    rules = BASE + ADDED if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.pattern)]
    scanned = [r for r in rules if not trigram_query(r.pattern)]
    rank = {r.kind: i for i, r in enumerate(rules)}
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    chosen = stored(candidates(rows, indexed), "candidates")

    def relisted(df: DataFrame) -> Column:
        return F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.create_map(*[F.lit(x) for k, i in rank.items() for x in (k, i)])[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))

    ids = F.col("doc_id").isNull()
    some = rows.where(~ids).join(chosen, "doc_id").unionByName(rows.where(ids).withColumn("kinds", F.array(*[F.lit(r.kind) for r in indexed]).cast("array<string>")))
    some = _found(some, indexed, lambda r: F.array_contains("kinds", r.kind)).withColumn("key", F.xxhash64("doc_id", "text"))
    some = some.select("doc_id", "key", relisted(some).alias("more")).where(F.size("more") > 0).groupBy("doc_id", "key").agg(F.first("more").alias("more"))
    every = _found(rows, scanned, lambda r: F.lit(True)).withColumn("key", F.xxhash64("doc_id", "text")) if scanned else rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)").alias("spans"))
    every = every.select("doc_id", "key", relisted(every).alias("spans"))
    met = every.alias("l").join(stored(some, "verified").alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key")), "left")
    return met.select(F.col("l.doc_id").alias("doc_id"), F.array_sort(F.concat(F.col("l.spans"), F.coalesce(F.col("r.more"), F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")))).alias("spans"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table_of(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))




def _rule_sql(rank: int, rule: Rule) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    size = f"length(regexp_replace(found, {quoted(rule.part)}, ''))" if rule.part else "length(found)"
    lengths = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, cast(start as bigint) as start, cast(start + length(found) as bigint) as fin from (
 select doc_id, m[i + 1] as found, {lengths('g[1:i + 1]')} + {lengths('m[1:i]')} as start from (
  select doc_id, m, g, unnest(range(len(m))) as i from (select doc_id, regexp_extract_all(text, {quoted(rule.pattern)}) as m, string_split_regex(text, {quoted(rule.pattern)}) as g from t))) where {size} >= {rule.least}"""


_SPAN = "kind || ':' || start || ':' || fin"
SQL = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
s as ({" union all ".join(_rule_sql(i, r) for i, r in enumerate(BASE + ADDED))})
select t.doc_id, {", ".join(f"count(case when kind = '{r.kind}' then 1 end) as n_{r.kind}" for r in BASE)},
       sha256(coalesce(string_agg({_SPAN}, ',' order by start, rank) filter (rank < {len(BASE)}), '')) as base_sha256, coalesce(string_agg({_SPAN}, ',' order by start, rank), '') as spans
from t left join s using (doc_id) group by t.doc_id
"""
