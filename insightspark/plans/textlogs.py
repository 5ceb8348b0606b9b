"""Log and text queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from insightspark.operators import textlogs as X
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))

ALIASES = [
    {"alias": "the", "entity": "article", "type": "word", "display_name": "The"},
    {"alias": "of the", "entity": "of_the", "type": "phrase", "display_name": ""},
    {"alias": "and", "entity": "and", "type": "word", "display_name": ""},
    {"alias": "and the", "entity": "and_the", "type": "phrase", "display_name": ""},
    {"alias": "la", "entity": "la", "type": "word", "display_name": ""},
    {"alias": "der", "entity": "article_de", "type": "word", "display_name": "Der"},
    {"alias": "license", "entity": "license", "type": "topic", "display_name": "License"},
    {"alias": "version 2.0", "entity": "version_2", "type": "topic", "display_name": ""},
]


def query_log(t):
    """A query log derived from orders."""
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.when(k % 10 == 0, "backfill_").otherwise("q_"), k.cast("string")).alias("query_id"), (F.col("o_totalprice") / 50).alias("result_value"),
        F.when(k % 50 == 0, F.array(F.col("o_custkey"))).otherwise(F.array().cast("array<bigint>")).alias("claim_ids"))


def claim_table(t):
    return t.customer.select(F.col("c_custkey").alias("claim_id"), F.col("c_acctbal").alias("value"))


_LOG = """e AS (SELECT (CASE WHEN o_orderkey % 10 = 0 THEN 'backfill_' ELSE 'q_' END) || CAST(o_orderkey AS VARCHAR) AS query_id, o_totalprice / 50 AS rv, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey END AS cid FROM orders),
x AS (SELECT cid, count(DISTINCT query_id) AS n, min(query_id) AS q FROM e WHERE cid IS NOT NULL GROUP BY 1),
v AS (SELECT c_custkey AS cid, count(*) AS n, min(query_id) AS q FROM customer JOIN e ON c_acctbal <> 0 AND rv <> 0 AND abs(c_acctbal - rv)/abs(c_acctbal) < 0.001 WHERE c_custkey NOT IN (SELECT cid FROM x) GROUP BY 1),
m AS (SELECT c_custkey AS claim_id, coalesce(x.n, v.n, 0) AS n_matches, coalesce(x.q, v.q) AS first_query, CASE WHEN x.n IS NOT NULL THEN 'explicit' WHEN v.n IS NOT NULL THEN 'value' ELSE 'none' END AS method
 FROM customer LEFT JOIN x ON x.cid = c_custkey LEFT JOIN v ON v.cid = c_custkey)"""


@query("w1_match_claims", f"WITH {_LOG} SELECT * FROM m")
def w1(t):
    return X.match_claims(query_log(t), claim_table(t))


_PRIORITY = "CASE c_nationkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'none' END"


@query("w1_match_text_claims", f"""
WITH e AS (SELECT 'q_' || CAST(o_orderkey AS VARCHAR) AS query_id, CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice / 50 END AS rv, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority END AS rt FROM orders),
c AS (SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS v, CASE WHEN c_custkey % 3 = 0 THEN {_PRIORITY} END AS t FROM customer),
n AS (SELECT claim_id, count(*) AS n, min(query_id) AS q FROM c JOIN e ON v <> 0 AND abs(v - rv)/abs(v) < 0.001 GROUP BY 1), p AS (SELECT rt, count(*) AS n, min(query_id) AS q FROM e WHERE rt IS NOT NULL GROUP BY 1)
SELECT c.claim_id, coalesce(n.n, p.n, 0) AS n_matches, coalesce(n.q, p.q) AS first_query, CASE WHEN n.n IS NOT NULL THEN 'value' WHEN p.n IS NOT NULL THEN 'text' ELSE 'none' END AS method
FROM c LEFT JOIN n ON n.claim_id = c.claim_id LEFT JOIN p ON p.rt = c.t""")
def w1b(t):
    entries = t.orders.select(
        F.concat(F.lit("q_"), F.col("o_orderkey").cast("string")).alias("query_id"), F.array().cast("array<bigint>").alias("claim_ids"),
        F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderpriority")).otherwise((F.col("o_totalprice") / 50).cast("string")).alias("result_value"))
    claims = t.customer.select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 3 == 0, F.expr(_PRIORITY)).otherwise(F.col("c_acctbal").cast("string")).alias("value"))
    return X.match_claims(entries, claims)


@query("w2_claim_coverage", f"""WITH {_LOG}, c AS (SELECT count(*) AS total_claims, count(CASE WHEN n_matches > 0 THEN 1 END) AS matched_claims FROM m)
SELECT total_claims, matched_claims, round(matched_claims/total_claims, 4) AS coverage, (SELECT count(*) FROM e WHERE query_id LIKE 'backfill%') AS backfilled_count, CASE WHEN matched_claims/total_claims >= 0.8 THEN 'PASS' ELSE 'WARN' END AS status FROM c""")
def w2(t):
    return X.claim_coverage(query_log(t), claim_table(t))


def misses(t):
    """Error events as misses: the type from the payload, the value as description."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.where("event_type = 'error'").select("ts", (k % 7).cast("string").alias("type"), F.format_string("value %s", F.floor("value").cast("string")).alias("description"))


_MISS = "m AS (SELECT ts, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 AS VARCHAR) AS type, 'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS description FROM events WHERE event_type = 'error')"


@query("w3_miss_summary", f"""WITH {_MISS} SELECT type AS label, count(*) AS n, 'type' AS part FROM m GROUP BY 1
UNION ALL SELECT * FROM (SELECT description, count(*), 'description' FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""")
def w3(t):
    return X.miss_summary(misses(t))


@query("w3_miss_rate", f"""WITH {_MISS}, w AS (SELECT type, count(*) AS n FROM m WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT 7 AS window_days, CAST(sum(n) AS BIGINT) AS total_misses, round(sum(n)/7, 2) AS misses_per_day, (SELECT type FROM w ORDER BY n DESC, type DESC LIMIT 1) AS most_common_type FROM w""")
def w3b(t):
    return X.miss_rate(misses(t), "ts", "2024-01-30", 7)


def audit_log(t):
    return t.events.select("event_id", "ts", F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("server"), (F.col("user_id") % 4).cast("string"))).alias("server"),
                           F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))


@query("w4_audit_summary", """
SELECT 'server' AS part, coalesce(CASE WHEN user_id % 11 <> 0 THEN 'server' || CAST(user_id % 4 AS VARCHAR) END, 'unknown') AS label, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'status', CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END, count(*) FROM events GROUP BY 2""")
def w4(t):
    return X.audit_summary(audit_log(t))


@query("w4_last_errors", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_type = 'error' ORDER BY events.ts DESC, event_id DESC LIMIT 5")
def w4b(t):
    return X.last_errors(audit_log(t), "ts", "event_id").select("event_id", "ts")


@query("w5_entity_tagging")
def w5(t):
    return X.entity_tagging(t.documents, "doc_id", "text", ALIASES)


def _alternation():
    """Matches by one alternation, longest alias first. Characters that are not of a word are doubled, so that neighbours do not share one."""
    other = r"[^\p{L}\p{N}_]"
    double = lambda a: re.sub(r"(\W)", r"\1\1", a)
    names = "|".join(re.escape(double(a["alias"])).replace("\\ ", " ") for a in sorted(ALIASES, key=lambda a: -len(a["alias"])))
    info = ", ".join(f"('{double(a['alias'])}', '{a['entity']}', '{a['type']}', {1.0 if a['alias'] in (a['entity'], a['display_name'].lower()) else 0.8}::DOUBLE)" for a in ALIASES)
    return f"""
WITH d(alias, entity, type, confidence) AS (VALUES {info}), t AS (SELECT doc_id, regexp_replace(lower(text), '({other})', '\\1\\1', 'g') AS x FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, unnest(regexp_extract_all(x, '(?:^|{other})({names})(?:$|{other})', 1)) AS alias FROM t)
SELECT entity, type, confidence, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM m JOIN d USING (alias) GROUP BY 1, 2, 3"""


@query("w5_entity_counts", _alternation())
def w5b(t):
    return X.entity_tagging(t.documents, "doc_id", "text", ALIASES).groupBy("entity", "type", "confidence").agg(
        N().alias("mentions"), F.count_distinct("doc_id").alias("documents"))


def _cred(p):
    return p.replace("'", "''")


@query("w6_credential_scan", " UNION ALL ".join(
    f"SELECT source, '{n}' AS pattern, count(CASE WHEN regexp_matches(text, '{_cred(p)}', 'i') THEN 1 END) AS n FROM documents GROUP BY 1" for n, p in X.CREDENTIAL_PATTERNS.items()))
def w6(t):
    return X.credential_scan(t.documents, "text", ["source"])


@query("w7_tag_feedback_priority", """
WITH c AS (SELECT CASE turn % 8 WHEN 0 THEN 'Methodological Flaw' WHEN 1 THEN 'Missing Confound' WHEN 2 THEN 'Reframe' WHEN 3 THEN 'Missing Metric' WHEN 4 THEN 'New Analysis Needed' WHEN 5 THEN 'Scope Challenge' WHEN 6 THEN 'Output Format'
 ELSE 'Political/Organizational' END AS category, length(text) > 400 AS b FROM conversations)
SELECT CASE WHEN b THEN 'P0' WHEN category IN ('Methodological Flaw', 'Missing Confound') THEN 'P1' WHEN category IN ('Reframe', 'Missing Metric') THEN 'P2' WHEN category IN ('New Analysis Needed', 'Scope Challenge') THEN 'P3' ELSE 'P4' END AS priority,
 category, count(*) AS n FROM c GROUP BY 1, 2""")
def w7(t):
    names = list(X.FEEDBACK_PRIORITY)
    cat = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("turn") % 8 + 1).cast("int"))
    fb = t.conversations.select(cat.alias("category"), (F.length("text") > 400).alias("invalidates_data"))
    return X.feedback_priority(fb)
