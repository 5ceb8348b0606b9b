"""Claims in dense values and texts, dictionary matches against regular expressions."""

import random
import re

from helpers import rows
from insightspark.operators import textlogs as X

ENTRY = "query_id string, result_value {}, claim_ids array<bigint>"


def expected(entries, claims):
    out = {}
    for cid, v in claims:
        hits = []
        for q, r, _ in entries:
            try:
                if float(v) != 0 and abs(float(v) - float(r)) / abs(float(v)) < 0.001:
                    hits.append(q)
            except (TypeError, ValueError):
                if v is not None and v == r:
                    hits.append(q)
        out[cid] = (len(hits), min(hits, default=None))
    return out


def found(spark, entries, claims, kind):
    e = spark.createDataFrame(entries, ENTRY.format(kind))
    c = spark.createDataFrame(claims, f"claim_id long, value {kind}")
    return {r["claim_id"]: (r["n_matches"], r["first_query"]) for r in rows(X.match_claims(e, c))}


def test_bands_over_many_ranges(spark):
    rng = random.Random(1)
    # four thousand values within two tolerances of each other, and sparse ones of both signs
    values = [1000 * (1 + 0.002 * rng.random()) for _ in range(4000)] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 9) for _ in range(500)]
    values += [1000.0] * 50 + [0.0, -1000.5, 999.0, 1001.0]
    entries = [(f"q{rng.randrange(10**6):06d}", v, []) for v in values]
    claims = [(i, 1000 * (1 + 0.003 * rng.random() - 0.0005)) for i in range(300)] + [(300 + i, rng.choice(values)) for i in range(100)]
    claims += [(500, 0.0), (501, None), (502, float("nan")), (503, 1000.0), (504, 5e12), (505, float("inf"))]
    assert found(spark, entries, claims, "double") == expected(entries, claims)


def test_texts_match_on_equality_and_numbers_in_strings_by_value(spark):
    entries = [("b", "100", []), ("a", "100.05", []), ("c", "up 5 %", []), ("d", "up 5 %", []), ("e", None, []), ("f", "", []), ("g", "0", [])]
    claims = [(1, "100.0"), (2, "up 5 %"), (3, "Up 5 %"), (4, None), (5, ""), (6, "0")]
    got = found(spark, entries, claims, "string")
    assert got == {1: (2, "a"), 2: (2, "c"), 3: (0, None), 4: (0, None), 5: (1, "f"), 6: (0, None)}


def test_empty_sides(spark):
    assert found(spark, [], [(1, 5.0)], "double") == {1: (0, None)}
    assert found(spark, [("a", 1.0, [])], [], "double") == {}


def by_regex(text, aliases):
    low, used, out = text.lower(), set(), set()
    starts = [m.start() for m in re.finditer(r"\w+|\W+", low)]
    hits = [(-len(a), m.start(), a) for a in aliases for m in re.finditer(rf"(?=(?<!\w){re.escape(a)}(?!\w))", low)]
    for n, at, alias in sorted(hits):
        span = set(range(at, at - n))
        if not span & used:
            used |= span
            out.add((starts.index(at), alias))
    return out


def test_tags_equal_regular_expressions(spark):
    rng = random.Random(2)
    words = ["net", "rev", "revenue", "é", "à", "x1", "of", "the", "v2.0", "a-b", "_y"]
    aliases = ["net", "net revenue", "revenue of the", "of the", "the", "v2.0", "a-b", "à", "x1 x1", "b the net"]
    texts = ["", "the", "THE Net-Revenue", "the the the", "x1 x1 x1 x1"] + [" ".join(rng.choice(words) + rng.choice(["", ",", " -"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    data = [(i, t) for i, t in enumerate(texts)] + [(999, None)]
    info = [{"alias": a, "entity": a, "type": "t", "display_name": ""} for a in aliases] + [{"alias": "", "entity": "", "type": "", "display_name": ""}]
    got = {}
    for r in rows(X.entity_tagging(spark.createDataFrame(data, "id long, text string"), "id", "text", info)):
        got.setdefault(r["id"], set()).add((r["position"], r["alias"]))
    assert got == {i: w for i, t in data if t is not None and (w := by_regex(t, aliases))}


def test_ten_thousand_aliases(spark):
    info = [{"alias": f"item {i:05d} of", "entity": f"e{i}", "type": "t", "display_name": ""} for i in range(10000)]
    data = [(i, " and ".join(f"Item {(i * 7 + j) % 12000:05d} of" for j in range(50))) for i in range(200)]
    got = X.entity_tagging(spark.createDataFrame(data, "id long, text string"), "id", "text", info)
    assert got.count() == sum((i * 7 + j) % 12000 < 10000 for i in range(200) for j in range(50))
