"""Every query over the given tables against brute force in plain Python, and over odd and empty tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from insightspark.llm import queries as Q
from insightspark.llm.tokens import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ran(spark, name, path):
    return [r.asDict() for r in Q.queries()[name](spark, path).collect()]


def texts(spark, path):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.fixture(params=["given", "odd"])
def path(request, small, folder):
    return small if request.param == "given" else folder[0]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, folder, name):
    rows = ran(spark, name, folder[1])
    assert [r["conv_id"] for r in rows] == ([-1] if name.startswith("op1_") else [])


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_op1(spark, path):
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{path}/conversations.parquet").collect():
        rows[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    rows[-1] = [((True, 0), "user", said), ((True, 1), "assistant", said)]
    want = []
    for conv, turns in rows.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        want.append((conv, len(turns), turns_digest([(r, t) for _, r, t in turns]), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    same([(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in ran(spark, "op1_chat", path)], want)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_op2(spark, path):
    want = []
    for i, t in texts(spark, path):
        spans = pii(t)
        want.append((i, *[sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in ran(spark, "op2_pii", path)], want)


def test_op3(spark, small, folder):
    rows = ran(spark, "op3_quality_classifier", folder[0])
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 5, 6, 7, 8, 9)}
    mid = small.replace("sf0.001", "sf0.01")
    labels = dict(duckdb.sql(f"select doc_id, quality from '{mid}/labels.parquet'").fetchall())
    held = [(r["predicted"], labels[r["doc_id"]]) for r in ran(spark, "op3_quality_classifier", mid) if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def fingerprint(text):
    words = WORD.findall(text.translate(LOWER))
    grams = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op4(spark, path):
    docs = [(i, fingerprint(t)) for i, t in texts(spark, path)]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if (docs[a][1] ^ docs[b][1]).bit_count() <= 4:
                up[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(docs):
        low.setdefault(root(a), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in ran(spark, "op4_simhash", path)], [(i, f"{f:016x}", least[root(a)]) for a, (i, f) in enumerate(docs)])


def encoded(name, text, end):
    return np.array([*TOKENIZERS[name].encode(text, add_special_tokens=False).ids, end], "<u4").tobytes()


TOKENIZERS = {n: Tokenizer.from_file(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_op5(spark, path):
    rows = ran(spark, "op5_wavelet", path)
    data = [(i, encoded("word_bpe_49k.json", t, 1)) for i, t in texts(spark, path)]
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows], [(i, len(d) // 4, zlib.crc32(d)) for i, d in data])
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_op6(spark, path):
    want = []
    for i, t in texts(spark, path):
        spans = secrets(t)
        want.append((i, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()))
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in ran(spark, "op6_secrets", path)], want)


def test_op7(spark, path):
    rows = ran(spark, "op7_exact_dedup", path)
    docs = [(i, hashlib.sha256(t.translate(LOWER).encode()).hexdigest()) for i, t in texts(spark, path)]
    groups = collections.defaultdict(list)
    for i, h in docs:
        groups[h].append(i)
    best = {h: max(ids, key=lambda i: (i is not None, i or 0)) for h, ids in groups.items()}
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], [(i, best[h], len(groups[h]), h) for i, h in docs])
    assert collections.Counter(r["text_sha256"] for r in rows if r["kept"]) == dict.fromkeys(groups, 1)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_op8(spark, path):
    rows = ran(spark, "op8_mixing", path)
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in texts(spark, path))
    blocks = {(r["source"], r["block"]): (r["slot"], r["weight"]) for r in rows}
    assert len({s for s, _ in blocks.values()}) == len(blocks)
    weights = {s: w for (s, _), (_, w) in blocks.items()}
    assert sum(weights.values()) == pytest.approx(1)
    last = min((sum(s == src for s, _ in blocks)) / w for src, w in weights.items())
    for src, w in weights.items():
        slots = sorted(slot for (s, _), (slot, _) in blocks.items() if s == src)
        for n, slot in enumerate(slots):
            if slot < last:
                assert abs(n - slot * w) < 1 and abs(n + 1 - (slot + 1) * w) < 1
    order = sorted(rows, key=lambda r: r["position"])
    assert [(r["slot"], r["rank"]) for r in order] == sorted((r["slot"], r["rank"]) for r in rows)


def test_op9(spark, path):
    rows = ran(spark, "op9_packing", path)
    from insightspark.llm.packing import pack

    pieces = [r.asDict() for r in pack(spark.read.parquet(f"{path}/documents.parquet")).collect()]
    assert sorted((r["sequence_id"], r["offset"], r["ids_crc32"]) for r in rows) == sorted((p["sequence_id"], p["offset"], zlib.crc32(p["ids"])) for p in pieces)
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"]
    fills = []
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [0, *np.cumsum([n for _, n in w])[:-1]]
        fills.append(sum(n for _, n in w))
    assert max(fills) <= 1024 and all(f & (f - 1) == 0 for f in fills)  # no padding at all
    docs = collections.Counter(encoded("byte_bpe_50k.json", t, 0) for _, t in texts(spark, path))
    if path.endswith("0.001"):
        whole = collections.defaultdict(list)
        for p in pieces:
            whole[p["doc_id"]].append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
        assert collections.Counter(b"".join(d for _, d, _ in sorted(w)) for w in whole.values()) == docs
        assert all({n for *_, n in w} == {sum(len(d) for _, d, _ in w) // 4} for w in whole.values())
    assert sum(p["length"] for p in pieces) == sum(len(d) // 4 * n for d, n in docs.items())


def rules(text):
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i: i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_op10(spark, path):
    rows = ran(spark, "op10_quality_rules", path)
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows], [(i, *rules(t)) for i, t in texts(spark, path)])
    assert not any(r["kept"] and r["base_failed"] for r in rows)
