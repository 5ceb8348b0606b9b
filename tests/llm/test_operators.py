"""The operators' own interfaces, piece by piece."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from insightspark.llm import chat, classifier, exact_dedup, mixing, packing, pii, quality_rules, quotient, secrets, simhash, wavelet
from insightspark.llm.graph import components
from insightspark.llm.tokens import Encoder, vocabulary


def test_events_fold_and_read_back(spark):
    log = [(1, 1, "a", "delta", "user", "he"), (1, 2, "a", "delta", None, "y"), (1, 3, "b", "message", "assistant", "x"), (1, 4, "b", "regenerate", None, ""), (1, 5, "b", "delta", None, "A\\<|end|>"),
           (1, 6, "a", "edit", None, "<\\/s>yo</s>\\"), (1, 7, "b", "delta", None, "B"), (1, 7, "c", None, None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg string, op string, role string, text string")
    row = chat.render(chat.fold(events)).withColumn("turns", chat.turns_of(chat.F.col("formatted"))).withColumn("learnt", chat.learnt_text("formatted", "loss")).first()
    assert [tuple(t) for t in row.turns] == [("user", "<\\/s>yo</s>\\"), ("assistant", "A\\<|end|>B"), ("", "")]
    assert row.learnt == "A\\<|end|>B"
    assert row.formatted.count(chat.END) == 3 and "</s>" not in row.formatted


def test_long_conversations_are_joined_in_runs(spark):
    rows = spark.range(1500).selectExpr("9L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    row = chat.render(chat.fold(chat.turn_events(rows))).withColumn("turns", chat.turns_of(chat.F.col("formatted"))).withColumn("learnt", chat.learnt_text("formatted", "loss")).first()
    assert [t.text for t in row.turns] == [f"t{i}" for i in range(1500)]
    assert row.learnt == "".join(f"t{i}" for i in range(1, 1500, 2))


def test_contexts_discover_loose_shapes(spark):
    texts = [f"please call me at +1 (555) {100 + i}-4567 today" for i in range(8)] + ["please call me at 555 100 8888 today", "a random sum of 555 100 8888 today", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.pii_spans(docs).collect()}
    assert spans[8] == [("phone", 18, 30)] and spans[9] == [] and spans[10] == [] and spans[0] == [("phone", 18, 35)]


def test_refuted_matches_speak_against_a_context(spark):
    good = [f"card no 4111 1111 1111 1111 at {i} 555 {100 + i} 8888" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(good)), "doc_id long, text string")
    assert all(len(r.spans) == 1 for r in pii.pii_spans(docs).collect())  # three known instances of one number are one: too few to trust


@pytest.mark.parametrize("pattern, query", [
    ("AKIA[A-Z0-9]{16,}", [["aki", "kia"]]), ("[0-9a-f]{24,}", None), ("ab(cd|ef)?g", [["abc", "bcd", "cdg"], ["abe", "bef", "efg"], ["abg"]]), ("a.b.c", None), ("(?i:Token|KEY)x*", [["key"], ["ken", "oke", "tok"]])])
def test_trigram_queries(pattern, query):
    got = secrets.trigram_query(pattern)
    assert (got and sorted(got)) == (query and sorted(query))


def test_added_secret_rules(spark):
    key = "ghp_" + "z1" * 18
    docs = spark.createDataFrame([(1, f"see {key} now"), (None, f"{key}"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_spans(docs).collect()}
    assert got == {1: [("code_host", 4, 44)], None: [("code_host", 0, 40)], 3: []}


def test_quotient_filters_merge_without_loss():
    draw = np.random.default_rng(5)
    for bits in (0, 6):
        base = draw.integers(0, 1 << (64 - bits), 3000, dtype=np.uint64) | (np.uint64(5) << np.uint64(64 - bits) if bits else np.uint64(0))
        parts = []
        for size in (1, 2, 500, 3000):
            prints, counts = np.unique(draw.choice(base, size), return_counts=True)
            blob = quotient.build(prints, counts, bits)
            back = quotient.entries(blob, 5 if bits else 0)
            assert (back[0] == prints).all() and (back[1] == counts).all()
            parts.append(back)
        prints, counts = quotient.merge(parts)
        want = np.unique(np.repeat(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])), return_counts=True)
        assert (prints == want[0]).all() and (counts == want[1]).all()


def test_exact_dedup_keeps_columns_and_ties(spark, odd_docs):
    out = exact_dedup.exact_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r.doc_id or -1, r.text or "")[:1] for r in out.collect()) == sorted([(2,), (2,), (5,), (6,), (7,), (8,), (9,)])


def test_wavelet_matrix():
    values = np.random.default_rng(1).integers(0, 37, 5000).astype(np.uint16)
    matrix, docs, starts = wavelet.from_file(wavelet.to_file(values, [4, None], np.array([0, 7]), 6))
    assert docs == [4, None] and starts.tolist() == [0, 7]
    assert (matrix.all() == values).all() and (matrix.access(np.arange(5000)) == values).all()
    for token in range(40):
        where = np.nonzero(values == token)[0]
        assert matrix.count(token, 100, 4000) == ((where >= 100) & (where < 4000)).sum()
        assert (matrix.occurrences(token) == where).all()
    with pytest.raises(IndexError):
        matrix.select(39, 0)
    empty = wavelet.from_file(wavelet.to_file(values[:0], [], np.array([], np.int64), 6))[0]
    assert empty.n == 0 and empty.count(1) == 0 and len(empty.all()) == 0


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoding_by_pieces_is_exact(name, spaced, monkeypatch):
    from insightspark.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 3000)
    monkeypatch.setattr(tokens, "TASK_PIECES", 1000)
    monkeypatch.setattr(tokens, "CHARS", 5000)
    draw = random.Random(3)
    parts = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'", "12", ".", ", ", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "́", "​", "İ", "漢字", "🙂", " \n", "ll", "word. ", "क़.", "\x00", "x" * 80]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(4000)] + ["", " ", "  "]
    tokenizer = Tokenizer.from_file(vocabulary(name))
    got = Encoder(vocabulary(name), spaced).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_sum_of_squares_choice():
    packer = packing.Packer(16)
    ids = lambda n: bytes(4 * n)
    for size in (10, 10, 6):
        packer.add(1, ids(size))
    assert packer.levels[10] == 1 and [len(p[3]) // 4 for _, _, p in packer.closed] == [10, 6]
    packer.drain()
    assert sum(len(p[3]) // 4 for _, _, p in packer.closed) == 26 and not packer.levels.any()


def test_ball_links_find_all_pairs(spark):
    draw = np.random.default_rng(2)
    centres = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    keys = {int(c) for c in centres}
    for c in centres:
        for _ in range(15):
            flips = draw.choice(64, draw.integers(1, 6), replace=False)
            keys.add(int(c) ^ int(sum(1 << int(b) for b in flips)))
    keys = np.array(sorted(keys), np.uint64)
    rows = [(int(k), [int(k)]) for k in keys.view(np.int64)]
    links = simhash.ball_links(spark.createDataFrame(rows, "node long, keys array<long>"))
    got = {r.node: r.root for r in components(links).collect()}
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(keys)):
        for b in np.nonzero(np.bitwise_count(keys[:a] ^ keys[a]) <= 4)[0].tolist():
            up[root(a)] = root(b)
    groups = {}
    for i, k in enumerate(keys.view(np.int64).tolist()):
        groups.setdefault(root(i), []).append(k)
    assert got == {k: min(g) for g in groups.values() if len(g) > 1 for k in g}


def test_hot_bucket_is_dealt_by_further_bits(monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS", 1 << 14)
    base = np.array([0, 0b1111 << 20, 1 << 30, 1 << 50], np.uint64)
    found = set()
    for a, b in simhash.collisions(base, np.full(4, 2), np.arange(4), 8, 2):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert {(0, 1), (0, 2), (0, 3)} <= found


def test_near_dedup(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "changed", *words[101:]]
    other = [f"v{i}" for i in range(200)]
    docs = spark.createDataFrame([(3, " ".join(words), "a"), (5, " ".join(near).upper(), "b"), (9, " ".join(other), "c"), (None, " ".join(words), "d"), (11, None, "e"), (12, "", "f"), (9, " ".join(other), "g")], "doc_id long, text string, later string")
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.later for r in out.collect()) == ["a", "c", "d", "e", "g"]


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(301)}


def test_mix_of_more_sources_than_a_period(spark):
    sources = [None, "", *(f"host{i}" for i in range(1100))]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([*sources, *["host7"] * 3000])], "doc_id long, source string")
    placed, name = mixing.mixed(docs)
    rows = placed.select("doc_id", "source", f"{name}.*").toPandas().sort_values("position")
    assert rows.position.tolist() == list(range(len(sources) + 3000)) and set(rows.doc_id) == set(range(len(sources) + 3000))
    assert rows.slot.is_monotonic_increasing and rows.groupby("slot").source.nunique(dropna=False).max() == 1


def test_mix_timetables_agree(spark):
    shared = [("a", 3), (None, 1), ("b", 7), ("", 2), ("é", 3)]
    frame = spark.createDataFrame([(s, 9, n) for s, n in shared], "source string, n long, slots int")
    want = [(r.source, r.turn) for r in mixing.timetable(frame, 16).orderBy("slot").collect()]
    assert [(shared[i][0], turn) for i, turn in mixing.many_turns(shared, 16)] == want


def test_mix_order_and_targets(spark, odd_docs):
    out = mixing.in_mix_order(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 11
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 4 = 0, 'x', 'y') as source")
    placed, name = mixing.mixed(docs, targets={"x": 3.0, "y": 1.0}, block=1, period=8)
    order = [r.source for r in placed.orderBy(f"{name}.position").collect()]
    assert all(abs(order[:n].count("x") - 0.75 * n) < 1 for n in range(1, 129))
    with pytest.raises(ValueError):
        mixing.mixed(docs, period=1)


def test_compression_bands_reject_repetition_and_noise():
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    draw = random.Random(1)
    prose = " ".join(draw.choice("the of and threin onthe wher ation esing thouble eaonly".split()) + draw.choice("abcdefghij") for _ in range(3000)).encode()
    verdict = lambda data: quality_rules.in_bands(len(data), *quality_rules.compression(data, packer))
    assert verdict(prose) and not verdict(b"spam and eggs " * 3000) and not verdict(bytes(draw.randrange(33, 127) for _ in range(40_000)).replace(b"a", b" "))
    assert quality_rules.compression(b"", packer) == (1.0, 0, 0)
    assert quality_rules.compression(prose[: 2 * 2048], packer)[1] == 2 and quality_rules.compression(prose[: 3 * 2048 - 1], packer)[1] == 2


def test_ranker_without_both_labels_accepts_all():
    ranker = classifier.fit(np.zeros((3, classifier.N_FEATURES)), np.array([1, 1, 1]))
    assert (ranker.score(np.array([classifier.features("any text")])) >= classifier.ACCEPT).all()
