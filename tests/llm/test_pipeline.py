"""Each stage against what it says, on what the stage before it kept."""

import numpy as np
import pytest

import corpus_pipeline
from insightspark.llm import simhash
from insightspark.llm.common import stored, table_of


@pytest.fixture(scope="module")
def stages(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    docs, out = table_of(spark, path, "documents"), [table_of(spark, path, "documents").toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, path), name)
        assert name == "packing" or docs.columns == before
        out.append(docs.toPandas())
    return out


def test_clean_documents_stay(stages, spark, small):
    labels = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    good, bad = labels[labels == 1].index, labels[labels == 0].index
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_exact_copies_go(stages):
    texts = stages[1].text.map(lambda t: t.encode().lower())
    assert set(stages[2].doc_id) == set(stages[1].groupby(texts).doc_id.max())


def _components(prints):
    """Smallest index reachable over links of four bits or fewer, by brute force over distinct fingerprints."""
    forest, prints = simhash.Forest(), np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= simhash.RADIUS)[0].tolist():
            forest.join(i, j)
    return [forest.root(i) for i in range(len(prints))]


def test_near_copies_go(stages):
    docs = stages[2].sort_values("doc_id")
    roots = _components([simhash.fingerprint(t) for t in docs.text])
    assert len(set(roots)) < len(roots)
    assert set(stages[3].doc_id) == {docs.doc_id.iloc[r] for r in set(roots)}


def test_mix_and_packing_lose_nothing(stages):
    assert sorted(stages[4].doc_id) == sorted(stages[3].doc_id) and set(stages[5].doc_id) == set(stages[4].doc_id)
    pieces = stages[5]
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    fills = pieces.groupby("sequence_id").length.sum().to_numpy()
    assert fills.max() <= 1024 and np.all(fills & (fills - 1) == 0)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_odd_and_empty_tables(spark, folder):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, folder[0]).collect()}
    assert kept <= {None, 1, 2, 5, 6, 7, 8, 9}
    assert corpus_pipeline.run(spark, folder[1]).collect() == []


def test_packing_follows_the_mix(spark):
    """At every prefix of the sequences the sources have about the shares of the mix, although files are read largest first."""
    from insightspark.llm import mixing

    n = {"hot": 6000, "warm": 1500, "cold": 300}
    docs = spark.createDataFrame([(i, " ".join(["word"] * (3 + i * 7 % 40)), s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, text string, source string")
    laid = stored(corpus_pipeline.source_mix(spark, docs, ""), "laid")
    pieces = corpus_pipeline.packed(spark, laid, "").select("doc_id", "sequence_id").toPandas()
    placed, name = mixing.mixed(docs)
    position = placed.select("doc_id", f"{name}.position").toPandas().set_index("doc_id").position
    source = docs.toPandas().set_index("doc_id").source
    first = pieces.groupby("doc_id").sequence_id.min().sort_values(kind="stable").index
    assert np.corrcoef(position[first], np.arange(len(first)))[0, 1] > 0.99
    in_mix = source[position.sort_values().index].to_numpy()
    packed = source[first].to_numpy()
    for at in range(500, len(packed), 500):
        for s in n:
            assert abs((packed[:at] == s).mean() - (in_mix[:at] == s).mean()) < 0.1


def test_rows_that_share_an_id_and_rows_without_one(spark):
    """A row goes only where its group has a smaller id; an id met in two groups is judged in each."""
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(3, base, "a"), (3, "another text of other words", "b"), (None, base, "c"), (7, base + " end", "d"), (2, "another text of other words", "e"), (None, "alone without an id here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    assert sorted(r.fp for r in simhash.near_dedup(docs).collect()) == ["a", "c", "e", "f"]


def test_large_groups_cost_a_row_each(spark, monkeypatch):
    """Equal fingerprints are one node before the search; what follows is as large as the nodes."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words) + " " * (i % 7) for i in range(600)] + [" ".join([*words, f"end{i}"]) for i in range(300)]
    sizes, kept = {}, simhash.stored

    def counted(df, label):
        out = kept(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    roots = _components([simhash.fingerprint(t) for t in texts])
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == sorted(set(roots))
    assert sizes["nodes"] == len({simhash.fingerprint(t) for t in texts}) <= 301
