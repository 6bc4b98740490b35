import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import mixing as M
from palimpsest.llm import packing as P
from palimpsest.llm.tokens import encoder


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(50, 90))
def test_assignment(sizes, capacity):
    sizes = np.sort(np.array(sizes))[::-1]
    boxes = P.assign(sizes, capacity)
    load = np.bincount(boxes, weights=sizes)
    assert load.max(initial=0) <= capacity and len(boxes) == len(sizes)


def test_pack(spark):
    rows = [(i, "word " * n, "clash") for i, n in enumerate([700, 10, 20, 0, 5, 5, 300, 250])] + [(4, "word " * 5, "x"), (50, None, "x"), (51, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    sizes = spark.createDataFrame([(1, 256), (2, 1024), (3, None), (4, 0)], "size_id int, capacity_tokens int")
    sized = P.measured(docs).toPandas()
    packed = P.pack(P.measured(docs), sizes).toPandas()
    for size, capacity in ((1, 256), (2, 1024)):
        own = packed[packed.size_id == size]
        assert own.groupby("container_id").tokens.sum().max() <= capacity
        assert own.tokens.sum() == sized.tokens.sum() and set(own.doc_id) == set(sized.doc_id)
        split = own.groupby("doc_id").piece_no.nunique()
        large = set(sized[sized.tokens > capacity].doc_id)
        assert set(split[split > 1].index) == large
    assert set(packed.size_id) == {1, 2}
    report = P.fill_report(P.pack(P.measured(docs), sizes), sizes).toPandas()
    assert (report.unused_share < 0.6).all()
    assert P.pack(P.measured(docs.limit(0)), sizes).count() == 0 and P.pack(P.measured(docs), sizes.limit(0)).count() == 0
    assert len(encoder().encode_ordinary("word " * 5)) == sized[sized.doc_id == 5].tokens.iloc[0]


def test_split_tree():
    counts = np.array([7, 0, 100, 13])
    got = M.split_tree(counts, 9, np.random.default_rng(3))
    assert got.shape == (9, 4) and (got.sum(axis=0) == counts).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 2


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(1, 60)), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 100 + ["small"] * 12 + ["unlisted"] * 20)] + [(9000, None, "big"), (9001, "", "small"), (9002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 4), ("none", None, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets).toPandas()
    share = mixed.groupby("source").tokens.sum() / mixed.tokens.sum()
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(share[s] - t) < 0.02
    uses = mixed.groupby(["source", "doc_id"]).size().groupby("source").max()
    assert uses["big"] == 1 and uses["mid"] <= 2 and uses["small"] <= 4
    assert not mixed.duplicated(["source", "doc_id", "repeat_no"]).any() and set(mixed.source) == {"big", "mid", "small"}
    report = M.shares(M.mix(docs, targets), targets).toPandas().set_index("source")
    assert report.loc["absent", "actual_share"] == 0 and abs(report.actual_share.sum() - 1) < 1e-9
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0


def test_tree_grown_below_its_leaves_keeps_counts():
    counts = np.array([700, 0, 10_000, 1300])
    nodes = M.leaves(counts, 1000, np.random.default_rng(3), 64)
    assert sum(n for _, n in nodes) == 1000 and max(n for _, n in nodes) <= 64 and (sum(c for c, _ in nodes) == counts).all()
    one = M.leaves(counts, 9, np.random.default_rng(3), 1)
    assert (np.array([c for c, _ in one]) == M.split_tree(counts, 9, np.random.default_rng(3))).all()


def test_more_shards_than_leaves(spark, monkeypatch):
    """Ten thousand shards from eight leaves: every use in one shard, none lost."""
    monkeypatch.setattr(M, "LEAVES", 8)
    monkeypatch.setattr(M, "SHARD_TOKENS", 1)
    monkeypatch.setattr(M, "BLOCK_DOCUMENTS", 1)
    docs = spark.range(12_000).selectExpr("id as doc_id", "'word' as text", "if(id % 3 = 0, 'a', 'b') as source")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets).toPandas()
    assert mixed.shard.nunique() > 9000 and mixed.shard.max() > 10_000 and not mixed.duplicated(["shard", "pos"]).any()
    uses = mixed.groupby("source").size()
    assert abs(uses["a"] - uses["b"]) <= 1 and uses["b"] == 8000 and not mixed.duplicated(["doc_id", "repeat_no"]).any()
    sizes = mixed.groupby("shard").size()
    assert sizes.mean() < 8
