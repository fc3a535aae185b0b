"""Filter interaction and source divergence against plain versions on odd rows."""

from collections import Counter

import numpy as np
import plain
import pytest
from test_llm_queries import same

from dailies.llm import divergence, interaction
from dailies.llm.queries import QUERIES

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_interaction(spark, odd, odd_dir):
    labels = [tuple(r) for r in spark.read.parquet(f"{odd_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = QUERIES["op13_posting_lists"](spark, odd_dir).select(*COLUMNS).collect()
    same(got, plain.interaction([(r.doc_id, r.text, r.source) for r in odd.collect()], labels))


def test_narrow_ranges_give_the_same_counts(spark, odd_dir, monkeypatch):
    want = QUERIES["op13_posting_lists"](spark, odd_dir).collect()
    monkeypatch.setattr(interaction, "RANGE_BITS", 1)
    same(QUERIES["op13_posting_lists"](spark, odd_dir).collect(), map(tuple, want))


@pytest.mark.parametrize("seed", range(6))
def test_galloping_merges(seed):
    rng = np.random.default_rng(seed)
    lists = [np.unique(rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(0, 3000))) for _ in range(5)]
    lists[seed % 5] = np.zeros(0, np.int64)
    assert (interaction.gallop(lists[0], lists[1]) == np.searchsorted(lists[0], lists[1])).all()
    sizes = interaction.union_sizes(lists, lists[2], lists[3])
    for s in range(32):
        ids = set().union(*[set(v.tolist()) for i, v in enumerate(lists) if s >> i & 1])
        assert sizes[s].tolist() == [len(ids), len(ids & set(lists[2].tolist())), len(ids & set(lists[3].tolist()))]


ODD_TERMS = ("text", "lang", "source")


def divergence_rows(spark, odd):
    more = [("one two Two Éclair x1y", "en", f"s{i % 4}") for i in range(9)] + [("two three", "en", None), (None, "xx", "s0"), ("..", "xx", "s1"), ("only", None, None)]
    more += [(f"term{chr(97 + i % 26)}{chr(97 + i // 26)} shared", "de", f"s{i % 3}") for i in range(400)] * 2
    return odd.select(*ODD_TERMS).unionByName(spark.createDataFrame(more, "text string, lang string, source string"))


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence(spark, odd, least):
    docs = divergence_rows(spark, odd)
    got = divergence.divergence(docs, least=least).select("lang", "source", "part", "item", "value", "rank").collect()
    same(got, plain.divergence([tuple(r) for r in docs.collect()], least))


def test_divergence_in_small_shards_and_without_broadcast(spark, odd, monkeypatch):
    docs = divergence_rows(spark, odd)
    want = Counter(divergence.divergence(docs, least=2).collect())
    monkeypatch.setattr(divergence, "SHARD_KEYS", 7)
    monkeypatch.setattr(divergence, "HELD_SLOTS", 10)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    assert Counter(divergence.divergence(docs, least=2).collect()) == want
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", 0)
    assert Counter(divergence.divergence(docs, least=2).collect()) == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 5000])
def test_perfect_hash_is_minimal(n):
    h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    shift, slots = divergence.perfect_hash(h)
    assert sorted(slots.tolist()) == list(range(len(h)))
    d = shift[((h >> np.uint64(32)) % np.uint64(len(shift))).astype(np.int64)]
    assert (np.where(d < 0, -1 - d, divergence._place(h, np.maximum(d, 0), len(h))) == slots).all()


def test_terms_of_one_hash_and_terms_not_kept():
    of = divergence.Slots([{"shard": 0, "shards": 2, "hashed": 1, "shifts": [-1], "keys": [b"one", b"other"]}])
    of.find([b"one"])
    found = of.find([b"one", b"other", b"none"] * 2).tolist()
    assert set(found[2::3]) == {-1}
    every = divergence.Slots([{"shard": s, "shards": 2, "hashed": 1, "shifts": [-1], "keys": [b"one", b"other"]} for s in (0, 1)])
    assert [x % 2 for x in every.find([b"one", b"other"])] == [0, 1] and every.find([b"none"])[0] == -1
