"""The n-gram join against all pairs on odd rows, crowds, chains and random sets."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from test_llm_queries import docs_of, same

from dailies.llm import ngramjoin


def joined(docs, shingle):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs, shingle=shingle).collect()]


@pytest.mark.parametrize("shingle", [1, 2, 5])
def test_odd_rows(spark, odd, shingle):
    same(joined(odd, shingle), [r[:3] for r in plain.near(docs_of(odd), shingle)])


def crowds(seed):
    """Chains, crowds linked in part, copies, and texts around the threshold; common passages in many of them."""
    rng = random.Random(seed)
    passage = [f"p{j}" for j in range(30)]
    docs = [" ".join(f"c{j}" for j in range(i * 3, i * 3 + 40)) for i in range(30)]
    docs += [" ".join(f"w{j}" if (j * 7 + i * 11) % 97 > 5 else f"x{i}_{j}" for j in range(200)) for i in range(80)]
    docs += [" ".join([f"s{j}" for j in range(100)] + [f"own{i // 2}_{i % 2 * (j % 2)}_{j}" for j in range(20)]) for i in range(60)]
    docs += ["Copied text of\tno many words"] * 25 + ["copied  text of no many words"]
    for _ in range(150):
        base = [f"r{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))]
        docs += [" ".join(base + passage * rng.randrange(2)), " ".join(w if rng.random() > 0.12 else f"y{rng.randrange(9)}" for w in base)]
    return list(enumerate(docs))


@pytest.mark.parametrize("shingle", [1, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_crowds(spark, monkeypatch, shingle, hot):
    if hot:  # nearly everything counts as hot, and rounds are narrow
        for name, value in (("HOT_TOKEN", 0.0), ("TARGETS", 1), ("GROWTH", 3), ("HANDED", 500)):
            monkeypatch.setattr(ngramjoin, name, value)
    docs = crowds(shingle)
    same(joined(spark.createDataFrame(docs, "doc_id bigint, text string"), shingle), [r[:3] for r in plain.near(docs, shingle)])


def tokens(texts, shingle=3):
    return [t.tolist() for t in ngramjoin.Tokens(shingle).of(pa.array([t.encode() for t in texts], pa.binary()))]


def test_tokens_are_distinct_runs():
    got = tokens(["", "a", "a b c", "a a a a", "a b c d e", "x b c d", "a b", "b a", "A B", " a\tb\n", "ab"])
    assert [len(t) for t in got] == [0, 1, 1, 1, 3, 2, 1, 1, 1, 1, 1]
    assert len(set(got[4]) & set(got[5])) == 1 and got[6] == got[8] == got[9] and len({x[0] for x in (got[6], got[7], got[10])}) == 3


def test_long_texts_and_words_are_taken_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcXYZé", k=rng.choice([1, 3, 9, 700]))) for _ in range(60)), "q" * 90_000 + " end of it", "", "one two three four"]
    want = tokens(texts)
    monkeypatch.setattr(ngramjoin, "CHUNK", 4000)
    assert tokens(texts) == want
    assert tokens([texts[0].upper().replace("É", "é")])[0] == want[0]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 10, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.union1d(a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64))
        apart = sum(int(x).bit_count() for x in (ngramjoin.sketch(a) ^ ngramjoin.sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))
