"""Hand-computed cases, hot keys, and brute force where SQL is too slow or cannot say it."""

import random

import pytest
from pyspark.sql import functions as F

from dailies.operators import dedupe, intervals, layout, ledger, resolve, segment
from dailies.operators.joins import asof_join, interval_join
from dailies.operators.ordered import plan_splits, running

US = 1_000_000


def us(*pairs):
    return [(1, int(a * US), int(b * US)) for a, b in pairs]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_literal(spark):
    df = spark.createDataFrame(us((1.0, 1.5), (1.6, 2.0), (5.0, 5.4)), "k long, s_us long, e_us long")
    assert rows(intervals.merge_ranges(df, ["k"]), "s_us", "e_us") == [(850_000, 2_150_000), (4_850_000, 5_550_000)]


def test_place_literal(spark):
    data = [(1, i, 0, int(d * US), t, tu, 1) for i, (d, t, tu) in enumerate([(1.633333, "cut", 0), (1.633333, "cut", 0), (1.166667, "cut", 0), (1.0, "xfade", 750_000)])]
    df = spark.createDataFrame(data, "project_id long, pos long, in_us long, out_us long, transition string, transition_us long, speed int")
    got = [(r.len_f, r.overlap_f, r.start_us) for r in layout.place_segments(df).orderBy("pos").collect()]
    assert got == [(49, 0, 0), (49, 0, 1_633_333), (35, 0, 3_266_667), (30, 23, 3_666_667)]


def test_sentences_literal(spark):
    text = "Jedziemy dalej. To jest tramwaj?".split()
    words = [dict(pos=i, s_us=i * 400_000, e_us=i * 400_000 + 300_000, text=t) for i, t in enumerate(text)]
    df = spark.createDataFrame([("p", 1, words)], "project_id string, clip_id long, words array<struct<pos:long,s_us:long,e_us:long,text:string>>")
    assert rows(segment.split_sentences(df), "n", "text") == [(1, "Jedziemy dalej."), (2, "To jest tramwaj?")]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.6 else rng.randrange(1, 30), i, rng.randrange(0, 900_000), rng.randrange(1, 40)) for i in range(4000)]
    return [(k, i, s, s + n * 10) for k, i, s, n in data]


def test_hot_key_windows_equal_plain_ones(spark, skewed):
    df = spark.createDataFrame(skewed, "k long, i long, s_us long, e_us long").repartition(5)
    splits = plan_splits(df, ["k"], "s_us", hot_share=0.1, piece_rows=5)
    assert splits is not None and splits.bounds.count() == 1
    maybe = F.when(F.col("i") % 3 == 0, F.col("i"))
    specs = {
        "a": ("lag", maybe), "b": ("lead", maybe), "c": ("max_before", F.col("e_us")), "d": ("sum", F.col("i")),
        "e": ("last", maybe), "f": ("last_before", maybe), "g": ("next", maybe), "h": ("next_after", maybe),
    }
    cols = ["k", "i", *specs]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    one = sorted((tuple(r[c] for c in cols) for r in running(df, ["k"], ["s_us", "i"], specs).collect()), key=key)
    two = sorted((tuple(r[c] for c in cols) for r in running(df, ["k"], ["s_us", "i"], specs, splits).collect()), key=key)
    assert one == two
    assert rows(intervals.merge_ranges(df, ["k"], pad_us=3, merge_gap_us=5), "k", "s_us", "e_us") == rows(
        intervals.merge_ranges(df, ["k"], pad_us=3, merge_gap_us=5, splits=splits), "k", "s_us", "e_us")


def test_interval_join_brute_force(spark):
    rng = random.Random(5)
    side = lambda n, p: [(rng.randrange(3), i, s, s + rng.choice([5, 30, 900, 40_000])) for i in range(n) for s in [rng.randrange(0, 60_000)]]
    a, b = side(120, "a"), side(120, "b")
    left = spark.createDataFrame(a, "k long, ai long, a_s long, a_e long")
    right = spark.createDataFrame(b, "k long, bi long, b_s long, b_e long")
    got = rows(interval_join(left, right, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), bin_us=50, coarse_us=5_000), "ai", "bi")
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])


@pytest.mark.parametrize("direction,inclusive", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_brute_force(spark, direction, inclusive):
    rng = random.Random(7)
    line = [(rng.randrange(2), rng.randrange(50), i) for i in range(60)]
    probe = [(rng.randrange(2), i, rng.randrange(50)) for i in range(80)]
    got = rows(asof_join(spark.createDataFrame(probe, "k long, p long, t long"), spark.createDataFrame(line, "k long, u long, v long"), ["k"], "t", "u", ["u"], direction=direction, inclusive=inclusive).fillna(-1), "p", "u")
    want = []
    for k, p, t in probe:
        back = direction == "backward"
        ok = [u for kk, u, _ in line if kk == k and ((u < t or (inclusive and u == t)) if back else (u > t or (inclusive and u == t)))]
        want.append((p, (max if back else min)(ok) if ok else -1))
    assert got == sorted(want)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(14)]
    base = [" ".join(rng.sample(vocab, 6)) for _ in range(12)]
    data = []
    for i in range(260):
        text = base[0] if rng.random() < 0.4 else rng.choice(base)  # a crowd of exact copies
        if rng.random() < 0.5:
            text += " " + rng.choice(vocab)
        data.append((rng.randrange(2), i, f"s{i}", text, rng.random() < 0.2))
    df = spark.createDataFrame(data, "project_id long, ord long, sentence_id string, text string, instruction boolean")
    got = rows(dedupe.near_duplicates(df), "ord", "duplicate_of")
    want = []
    for i, (p, o, _, text, _) in enumerate(data):
        a = set(text.split())
        for q, _, sid, other, instr in data[i + 1:]:
            b = set(other.split())
            if q == p and not instr and len(a) >= 4 and len(b) >= 4 and len(a & b) * 100 >= len(a | b) * 70:
                want.append((o, sid))
                break
    assert got == sorted(want)


def test_admission_ignores_refused_charges(spark):
    rng = random.Random(13)
    data = [(k, i, rng.randrange(1, 60), 300) for k in range(6) for i in range(40)]
    df = spark.createDataFrame(data, "project_id long, i long, usd_micro long, cap_micro long")
    got = {(r.project_id, r.i): r.accepted for r in ledger.admit_charges(df, ["project_id"], ["i"]).collect()}
    for k in range(6):
        spent = 0
        for _, i, usd, cap in sorted(x for x in data if x[0] == k):
            ok = spent + usd <= cap
            spent += usd if ok else 0
            assert got[(k, i)] == ok


def beat(pos, first, last, n, shots=(), **kw):
    d = dict(project_id=1, pos=pos, uid=f"u{pos}", kind="speech", clip_id=1, sents=[dict(n=i, known=True, instruction=False) for i in n], first_word=n[0] * 10, last_word=n[-1] * 10 + 5,
             first_us=int(first * US), last_us=int(last * US), dur_us=20 * US, seg_in=int((first - 0.3) * US), seg_out=int((last + 0.45) * US), a0=int((first - 0.3) * US), a1=int((last + 0.45) * US), shots=list(shots))
    return {**d, **kw}


BEAT = ("project_id long, pos long, uid string, kind string, clip_id long, sents array<struct<n:long,known:boolean,instruction:boolean>>, first_word long, last_word long, first_us long, last_us long, "
        "dur_us long, seg_in long, seg_out long, a0 long, a1 long, shots array<struct<clip:long,in_us:long,out_us:long,point_us:long,limit_us:long>>")


def test_resolve_shots_and_claims(spark):
    shot = dict(clip=9, in_us=0, out_us=US, point_us=int(2.2 * US), limit_us=10 * US)
    late = dict(clip=9, in_us=0, out_us=US, point_us=int(3.9 * US), limit_us=10 * US)
    data = [beat(0, 1.0, 5.0, [1, 2, 3], [shot]), beat(1, 1.0, 5.0, [3], []), beat(2, 8.0, 10.0, [5, 7], []), beat(3, 1.0, 5.0, [11, 12], [late])]
    out = {r.pos: r for r in resolve.resolve_beats(spark.createDataFrame(data, BEAT)).collect()}
    assert [out[i].error for i in range(4)] == [None, "sentence_reused", "sentences_not_contiguous", None]
    assert [(p.clip, p.audio_in, p.audio_out) for p in out[0].pieces] == [(1, 700_000, 2_200_000), (9, 2_200_000, 3_200_000), (1, 3_200_000, 5_450_000)]
    # less than 0.8 s would be left, so the shot is held to the end: 1.0 s plus 0.55 s
    assert [(p.clip, p.out_us, p.audio_out) for p in out[3].pieces] == [(1, 3_900_000, 3_900_000), (9, 1_550_000, 5_450_000)]


def test_resolve_joins_takes(spark):
    data = [beat(0, 1.0, 2.0, [1]), beat(1, 2.4, 4.0, [2]), beat(2, 9.0, 10.0, [9])]
    out = {r.pos: r for r in resolve.resolve_beats(spark.createDataFrame(data, BEAT)).collect()}
    assert out[1].joined_us == 2_200_000 and out[0].pieces[-1].out_us == 2_200_000 and out[0].heard_out == 2_200_000
    assert out[1].pieces[0].in_us == 2_200_000 and out[2].joined_us is None


def test_repeated_take_is_found(spark):
    line = "this is the tram we took".split()
    text = line + ["so", "anyway"] + line
    for gap, found in ((0, 1), (400, 0)):
        words = [dict(pos=i, s_us=int((i * 0.4 + (gap if i > 7 else 0)) * US), e_us=int((i * 0.4 + 0.3 + (gap if i > 7 else 0)) * US), text=t) for i, t in enumerate(text)]
        df = spark.createDataFrame([("p", 1, words)], "project_id string, clip_id long, words array<struct<pos:long,s_us:long,e_us:long,text:string>>")
        docs = dedupe.folded_words(df)
        got = dedupe.take_groups(docs, dedupe.repeated_grams(docs)).collect()
        assert len({r["take"] for r in got}) == found
        assert [(r["first"], r["last"]) for r in sorted(got, key=lambda r: r["first"])] == ([(0, 5), (8, 13)] if found else [])


def test_cards_skip_recent_places(spark):
    spans = [(0, 12, "a"), (12, 20, "a"), (20, 30, "b"), (30, 40, "a"), (40, 42, "c"), (42, 60, "c"), (60, 200, None), (200, 220, "a"), (220, 260, "b")]
    data = [(1, i, int(s * US), int(e * US), p, False) for i, (s, e, p) in enumerate(spans)]
    df = spark.createDataFrame(data, "project_id long, pos long, s_us long, e_us long, place string, cutaway boolean")
    got = [(r.place, r.card_pos) for r in resolve.location_cards(df).orderBy("pos").collect()]
    # a is carded at 12 s, so not again at 30 s; the two-second c beat hands over to the next one
    assert got == [("a", 1), ("b", 2), ("c", 5), ("a", 7), ("b", 8)]
