"""Cues against plain walks, batch by batch, and how often their words are shuffled."""

import random

import pytest

from dailies.operators import layout, reports, segment
from dailies.operators.ordered import plan_splits

COLUMNS = "project_id string, clip_id long, pos long, s_us long, e_us long, text string"


def talk(n_clips=6, n=400):
    rng, rows = random.Random(5), []
    for clip in [*range(n_clips), None]:
        at = 0
        for pos in range(rng.choice([1, 2, 7, n])):
            at += rng.choice([50_000, 100_000, 400_000, 2_000_000])
            rows.append(("p" if clip != 2 else None, clip, pos, at, at + rng.choice([200_000, 300_000, 1_500_000, 5_000_000]), rng.choice(["so", "it", "goes.", "Why?", "ja!"])))
            at = rows[-1][4]
    return rows


def plain(rows, by_gap):
    out = []
    for key in {(r[0], r[1]) for r in rows}:
        cues, n, last = [], 0, None
        for _, _, pos, s, e, text in sorted(r for r in rows if (r[0], r[1]) == key):
            if by_gap and (last is None or s - last > 800_000 or (n and (e - cues[-1][0] > 4_000_000 or n >= 5))):
                n = 0
            shut = by_gap and n >= 3 and text[-1] in ".!?"
            if n == 0:
                cues.append([s, e, 0, ""])
            cues[-1][1:] = [e, cues[-1][2] + 1, (cues[-1][3] + " " + text).strip()]
            n = 0 if shut else n + 1
            if not by_gap and (n >= 5 or e - cues[-1][0] >= 4_000_000 or (text[-1] in ".!?" and n >= 3)):
                n = 0
            last = e
        for i, (s, e, k, text) in enumerate(cues):
            nxt = cues[i + 1][0] if i + 1 < len(cues) else e + 1_000_000
            if by_gap:
                end = min(min(s + 1_000_000, max(e, nxt)) if e - s < 1_000_000 else e, s + 4_000_000)
            else:
                end = max(min(max(e, s + 1_000_000), max(nxt, e)) if e - s < 1_000_000 else e, s + 50_000)
            out.append((*key, s, end, k, text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 3, 10_000])
@pytest.mark.parametrize("by_gap", [True, False])
def test_cues_match_plain_walk_in_any_batches(spark, by_gap, size):
    rows = talk()
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        got = (segment.gap_cues if by_gap else segment.simple_cues)(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(((r.project_id, r.clip_id, r.s_us, r.e_us, r.n_words, r.text) for r in got), key=repr) == plain(rows, by_gap)
    if not by_gap:
        for key in {(r.project_id, r.clip_id) for r in got}:
            own = sorted((r.s_us, r.cue) for r in got if (r.project_id, r.clip_id) == key)
            assert [c for _, c in own] == list(range(1, len(own) + 1))


def test_gap_cues_same_with_split_keys_and_order_by_start(spark):
    df = spark.createDataFrame(talk(3, 300), COLUMNS).where("project_id is not null and clip_id is not null")
    want = sorted(map(tuple, segment.gap_cues(df).collect()))
    splits = plan_splits(df, list(segment.CLIP), "pos", hot_share=0.01)
    assert splits is not None and sorted(map(tuple, segment.gap_cues(df, splits=splits).collect())) == want
    assert sorted(map(tuple, segment.gap_cues(df, order=["s_us", "pos"]).collect())) == want


def test_a_null_text_is_no_part_of_the_cue_text(spark):
    df = spark.createDataFrame([("p", 1, 0, 0, 100, "a"), ("p", 1, 1, 200, 300, None), ("p", 1, 2, 400, 500, "c")], COLUMNS)
    assert [(r.n_words, r.text) for r in segment.gap_cues(df).collect()] == [(3, "a c")]


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Window"), df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_words_are_shuffled_once(spark):
    w = spark.createDataFrame(talk(), COLUMNS)
    assert shuffles(segment.simple_cues(w)) == (0, 1)
    assert shuffles(segment.gap_cues(w)) == (1, 2)


def test_programme_cues_post_words_once_under_short_segments(spark):
    placed = "project_id long, pos long, clip_id long, in_us long, out_us long, speed int, start_us long"
    w = spark.createDataFrame([(1, 0, 0, 300_000, "a"), (1, 1, 400_000, 700_000, "b."), (2, 0, 0, 900_000, "c")], "clip_id long, pos long, s_us long, e_us long, text string")
    segs = spark.createDataFrame([(7, 1, 1, 0, 1_000_000, 1, 0), (7, 2, 2, 0, 1_000_000, 1, 1_000_000), (8, 1, 1, 400_000, 1_000_000, 1, 0)], placed)
    got = sorted((r.project_id, r.s_us, r.e_us, r.n_words, r.text) for r in reports.programme_cues(segs, w).collect())
    assert got == [(7, 0, 1_900_000, 3, "a b. c"), (8, 0, 1_000_000, 1, "b.")]
    roles = lambda s: layout.words_on_segments(s, w, heard=False)._jdf.queryExecution().optimizedPlan().toString().count("3600000000")
    long_ = spark.createDataFrame([(7, 1, 1, 0, 7_200_000_000, 1, 0)], placed)
    assert roles(segs) < roles(long_)
    assert {r.text for r in layout.words_on_segments(long_, w, heard=False).collect()} == {"a", "b."}
