"""Noise levels and what is heard around a boundary, against plain walks, and how often their words are shuffled."""

import math
import random

from dailies.operators import catalogue, media


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_noise_levels_match_plain_union_of_overlapping_words(spark):
    rng, words, blocks = random.Random(3), [], []
    for clip in range(12):
        for _ in range(rng.choice([3, 5, 30])):
            s = rng.randrange(0, 40) * 250_000
            words += [(clip, s, s + rng.choice([-100_000, 0, 250_000, 900_000]))] * rng.choice([1, 2])
        blocks += [(clip, rng.randrange(0, 50) * 250_000, rng.randrange(1, 900), 1_000) for _ in range(40)]
    words.append((None, 0, 500_000))
    blocks += [(None, 0, 5, 1_000), (3, None, 5, 1_000)]
    w = spark.createDataFrame(words, "clip_id long, s_us long, e_us long")
    b = spark.createDataFrame([(c, s, s and s + 250_000, q, n) for c, s, q, n in blocks], "clip_id long, s_us long, e_us long, sum_sq long, n long")
    want = {}
    for clip in range(12):
        own = [(s, e) for c, s, e in words if c == clip]
        if len(own) < 4:
            continue
        w0, w1 = max(min(s for s, _ in own) - 1_000_000, 0), max(e for _, e in own) + 1_000_000
        said = {t for s, e in own for t in range(s, e, 50_000)}
        gaps = set(range(w0, w1, 50_000)) - said
        level = lambda at: next((max(-90.0, round(10 * math.log10(q / n), 2)) for q, n in [[sum(x[i] for x in blocks if x[0] == clip and x[1] in at) for i in (2, 3)]] if n), -90.0)
        heard = [x for x in blocks if x[0] == clip and x[1] is not None and x[1] in said | gaps]
        if heard and min(len(said), len(gaps)) * 50_000 >= 500_000:
            want[clip] = (len(said) * 50_000, len(gaps) * 50_000, level(said), level(gaps))
    levels = media.noise_levels(w, b)
    assert exchanges(levels) <= 2
    assert {r.clip_id: (r.speech_us, r.gap_us, r.speech_db, r.gap_db) for r in levels.collect()} == want and want


def test_render_context_matches_plain_search(spark):
    rng = random.Random(4)
    words = [(rng.choice([1, 2, None]), s, s + rng.choice([0, 200_000, 6_000_000, -300_000])) for s in (rng.randrange(0, 200) * 100_000 for _ in range(60))]
    points = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, *range(0, 25_000_000, 130_000)])) for i in range(80)]
    points += points[:5]
    w, b = spark.createDataFrame(words, "clip_id long, s_us long, e_us long"), spark.createDataFrame(points, "query long, clip_id long, at_us long")
    want = []
    for q, clip, at in points:
        own = [(s, e) for c, s, e in words if c == clip] if at is not None else []
        be = max((e for _, e in own if e <= at + 50_000), default=None)
        starts = min((s for s, _ in own if s >= at - 50_000), default=None)
        gap = starts - be if be is not None and starts is not None and be > at - 2_500_000 and starts < at + 2_500_000 else None
        want.append((q, clip, at, gap, clip is not None and any(s < at - 80_000 and e > at + 80_000 for s, e in own), gap is not None and gap < 350_000))
    got = catalogue.render_context(b, w, ["clip_id"], "at_us")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "Window" not in got._jdf.queryExecution().sparkPlan().toString()
