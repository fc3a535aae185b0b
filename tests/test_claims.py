"""Claims and cards against plain walks over each project, on chains that all overlap."""

import random

import pytest

from dailies.operators import resolve

BEATS = "project_id long, pos long, kind string, clip_id long, sents array<struct<n:bigint,known:boolean,instruction:boolean>>, first_word long, last_word long"


def plain_errors(rows):
    sentences, words, out = set(), {}, {}
    for p, pos, kind, clip, sents, first, last in sorted(rows, key=lambda r: (r[0], r[1])):
        if kind == "broll":
            continue
        error = None
        for n, known, instruction in sents:
            error = "unknown_sentence" if not known else "instruction_sentence" if instruction else "sentence_reused" if (p, clip, n) in sentences else None
            if error:
                break
        if error is None and any(b[0] != a[0] + 1 for a, b in zip(sents, sents[1:])):
            error = "sentences_not_contiguous"
        if error is None:
            sentences.update((p, clip, s[0]) for s in sents)
            taken = words.setdefault((p, clip), [])
            if first is not None and any(first <= b and last >= a for a, b in taken):
                error = "words_reused"
            elif first is not None:
                taken.append((first, last))
        if error:
            out[p, pos] = error
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for pos in range(900):
        project = 1 if rng.random() < 0.8 else rng.randint(2, 4)
        lo, size = rng.randint(1, 160), rng.choice([0, 1, 1, 2, 3, 4])
        numbers = [lo + i + (i == 2 and rng.random() < 0.2) for i in range(size)]
        sents = [(n, n % 29 != 0, n % 31 == 0) for n in numbers]
        first = None if rng.random() < 0.2 else lo * 5 + rng.randint(-3, 3)
        rows.append((project, pos, rng.choice(["speech", "speech", "speech", "broll"]), rng.randint(1, 3), sents, first, None if first is None else first + 5 * size))
    got = {(r.project_id, r.pos): r.error for r in resolve.claim_errors(spark.createDataFrame(rows, BEATS)).collect()}
    want = plain_errors(rows)
    assert got == want and len(set(want.values())) == 5


def test_first_fit_reduces_copies_and_restarts(spark):
    rows = [(1, 5, 10, 20), (1, 9, 10, 20), (1, 7, 20, 30), (1, 8, 21, 30), (1, 1, 40, 40), (2, 3, 10, 20)]
    df = spark.createDataFrame(rows, "k long, o long, lo long, hi long")
    got = sorted((r.k, r.o) for r in resolve.first_fit(df, ["k"], "o", "lo", "hi").collect())
    assert got == [(1, 1), (1, 5), (1, 8), (2, 3)]


def plain_cards(rows, gap, least, opening, ending, offset):
    out, rows = [], sorted(rows)
    total = max(r[3] for r in rows)
    end = max(opening, total - ending)
    shown, active, entered = {}, "?", False
    for i, (p, pos, s, e, place, cutaway) in enumerate(rows):
        if not opening <= s < end:
            active = place
            continue
        if not entered:
            active, entered = "?", True
        if place is None or place == active:
            active = place
            continue
        if cutaway:
            continue
        active = place
        if s - shown.get(place, -(10**18)) < gap:
            continue
        for _, pos2, s2, e2, place2, _ in rows[i:]:
            if s2 >= end or place2 != place:
                break
            if e2 - s2 >= least:
                shown[place] = s2 + offset
                out.append((p, pos, place, pos2, s2 + offset))
                break
    return out


def test_cards_are_those_of_a_walk(spark):
    rng, rows, at = random.Random(3), [], 0
    for pos in range(1500):
        length = rng.choice([1, 2, 3, 4]) * 700_000
        rows.append((1, pos, at, at + length, rng.choice(["a", "b", "c", None]), rng.random() < 0.2))
        at += length
    df = spark.createDataFrame(rows, "project_id long, pos long, s_us long, e_us long, place string, cutaway boolean")
    for gap in (9_000_000, 1):
        got = sorted(tuple(r) for r in resolve.location_cards(df, min_gap_us=gap, least_us=1_500_000).collect())
        want = plain_cards(rows, gap, 1_500_000, 10_000_000, 15_000_000, 400_000)
        assert got == [(p, pos, place, t, a) for p, pos, place, t, a in want] and len(want) > 100


def test_cards_of_nothing(spark):
    df = spark.createDataFrame([], "project_id long, pos long, s_us long, e_us long, place string, cutaway boolean")
    assert resolve.location_cards(df).collect() == []


GEOMETRY = BEATS + ", first_us long, last_us long, dur_us long, seg_in long, seg_out long, a0 long, a1 long, uid string, shots array<struct<clip:long,in_us:long,out_us:long,point_us:long,limit_us:long>>"


def plain_resolve(rows, frame=33_333):
    """The walk over a project in order: what each beat reports, and its pieces once the next take met it."""
    errors, out, prev, project = plain_errors([r[:7] for r in rows]), {}, None, None
    for r in sorted(rows, key=lambda r: r[:2]):
        p, pos, kind, clip, _, _, _, first, last, dur, seg_in, seg_out, a0, a1, _, shots = r
        if p != project:
            project, prev = p, None
        if kind == "broll" or (p, pos) in errors:
            out[p, pos] = (errors.get((p, pos)), None, None if kind != "broll" else [(clip, seg_in, seg_out, None)])
            prev = None
            continue
        joined = None
        if prev and prev[1] == clip and 0 <= first - prev[2] < 750_000:
            meet, tail = (prev[2] + first) // 2, prev[3]
            cut = tail["audio_out"] - meet
            if tail["out_us"] - cut - tail["in_us"] >= frame:
                joined = seg_in = a0 = meet
                tail["out_us"] -= cut
                tail["audio_out"] = meet
        pieces = resolve._lay_out(clip, seg_in, seg_out, [dict(zip(("clip", "in_us", "out_us", "point_us", "limit_us"), s)) for s in shots], dur, 800_000)
        out[p, pos] = (None, joined, pieces)
        prev = (p, clip, last, pieces[-1]) if pieces else None
    flat = lambda ps: [x if isinstance(x, tuple) else (x["clip"], x["in_us"], x["out_us"], x["audio_out"]) for x in ps or []]
    return {k: (e, j, flat(ps)) for k, (e, j, ps) in out.items()}


def test_resolved_beats_are_those_of_a_walk(spark):
    rng, rows, at = random.Random(8), [], 1_000_000
    for pos in range(600):
        at += rng.choice([0, 100_000, 300_000, 700_000, 760_000, 2_000_000])
        first, last = at, at + rng.choice([20_000, 400_000, 1_500_000, 3_000_000])
        at = last
        shots = [(9, 0, 1_000_000, first + 100_000, 1_300_000)] if rng.random() < 0.3 else []
        n = pos if rng.random() < 0.9 else max(1, pos - 1)
        rows.append((1 if pos < 500 else 2, pos, rng.choice(["speech"] * 9 + ["broll"]), 1 if rng.random() < 0.9 else 2, [(n, True, False)], n * 10, n * 10 + 5, first, last, 10**10, first - 300_000, last + 450_000, first - 100_000, last + 100_000, f"u{pos}", shots))
    got = {
        (r.project_id, r.pos): (r.error, r.joined_us, [(p.clip, p.in_us, p.out_us, p.audio_out) for p in r.pieces])
        for r in resolve.resolve_beats(spark.createDataFrame(rows, GEOMETRY)).collect()
    }
    want = plain_resolve(rows)
    assert got == want and sum(j is not None for _, j, _ in want.values()) > 50
