"""Cases that earlier versions got wrong, with results worked out by hand."""

from pyspark.sql import functions as F

from dailies.functions.text import fold_token
from dailies.operators import layout, ledger, reports, resolve
from dailies.operators.joins import interval_join

BIG = 2**53


def test_compatibility_forms_fold_to_ascii(spark):
    words = {"m²": "m2", "ﬁlm": "film", "Ｔram": "tram", "1½": "112", "½": "12", "Été!": "ete", "\U0001d400b": "ab"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.f for r in df.select("w", fold_token(F.col("w")).alias("f")).collect()} == words


def test_folds_keep_64_bits(spark):
    rows = [("p", BIG + i, i * 60_000_000, i) for i in (1, 3, 5)]
    df = spark.createDataFrame(rows, "project_id string, pos long, s_us long, item long")
    from dailies.operators.ordered import ordered_fold

    got = ordered_fold(df, ["project_id"], ["pos"], lambda: {"last": None}, lambda s, r: (s.update(last=r.pos) or r.pos, r.pos if r.item > 1 else None), "seen bigint; maybe bigint").collect()
    assert [(r.pos, r.seen, r.maybe) for r in sorted(got)] == [(BIG + 1, BIG + 1, None), (BIG + 3, BIG + 3, BIG + 3), (BIG + 5, BIG + 5, BIG + 5)]


def test_credits_are_walked_exactly(spark):
    rows = [("a", i, c, 100) for i, c in enumerate([90, 20, -15, 20])] + [("b", i, c, 100) for i, c in enumerate([60, 50, 40])] + [("c", 0, 50, 40), ("c", 1, 50, 60)]
    df = spark.createDataFrame(rows, "project_id string, i long, usd_micro long, cap_micro long")
    got = {(r.project_id, r.i): r.accepted for r in ledger.admit_charges(df, ["project_id"], ["i"]).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("a", 3): True, ("b", 0): True, ("b", 1): False, ("b", 2): True, ("c", 0): False, ("c", 1): True}


def test_captions_keep_their_least_length(spark):
    rows = [("p", 1, False, 0, 3_000_000), ("p", 2, False, 100_000, 2_000_000), ("p", 3, False, 2_020_000, 4_000_000), ("p", 4, False, 5_000_000, None)]
    df = spark.createDataFrame([(*r, 6_000_000) for r in rows], "project_id string, item long, subtitle boolean, s_us long, e_us long, total_us long")
    got = [(r.item, r.s_us, r.e_us) for r in sorted(resolve.plan_captions(df).collect(), key=lambda r: r.item)]
    assert got == [(1, 0, 400_000), (2, 100_000, 2_000_000), (3, 2_020_000, 4_000_000), (4, 5_000_000, 6_000_000)]


def test_two_marks_of_one_instant_and_the_call(spark):
    totals = spark.createDataFrame([("p", 100_000_000, None)], "project_id string, total_us long, cta_us long")
    beats = spark.createDataFrame([("p", "b1", 0), ("p", "b2", 20_000_000), ("p", "b3", 60_000_000)], "project_id string, beat string, start_us long")
    got = {(r.beat, r.label) for r in resolve.plan_markers(totals, beats, [("hook", 0), ("open", 0), ("hook", 1_000_000), ("end", -1)]).collect()}
    assert got == {("b1", "hook"), ("b1", "open"), ("b3", "end"), ("b2", "subscribe-cta")}


def test_chapters_follow_their_beats(spark):
    beats = spark.createDataFrame([("p", f"b{i}", s * 1_000_000) for i, s in enumerate([0, 30, 34, 50, 95])], "project_id string, beat string, start_us long")
    times = [(1, 31), (2, 32), (3, 35), (4, 55), (5, 97)]
    chapters = spark.createDataFrame([("p", i, t * 1_000_000, 100_000_000) for i, t in times], "project_id string, item long, at_us long, total_us long")
    got = sorted((r.item, r.beat) for r in resolve.thin_chapters(chapters, beats).collect())
    assert got == [(1, "b0"), (4, "b3")]


def test_narration_without_enough_footage_has_no_pieces(spark):
    rows = [("p", 0, 1, 0, 2_000_000, 3_000_000, 3_000_000), ("p", 1, 1, 0, 2_000_000, 5_000_000, 3_000_000), ("p", 2, 1, 0, 9_000_000, 5_000_000, 9_000_000)]
    df = spark.createDataFrame(rows, "project_id string, beat long, pos long, in_us long, out_us long, length_us long, clip_us long")
    assert sorted((r.beat, r.out_us) for r in layout.voice_shots(df).collect()) == [(0, 3_000_000), (2, 5_000_000)]
    assert [(r.beat, r.missing_us) for r in layout.uncovered_voice(df).collect()] == [(1, 3_000_000)]


def test_ending_phrases_of_checks_and_of_plans_differ(spark):
    caps = spark.createDataFrame([("p", i, 7_000_000, 9_500_000, t) for i, t in enumerate(["Do UsŁyszenia", "thanks for watching", "do zobaczenia"])], "project_id string, item long, s_us long, e_us long, text string")
    totals = spark.createDataFrame([("p", 10_000_000)], "project_id string, total_us long")
    notes = spark.createDataFrame([("p", 9, "see you soon")], "project_id string, item long, text string")
    assert [r.phrase.lower() for r in reports.ending_guard(caps.where("item < 2"), totals).collect()] == ["do usłyszenia"]
    assert sorted((r.place, r.item) for r in reports.plan_endings(caps, totals, notes).collect()) == [("caption", 1), ("caption", 2), ("notes", 9)]


def test_short_intervals_meet_only_in_fine_bins(spark):
    """Many short intervals of one key and hour: the join does not compare them all."""
    df = spark.range(3000).selectExpr("1 AS k", "id AS a", "id * 1000000 AS s", "id * 1000000 + 500000 AS e")
    other = df.selectExpr("k", "a AS b", "s + 100000 AS t", "e AS u")
    assert interval_join(df, other, ["k"], ("s", "e"), ("t", "u")).count() == 3000
