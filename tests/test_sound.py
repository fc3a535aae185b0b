"""Borrowed sound and audible windows, computed by hand."""

from dailies.operators import catalogue, layout

SEGMENTS = "project_id bigint, pos bigint, clip_id bigint, in_us bigint, out_us bigint, speed int, muted boolean, start_us bigint, end_us bigint, sound_clip_id bigint, sound_in_us bigint, sound_out_us bigint, heard_in_us bigint, heard_out_us bigint"
S = 1_000_000


def placed(spark):
    rows = [
        (1, 1, 1, 0, 4 * S, 1, False, 0, 4 * S, None, None, None, None, None),  # heard as it is
        (1, 2, 1, 4 * S, 8 * S, 2, False, 4 * S, 6 * S, 2, 10 * S, 14 * S, 11 * S, 13 * S),  # sound of clip 2, its middle only, twice as fast
        (1, 3, 2, 0, 2 * S, 1, True, 6 * S, 8 * S, 1, 0, 2 * S, None, None),  # muted
        (1, 4, 1, 0, 2 * S, 1, False, 8 * S, 10 * S, None, None, None, 5 * S, 6 * S),  # window outside: nothing is heard
    ]
    return spark.createDataFrame(rows, SEGMENTS)


def words(spark):
    rows = [(1, 0, 1 * S, 2 * S, "one"), (1, 1, 5 * S, 6 * S, "shown"), (2, 0, 10 * S, 11 * S, "before"), (2, 1, 12 * S, 14 * S, "borrowed"), (2, 2, 0, S, "muted")]
    return spark.createDataFrame(rows, "clip_id bigint, pos bigint, s_us bigint, e_us bigint, text string")


def test_words_follow_the_sound(spark):
    got = {(r.pos, r.clip_id, r.text, r.s_us, r.e_us) for r in layout.words_on_segments(placed(spark), words(spark)).collect()}
    assert got == {(1, 1, "one", S, 2 * S), (2, 2, "borrowed", 5 * S, 5_500_000)}
    seen = {(r.pos, r.text) for r in layout.words_on_segments(placed(spark), words(spark), heard=False).collect()}
    assert seen == {(1, "one"), (2, "shown"), (3, "muted"), (4, "one")}


def test_segments_without_sound_columns_are_heard_as_their_picture(spark):
    plain = placed(spark).drop("sound_clip_id", "sound_in_us", "sound_out_us", "heard_in_us", "heard_out_us")
    got = {(r.pos, r.text) for r in layout.words_on_segments(plain, words(spark)).collect()}
    assert got == {(1, "one"), (2, "shown"), (4, "one")}


def test_local_ranges_and_windows(spark):
    mutes = spark.createDataFrame([(2, 1, 13 * S, 20 * S), (1, 2, 5 * S, 7 * S)], "clip_id bigint, mute bigint, s_us bigint, e_us bigint")
    local = {(r.pos, r.mute, r.s_us, r.e_us) for r in layout.local_ranges(placed(spark), mutes, "mute").collect()}
    assert local == {(2, 1, 1_500_000, 2 * S)}
    shown = {(r.pos, r.mute, r.s_us, r.e_us) for r in layout.mutes_in_programme(placed(spark), mutes, "mute").collect()}
    assert shown == {(2, 2, 4_500_000, 5_500_000)}
    windows = {(r.pos, r.clip_id, r.s_us, r.e_us) for r in layout.audible_windows(placed(spark)).collect()}
    assert windows == {(2, 2, 500_000, 1_500_000), (4, 1, 5 * S, 5 * S)}


def test_boundaries_go_by_the_sound(spark):
    rows = [
        (1, 1, 1, 0, 4 * S, 1, False, 0, 4 * S, None, None, None, None, None),
        (1, 2, 7, 0, 2 * S, 1, False, 4 * S, 6 * S, 1, 4 * S, 6 * S, None, None),  # another picture over the same sound going on: no boundary
        (1, 3, 1, 6 * S, 8 * S, 1, False, 6 * S, 8 * S, 2, 12 * S, 14 * S, None, None),
    ]
    got = {(r.pos, r.last_word, r.first_word, r.in_margin_us) for r in catalogue.cut_boundaries(spark.createDataFrame(rows, SEGMENTS), words(spark)).collect()}
    assert got == {(2, "shown", "borrowed", 0)}
