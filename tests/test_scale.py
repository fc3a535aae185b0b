"""Plans that stay small and steps that do not fall apart on many keys or large tables."""

from pyspark.sql import functions as F

from dailies.operators import dedupe, reports, upgrade
from dailies.operators.joins import interval_join
from dailies.sources import audio
from dailies.sources import documents as docs
from dailies.workload import source_queries


def test_clip_numbers_query_runs(spark):
    """The query names everything it uses; the first known file has number 2 plus the project's parity."""
    d = "/root/testdata/sf0.001"
    rows = source_queries.assign_clip_numbers(spark, d).where("NOT is_new").groupBy("project_id").min("number").collect()
    assert rows and all(n == 2 + p % 2 for p, n in rows)


def test_new_clips_take_free_numbers(spark):
    files = spark.createDataFrame([(1, 7, 10), (1, 8, 20), (1, 9, 30)], "project_id long, source_file long, recorded long")
    registry = spark.createDataFrame([(1, 8, 1)], "project_id long, source_file long, number long")
    got = docs.assign_clip_numbers(files, registry).collect()
    assert sorted((r.source_file, r.position, r.number, r.is_new) for r in got) == [(7, 1, 2, True), (8, 2, 1, False), (9, 3, 3, True)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_computed_once_for_the_picture(spark):
    """The fold over pickups stood four times in the plan of their picture."""
    segs = spark.createDataFrame([(1, 1, 5, 0, 2_000_000, 0, 2_000_000), (1, 2, 6, 0, 3_000_000, 2_000_000, 5_000_000)], "project_id long, pos long, clip_id long, in_us long, out_us long, start_us long, end_us long")
    pickups = spark.createDataFrame([(1, 1, 500_000, 1_000_000), (1, 2, 1_500_000, 4_000_000), (1, 3, 9_000_000, 9_500_000)], "project_id long, item long, at_us long, end_us long")
    out = upgrade.claimed_picture(segs, upgrade.claim_pickups(segs, pickups))
    assert plan(out).count("MapInArrow") == 1
    got = sorted((r.pos, r.s_us, r.e_us, r.item, r.pic_in_us, r.pic_out_us) for r in out.collect())
    assert got == [
        (1, 0, 500_000, None, 0, 500_000), (1, 500_000, 1_000_000, 1, 500_000, 1_000_000), (1, 1_000_000, 1_500_000, None, 1_000_000, 1_500_000),
        (1, 1_500_000, 2_000_000, 2, 1_500_000, 2_000_000), (2, 2_000_000, 4_000_000, 2, 0, 2_000_000), (2, 4_000_000, 5_000_000, None, 2_000_000, 3_000_000),
    ]


def test_small_sound_files_share_a_task(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.wav").write_bytes(audio.wav_bytes([i, -i, 2 * i], 1_000))
    audio.register_audio(spark)
    df = spark.read.format("wav_blocks").option("block_ms", 10).option("split_bytes", 1 << 20).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    assert sorted((r.n, r.hi) for r in df.collect()) == [(3, 2.0 * i) for i in range(40)]


def test_short_side_needs_no_posting_for_long_ones(spark):
    left = spark.createDataFrame([(1, i, i * 40_000_000, i * 40_000_000 + 1_000_000) for i in range(60)], "k long, l long, s long, e long")
    right = spark.createDataFrame([(1, 0, 0, 2_000_000_000), (1, 1, 100_000_000, 300_000_000), (1, 2, 80_000_000, 80_000_001), (1, 3, 0, 9_000_000_000)], "k long, r long, rs long, re long")
    join = lambda **kw: sorted((x.l, x.r) for x in interval_join(left, right, ["k"], ("s", "e"), ("rs", "re"), **kw).collect())
    assert join(left_us=1_000_000) == join()
    turned = lambda **kw: sorted((x.l, x.r) for x in interval_join(right, left, ["k"], ("rs", "re"), ("s", "e"), **kw).collect())
    assert turned(right_us=1_000_000) == turned() == join()


def test_narration_reads_its_words_twice(spark):
    """Words that go are marked; the stream is not joined with itself again (it stood three times in the plan)."""
    words = spark.createDataFrame([(1, 1, i // 3, i, i * 400_000, i * 400_000 + 300_000, t) for i, t in enumerate(["a", "a", "b", "c-", "d", "e", "f", "f", "g"])], "project_id long, clip_id long, n long, pos long, s_us long, e_us long, text string")
    dropped = spark.createDataFrame([(1, 1, 1)], "project_id long, clip_id long, n long")
    cuts = spark.createDataFrame([(1, 1, 3_000_000, 3_300_000)], "project_id long, clip_id long, s_us long, e_us long")
    out = reports.clean_narration(words, dropped, cuts)
    assert plan(out).count("LogicalRDD") <= 2 * 4
    assert sorted((r.n, r.s_us, r.e_us) for r in out.collect()) == [(1, 0, 300_000), (2, 800_000, 1_100_000), (3, 2_400_000, 3_150_000)]


def test_similar_sets_carry_numbers_not_keys(spark):
    sets = spark.createDataFrame([(1, "a b c d"), (1, "a b c e"), (1, "x y z w"), (2, "a b c d"), (None, "a b c d")], "project_id long, key string").withColumn("toks", F.split("key", " "))
    out = dedupe.similar_sets(sets, ["project_id"], percent=60)
    assert [(r.project_id, r.key, r.key_b) for r in out.collect()] == [(1, "a b c d", "a b c e")]
    grouped = [line for line in plan(out).split("\n") if "collect_list" in line]
    assert grouped and all("key#" not in line for line in grouped)
