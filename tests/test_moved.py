"""What leaves a task: words, sentences and word sets stay where their clip lies, or go out once and small."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dailies.operators import catalogue, dedupe, joins, reports, resolve, segment, upgrade
from dailies.operators.ordered import plan_splits
from dailies.workload import assembly_queries, catalogue_queries, layout_queries, report_queries, text_queries


@pytest.fixture
def tables(tmp_path):
    rows = {"doc_id": list(range(40)), "text": [f"One two {i}. Three three four five! Six {i} " * (i % 4) for i in range(39)] + [None], "lang": ["en"] * 40, "source": ["a", "b"] * 20}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.fixture
def large(spark):
    """No side is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_narration_never_move(large, tables):
    plan = physical(report_queries.clean_narration(large, tables))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_words_know_their_sentence(spark, tables):
    from dailies.workload.adapter import transcripts

    t = transcripts(spark, tables)
    want = segment.split_sentences(t).select("clip_id", "n", F.explode(F.sequence("first", "last")).alias("pos"))
    got = segment.sentence_words(t)
    assert sorted(map(tuple, got.select("clip_id", "n", "pos").collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in got.where("clip_id = 1").orderBy("pos").select("n", "pos", "s_us", "e_us", "text").take(2)] == [(1, 0, 0, 300_000, "One"), (1, 1, 400_000, 700_000, "two")]


WORDS = "project_id long, clip_id long, n long, pos long, s_us long, e_us long, text string"
ODD_WORDS = [(1, 1, 1, 0, 0, 10, "a"), (1, 1, 1, 1, 10, 20, "b"), (1, 1, 1, 1, 90, 99, "b"), (1, 1, 2, 2, 20, 30, "c"), (1, 1, 2, 3, 25, 25, "d"), (1, 1, None, None, 12, 18, "e"), (None, 1, 1, 0, 10, 20, "f"), (1, 2, 1, 0, 10, 20, "g"), (1, 1, 3, 4, None, 15, "h")]
ODD_CUTS = [(1, 1, 10, 20), (1, 1, 20, 20), (1, 1, None, 99), (None, 1, 0, 99), (1, 2, 20, 30), (1, 1, 24, 26)]


def test_narration_of_odd_words(spark):
    """A word goes with its copies; what touches a cut at its ends stays; nulls meet nothing."""
    words = spark.createDataFrame(ODD_WORDS, WORDS)
    cuts = spark.createDataFrame(ODD_CUTS, "project_id long, clip_id long, s_us long, e_us long")
    dropped = spark.createDataFrame([(1, 2, 1), (1, 1, None), (None, 1, 1), (1, 1, 3), (1, 1, 3)], "project_id long, clip_id long, n long")
    assert sorted(r.text for r in reports._cut_marked(words, cuts, ["project_id", "clip_id"]).where("__cut").collect()) == ["b", "b", "c"]
    assert sorted(r.text for r in reports._drop_marked(words, dropped, ["project_id", "clip_id"]).where("__dropped").collect()) == ["g", "h"]
    got = reports.clean_narration(words.where("pos IS NOT NULL AND s_us IS NOT NULL"), dropped, cuts)
    assert sorted((r.clip_id, r.n, r.s_us, r.e_us) for r in got.collect()) == [(1, 1, 0, 10), (1, 2, 25, 450_025)]


def test_words_without_cuts_never_move(large, tables):
    plan = physical(report_queries.without_cuts(large, tables))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_cuts_of_odd_words(spark):
    words = spark.createDataFrame(ODD_WORDS, WORDS)
    cuts = spark.createDataFrame(ODD_CUTS, "project_id long, clip_id long, s_us long, e_us long")
    got = reports.without_cuts(words, cuts, ["project_id", "clip_id"])
    assert got.columns == words.columns and sorted(r.text for r in got.collect()) == ["a", "d", "e", "f", "g", "h"]


def test_takes_of_a_clip_never_move(large, tables):
    for query in (text_queries.superseded_takes, text_queries.repeats_of_first_take):
        plan = physical(query(large, tables))
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_COL" not in plan


SENTENCES = "project_id long, clip_id long, ord long, sentence_id string, text string, instruction boolean"


def alike(a, b, percent):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) * 100 >= len(a | b) * percent


def odd_sentences(n=60):
    words = ["take", "one", "two", "three", "four", "five"]
    rows = [(1 + i % 2, 7, i, f"7#{i}", " ".join(words[(i * 7 + k * k) % 6] for k in range(1 + i % 5)), i % 11 == 0) for i in range(n)]
    return rows + [rows[5], rows[8], (None, 7, 900, "n", "one two", False), (None, 7, 901, "m", "one two", False), (1, 7, 902, "e", "...", False), (1, 7, 903, "u", None, False), (1, 7, None, "o", "one two", False)]


def test_takes_equal_a_plain_walk(spark):
    rows = odd_sentences()
    usable = [r for r in rows if r[0] is not None and not r[5] and r[4] and r[4] != "..." and r[2] is not None]
    late = sorted((r[0], r[2], r[3]) for r in usable if any(q[0] == r[0] and q[2] > r[2] and alike(r[4], q[4], 60) for q in usable))
    gone = []
    for p in (1, 2):
        kept = []
        for o, s, t in sorted({(r[2], r[3], r[4]) for r in usable if r[0] == p}):
            if any(alike(t, k, 60) for k in kept):
                gone += [(p, o, s)] * sum(r[0] == p and r[2] == o for r in usable)
            else:
                kept.append(t)
    df = spark.createDataFrame(rows, SENTENCES)
    scope = ["project_id", "clip_id"]
    assert late and sorted((r.project_id, r.ord, r.sentence_id) for r in dedupe.superseded_takes(df, scope).collect()) == late
    assert gone and sorted((r.project_id, r.ord, r.sentence_id) for r in dedupe.repeats_of_first_take(df, scope).where("ord IS NOT NULL").collect()) == sorted(gone)


def test_word_sets_go_by_number(large, tables):
    """The words of a set lay in every shuffle after the pairs were found."""
    out = dedupe.near_duplicates(text_queries.sentences(large, tables))
    steps = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" not in x]
    assert steps and not any("key#" in x for x in steps)


def test_near_duplicates_equal_a_plain_search(spark):
    rows = [r for r in odd_sentences(160) if r[2] is not None and r[0] is not None and r[4]]
    rows = sorted({r[:1] + r[2:] for r in rows}, key=lambda r: r[1])
    usable = [r for r in rows if len(set(r[3].split())) >= 3]
    want = set()
    for p, o, _, t, _ in usable:
        later = [q for q in usable if q[0] == p and q[1] > o and not q[4] and alike(t, q[3], 70)]
        want |= {(p, o, min(later, key=lambda q: q[1])[2])} if later else set()
    df = spark.createDataFrame(rows, "project_id long, ord long, sentence_id string, text string, instruction boolean")
    sets = dedupe.with_word_sets(df, ["project_id"], 3)
    for splits in (None, plan_splits(df, ["project_id"], "ord"), plan_splits(sets, ["project_id", "key"], "ord")):
        got = dedupe.near_duplicates(df, min_words=3, splits=splits).collect()
        assert want and len(got) == len(want) and {(r.project_id, r.ord, r.duplicate_of) for r in got} == want


def test_instructions_are_flagged_where_sentences_lie(large, tables):
    plan = physical(catalogue_queries.flag_instructions(large, tables))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    joined = catalogue_queries.retake_pointers(large, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in joined[: joined.index("Union")] and "__reach" in joined  # sentences outside all attempts do not go out


def test_instruction_flags_of_odd_sentences(spark):
    rows = [(1, 1, 1, 0, 10, "a"), (1, 1, 2, 10, 20, "b"), (1, 1, 2, 90, 99, "b"), (1, 1, 3, 20, 30, "c"), (None, 1, 1, 10, 20, "d"), (1, 1, None, 10, 20, "e"), (1, 1, 4, 12, 12, "f")]
    sents = spark.createDataFrame(rows, "project_id long, clip_id long, n long, s_us long, e_us long, text string")
    spans = spark.createDataFrame([(1, 1, 10, 20), (1, 1, 25, 25), (None, 1, 0, 50), (1, 1, None, 50)], "project_id long, clip_id long, s_us long, e_us long")
    got = sorted((r.text, r.instruction) for r in catalogue.flag_instructions(sents, spans).collect())
    assert got == [("a", False), ("b", True), ("b", True), ("c", False), ("d", False), ("e", False), ("f", False)]


def test_folded_words_never_move(large, tables):
    for query in (text_queries.repeated_grams, text_queries.grown_repeats):
        plan = physical(query(large, tables))
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
        assert "size(filter(zip_with" not in plan[plan.index("REPARTITION_BY_NUM"):]  # no length is asked before


def test_seeds_and_takes_stay_in_their_project(spark):
    """Clips are met by clip alone; a clip's number may occur in two projects, and null ids meet nothing."""
    toks = "x a b c d e y a b c d e z".split()
    rows = [(p, 1, [(i * 400_000, i * 400_000 + 300_000, t) for i, t in enumerate(w)]) for p, w in (("p", toks), ("q", toks[::-1] + ["w"] * 9), (None, toks), ("r", toks[:7]))]
    df = spark.createDataFrame(rows, "project_id string, clip_id bigint, words array<struct<s_us:bigint,e_us:bigint,text:string>>")
    docs = dedupe.folded_words(df)
    seeds = dedupe.repeated_grams(docs)
    grown = sorted((r.project_id, r.a, r.b, r.len) for r in dedupe.grown_repeats(docs, seeds).select("project_id", "a", "b", "len").distinct().collect())
    assert [g for g in grown if g[0] == "p"] == [("p", 1, 7, 5)] and {g[0] for g in grown} == {"p", "q"}
    takes = dedupe.take_groups(docs, seeds).collect()
    assert sorted((r.first, r.last, r.s_us, r.e_us, r.hint) for r in takes if r.project_id == "p") == [(1, 5, 400_000, 2_300_000, "a b c d e"), (7, 11, 2_800_000, 4_700_000, "a b c d e")]
    assert {r.project_id for r in takes} == {"p", "q"} and len(takes) == len({(r.project_id, r.first, r.last) for r in takes})


def test_rows_within_reach_of_spans(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a"), (1, 9, 21, "b"), (1, 25, 25, "c"), (1, 45, 49, "d"), (2, 0, 9, "e"), (None, 0, 9, "f"), (1, None, 9, "g"), (1, -7, -3, "h")], "k long, x long, y long, t string")
    spans = spark.createDataFrame([(1, 12, 18), (1, 40, 40), (1, 41, 42), (2, None, 9), (None, 0, 9), (1, -9, -8)], "k long, s long, e long")
    found, longest = joins.within_reach(rows, spans, "k", ("x", "y"), bin_us=10)
    assert sorted(r.t for r in found.collect()) == ["b", "d", "h"] and longest == 12
    met = lambda df: sorted((r.t, r.s) for r in joins.interval_join(df, spans.withColumnRenamed("k", "kk").withColumn("k", F.col("kk")).drop("kk"), ["k"], ("x", "y"), ("s", "e")).collect())
    assert met(found) == met(rows) == [("b", 12)]


def test_spans_without_an_end_reach_as_they_do_in_the_join(spark):
    rows = spark.createDataFrame([(1, 5, 8, "a"), (1, 15_000_000, 15_300_000, "b"), (1, 59_000_000, 59_300_000, "c"), (1, 61_000_000, 61_300_000, "d"), (1, 3_000_000, None, "e"), (2, 5, None, "f"), (1, 1_000_000_000, 3_000_000_000, "g")], "k long, x long, y long, t string")
    spans = spark.createDataFrame([(1, 7, None), (1, 65_000_000, 66_000_000)], "k long, s long, e long")
    met = lambda df, **kw: sorted((r.t, r.s) for r in joins.interval_join(spans, df, ["k"], ("s", "e"), ("x", "y"), **kw).collect())
    found, longest = joins.within_reach(rows, spans, "k", ("x", "y"))
    assert ("c", 7) in met(rows) and ("g", 7) in met(rows) and met(found, right_us=longest) == met(rows)


def test_words_beside_all_segments_are_left_out_first(spark):
    """What joins words with segments reads those within reach, not the documents."""
    d = "/root/testdata/sf0.001"
    for query in (layout_queries.segment_local_speech, catalogue_queries.cut_boundaries, catalogue_queries.boundary_flag_counts, report_queries.moments, assembly_queries.plan_assembly):
        files = query(spark, d).inputFiles()
        assert files and not any("documents.parquet" in f for f in files)


BEATS = "project_id long, pos long, uid string, kind string, clip_id long, sents array<struct<n:long,known:boolean,instruction:boolean>>, first_word long, last_word long, first_us long, last_us long, dur_us long, seg_in long, seg_out long, a0 long, a1 long, shots array<struct<clip:long,in_us:long,out_us:long,point_us:long,limit_us:long>>"


def spoken_beat(project, pos, *numbers, instruction=False):
    at = pos * 10_000_000 if pos is not None else 0
    return (project, pos, f"{project}-{pos}", "speech", 7, [(n, n < 50, instruction) for n in numbers], 10 * numbers[0], 10 * numbers[-1] + 9, at, at + 900_000, 99_000_000, at, at + 1_000_000, at, at + 900_000, [])


def test_beats_go_out_by_project_once(large):
    rows = [spoken_beat(1, 0, 1, 2), spoken_beat(1, 1, 2, 3), spoken_beat(1, 2, 4, 6), spoken_beat(1, 3, 99), spoken_beat(2, 0, 2, 3), spoken_beat(None, 0, 99), spoken_beat(2, 1, 5, instruction=True), spoken_beat(2, None, 98)]
    out = resolve.resolve_beats(large.createDataFrame(rows, BEATS))
    got = sorted((r.project_id or 0, -1 if r.pos is None else r.pos, r.error or "") for r in out.collect())
    # errors are told by project and position: a null in them is told nothing
    assert got == [(0, 0, ""), (1, 0, ""), (1, 1, "sentence_reused"), (1, 2, "sentences_not_contiguous"), (1, 3, "unknown_sentence"), (2, -1, ""), (2, 0, ""), (2, 1, "instruction_sentence")]
    assert "collect_list(__e" in out._jdf.queryExecution().optimizedPlan().toString()  # errors are laid beside the beats, not joined


def test_pickups_go_out_by_project_once(large):
    segs = large.createDataFrame([(1, 1, 0, 2_000_000), (1, 2, 2_000_000, 5_000_000), (None, 1, 0, 9_000_000), (2, 1, 0, 7_000_000_000)], "project_id long, pos long, start_us long, end_us long")
    pickups = large.createDataFrame([(1, 1, 500_000, 1_000_000), (1, 1, 500_000, 1_000_000), (1, 2, 1_500_000, None), (1, 3, 9_000_000, 9_500_000), (None, 1, 0, 900_000), (1, None, 2_000_000, 4_000_000), (2, 1, 10, 6_000_000_000)], "project_id long, item long, at_us long, end_us long")
    outs = [upgrade.claim_pickups(segs, pickups, written=w) for w in (False, True)]
    met = [sorted(((r.project_id or 0), (r.item or 0), [u.pos for u in r.under]) for r in upgrade.pickups_over_segments(segs, pickups, written=w).collect()) for w in (False, True)]
    assert met[0] == met[1] == [(0, 1, []), (1, 0, []), (1, 1, [1, 1]), (1, 1, [1, 1]), (1, 2, []), (1, 3, []), (2, 1, [1])]
    assert sorted(map(str, outs[0].collect())) == sorted(map(str, outs[1].collect()))
    assert not any("Exchange" in x and "island" in x for x in physical(outs[0]).split("\n"))


def test_both_ends_of_a_cue_are_looked_up_together(spark):
    beats = spark.createDataFrame([(1, 1, 0, 2_000_000), (1, 2, 2_000_000, 5_000_000), (1, 3, 6_000_000, 9_000_000), (1, 4, 0, 0)], "project_id long, n long, start_us long, end_us long")
    rows = [(1, 1, 0, 5_000_000), (1, 2, 1_800_000, 4_000_000), (1, 3, 5_200_000, 5_400_000), (1, 3, 5_200_000, 5_400_000), (1, 4, 20_000_000, 21_000_000), (2, 1, 0, 1), (None, 1, 0, 1), (1, 5, 4_900_000, 6_100_000), (1, None, 7_000_000, 8_000_000)]
    out = upgrade.cues_on_beats(spark.createDataFrame(rows, "project_id long, item long, s_us long, e_us long"), beats)
    got = sorted((r.project_id or 0, r.item or 0, r["first"] or 0, r["last"] or 0, r.approx) for r in out.collect())
    assert got == [(0, 1, 0, 0, False), (1, 0, 3, 3, False), (1, 1, 1, 2, False), (1, 2, 2, 2, True), (1, 3, 3, 3, False), (1, 3, 3, 3, False), (1, 4, 3, 3, False), (1, 5, 2, 3, False), (2, 1, 0, 0, False)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6  # ten before
