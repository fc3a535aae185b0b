"""Work on words is dealt out, done once, and linear in a clip."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dailies.functions.text import fold_token
from dailies.operators import dedupe, segment
from dailies.operators.layout import words_on_segments
from dailies.workload import adapter, layout_queries
from dailies.workload.adapter import segments, transcripts, words
from dailies.workload.assembly_queries import plan_tables
from dailies.workload.layout_queries import speech_geometry
from dailies.workload.resolve_queries import cut_beats


@pytest.fixture
def tables(tmp_path):
    rows = {"doc_id": list(range(40)), "text": [f"One two {i}. Three four five! Six {i}" if i % 9 else " " for i in range(39)] + [None], "lang": ["en"] * 40, "source": ["a", "b"] * 20}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_one_row_group_is_read_by_several_tasks(spark, tables):
    for rows in (words(spark, tables), transcripts(spark, tables)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert transcripts(spark, tables).count() == 40


def test_order_lines_take_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(100).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(str, segments(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(adapter, "TASK_LINES", 10)
    lines = segments(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 10 and sorted(map(str, lines.collect())) == want


def test_words_of_a_clip_stay_in_one_task(spark, tables, tmp_path, monkeypatch):
    for module in (adapter, layout_queries):
        monkeypatch.setattr(module, "TASK_DOCUMENTS", 5)
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(20).write.parquet(f"{tables}/events.parquet")
    placed = words(spark, tables).select("clip_id", F.spark_partition_id().alias("p"))
    assert placed.distinct().count() == placed.select("clip_id").distinct().count() and placed.rdd.getNumPartitions() == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        plan = speech_geometry(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # documents and events move once, words never


def test_only_words_between_first_and_last_use_of_a_clip_are_posted(spark):
    segs = spark.createDataFrame([(1, 1, 7, 100, 200, 1, 0, False), (1, 2, 7, 300, 350, 1, 100, False), (2, 1, 8, 0, 10, 1, 0, False)], "project_id bigint, pos bigint, clip_id bigint, in_us bigint, out_us bigint, speed int, start_us bigint, muted boolean")
    spoken = spark.createDataFrame([(7, i, i * 50, i * 50 + 50, f"w{i}") for i in range(12)] + [(9, 0, 0, 50, "x")], "clip_id bigint, pos bigint, s_us bigint, e_us bigint, text string")
    got = words_on_segments(segs, spoken, heard=False)
    assert sorted((r.project_id, r.pos, r.word, r.s_us, r.e_us) for r in got.collect()) == [(1, 1, 2, 0, 50), (1, 1, 3, 50, 100), (1, 2, 6, 100, 150)]
    endless = words_on_segments(segs.where("pos = 2").withColumn("out_us", F.lit(None).cast("bigint")), spoken, heard=False)  # to the end of its bin
    assert sorted(r.word for r in endless.collect()) == [6, 7, 8, 9, 10, 11]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_split_once_for_their_readers(spark, tables, tmp_path):
    assert not any(f.endswith("documents.parquet") for f in cut_beats(spark, tables).inputFiles())
    for name in ("events", "part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(20).write.parquet(f"{tables}/{name}.parquet")
    catalogue = plan_tables(spark, tables)[3]
    assert not any(f.endswith("documents.parquet") for f in catalogue.inputFiles())


def test_words_are_taken_by_position(spark, tables):
    clips = transcripts(spark, tables)
    split = segment.split_sentences(clips)
    grams = dedupe.repeated_grams(dedupe.folded_words(clips))
    for df in (split, grams):
        assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in split.where("clip_id = 1").orderBy("n").select("n", "first", "last", "text").collect()]
    assert got == [(1, 0, 2, "One two 1."), (2, 3, 5, "Three four five!"), (3, 6, 7, "Six 1")]
    assert split.where("clip_id % 9 = 0 or clip_id = 39").count() == 0


def test_folding_a_clip_as_one_text_equals_folding_its_words(spark):
    odd = ["Ósmy", "ΣΑΣ", "İstanbul", "one", None, "a\x01b", "½", "№5", "ﬁn", "...", "\x01", "𝐀𝐁", "Straße", "", "x²", "ONE"]
    clips = [odd, odd[:4], [w for w in odd if w and "\x01" not in w], [w for w in odd if w is None or w.isascii() and "\x01" not in w], ["ΣΑΣ", None, "𝐀𝐁 Ç", "zażółć"], [None, "a\x01b"], []]
    rows = [("p", i, [(j, j + 1, t) for j, t in enumerate(c)]) for i, c in enumerate(clips)]
    df = spark.createDataFrame(rows, "project_id string, clip_id bigint, words array<struct<s_us:bigint,e_us:bigint,text:string>>")
    got = dedupe.folded_words(df).select("clip_id", F.inline("folded")).select("clip_id", "tok", "s_us", "e_us", "text")
    want = df.select("clip_id", F.inline("words")).select("clip_id", fold_token(F.col("text")).alias("tok"), "s_us", "e_us", "text").where("tok <> ''")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_seeds_of_a_clip_grow_beside_its_words(spark):
    toks = "x a b c d e y a b c d e z".split()
    rows = [("p", 1, [(t, i * 10, i * 10 + 5, t) for i, t in enumerate(toks)])]
    docs = spark.createDataFrame(rows, "project_id string, clip_id bigint, folded array<struct<tok:string,s_us:bigint,e_us:bigint,text:string>>")
    seeds = dedupe.repeated_grams(docs)
    assert sorted((r.a, r.b, r.len, r.seed) for r in dedupe.grown_repeats(docs, seeds).collect()) == [(1, 7, 5, 1), (1, 7, 5, 2)]
