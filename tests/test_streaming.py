"""Streams fed from files; a later row of another key moves the watermark on."""

import datetime as dt

import pytest

from dailies.operators import ledger
from dailies.sources import sinks
from dailies.streaming import stateful

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(spark, tmp_path, batches, schema, build, name, mode="append"):
    src = str(tmp_path / "in")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_admission_stream(spark, tmp_path):
    data = [(1, 3, at(3), 50, 100), (1, 1, at(1), 60, 100), (1, 2, at(2), 70, 100), (1, 4, at(4), 40, 100)]
    batches = [data[:2], data[2:], [(2, 9, at(9000), 1, 10)], [(2, 10, at(20000), 1, 10)], [(2, 11, at(30000), 1, 10)]]
    out = run(spark, tmp_path, batches, "project_id long, charge long, ts timestamp, usd_micro long, cap_micro long", stateful.admit_stream, "adm")
    assert {r.charge: r.accepted for r in out if r.project_id == 1} == {1: True, 2: False, 3: False, 4: True}


def test_sentence_stream(spark, tmp_path):
    text = ["Hello", "there.", "And", "on"]
    words = [(1, i, at(i * 0.4), i * 400_000, i * 400_000 + 300_000, t) for i, t in enumerate(text)]
    later = [[(2, 0, at(s), 0, 1, "x")] for s in (1000, 2000, 3000)]
    out = run(spark, tmp_path, [words[2:], words[:2], *later], "clip_id long, pos long, ts timestamp, s_us long, e_us long, text string", stateful.sentence_stream, "sen")
    assert sorted((r.n, r.text) for r in out if r.clip_id == 1) == [(1, "Hello there."), (2, "And on")]


def test_status_stream(spark, tmp_path):
    rows = [[(1, "plan", 1, 1, "running")], [(1, "plan", 3, 3, "done")], [(1, "plan", 2, 2, "error")]]
    out = run(spark, tmp_path, rows, "clip_id long, stage string, ts long, event_id long, status string", stateful.status_stream, "sta", "complete")
    assert [(r.clip_id, r.stage, r.status) for r in out] == [(1, "plan", "done")]


def test_project_table_survives_replay(spark, tmp_path):
    schema, src, out, ck = "project_id long, item long, version long", str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck")
    write = sinks.versioned_projects(out)
    seen = []

    def batch(df, number):
        write(df, number)
        seen.append((df.collect(), number))

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ck).start()
        q.processAllAvailable()
        q.stop()

    def table():
        return sorted((r.project_id, r.item, r.version) for r in spark.read.parquet(out).collect())

    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    add([(1, 1, 1), (1, 2, 1), (2, 1, 1), (1, 1, 2)])
    go()
    assert table() == [(1, 1, 2), (2, 1, 1)]
    add([(2, 5, 3), (2, 6, 3), (3, 1, 1)])
    go()  # a new run from the checkpoint sees only the new file
    after = [(1, 1, 2), (2, 5, 3), (2, 6, 3), (3, 1, 1)]
    assert table() == after and [n for _, n in seen] == [0, 1]
    for rows, number in [*seen, seen[0]]:
        write(spark.createDataFrame(rows, schema), number)
        assert table() == after


def test_admission_restarts_from_its_checkpoint(spark, tmp_path):
    schema = "project_id long, charge long, ts timestamp, usd_micro long, cap_micro long"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def go(batches):
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = stateful.admit_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    go([[(1, 3, at(3), 50, 100), (1, 1, at(1), 60, 100)]])
    go([[(1, 2, at(2), 70, 100), (1, 4, at(4), 40, 100)], [(2, 9, at(9000), 1, 10)]])
    go([[(2, 10, at(20000), 1, 10)], [(2, 11, at(30000), 1, 10)]])
    got = [(r.charge, r.accepted) for r in spark.read.parquet(out).collect() if r.project_id == 1]
    charges = spark.createDataFrame([(1, 3, 50, 100), (1, 1, 60, 100), (1, 2, 70, 100), (1, 4, 40, 100)], "project_id long, charge long, usd_micro long, cap_micro long")
    batch = [(r.charge, r.accepted) for r in ledger.admit_charges(charges, ["project_id"], ["charge"]).collect()]
    assert sorted(got) == sorted(batch) == [(1, True), (2, False), (3, False), (4, True)]


def test_projects_share_folders_and_a_cut_off_write_is_finished(spark, tmp_path):
    out, schema = str(tmp_path / "table"), "project_id long, item long, version long"
    batch = lambda ids, v: spark.createDataFrame([(i, v, v) for i in ids], schema)
    table = lambda: sorted((r.project_id, r.version) for r in spark.read.parquet(out).collect())
    write = sinks.versioned_projects(out, buckets=4)
    write(batch(range(100), 1), 0)
    assert len([p for p in (tmp_path / "table").iterdir() if p.is_dir()]) == 4
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "table").iterdir() if p.is_dir()}
    write(batch([7], 2), 1)
    want = sorted([(i, 1) for i in range(100) if i != 7] + [(7, 2)])
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "table").iterdir() if p.is_dir()}
    assert table() == want and sum(after[k] != before[k] for k in before) == 1  # other folders are not written
    moved = next(k for k in before if after[k] != before[k])
    (tmp_path / "table" / "_next").mkdir()
    (tmp_path / "table" / moved).rename(tmp_path / "table" / "_next" / moved)  # broke off before the last move
    write(batch([7], 1), 2)
    assert table() == want
    with pytest.raises(ValueError):
        sinks.replace_projects(batch([7], 3), out, buckets=5)
