"""Block source on small files: byte ranges of any size give the blocks of the whole file."""

import numpy as np
import pytest

from dailies.operators.media import audio_blocks
from dailies.sources.audio import register_audio, wav_bytes


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("wav"), np.random.default_rng(5)
    mono, stereo = rng.integers(-32768, 32767, 1_234), rng.integers(-3000, 3000, (777, 2))
    (folder / "a.wav").write_bytes(wav_bytes(mono, 8_000))
    (folder / "sub").mkdir()
    odd = wav_bytes(stereo, 44_100)
    longer = (int.from_bytes(odd[4:8], "little") + 12).to_bytes(4, "little")
    (folder / "sub" / "b.WAV").write_bytes(odd[:4] + longer + odd[8:36] + b"LIST\x03\x00\x00\x00abc\x00" + odd[36:])
    (folder / "cut.wav").write_bytes(wav_bytes(mono, 8_000)[:-11])
    (folder / "empty.wav").write_bytes(wav_bytes(mono[:0], 8_000))
    (folder / "none.wav").write_bytes(b"")
    (folder / "text.wav").write_bytes(b"no sound here, only text" * 9)
    (folder / "notes.txt").write_bytes(b"x")
    return folder


def rows(spark, folder, **options):
    register_audio(spark)
    df = spark.read.format("wav_blocks").options(**options).load(str(folder))
    return df, sorted((r.path.rsplit("/", 1)[1], r.block, r.s_us, r.e_us, r.n, round(r.sum_sq, 9), r.lo, r.hi) for r in df.collect())


def test_ranges_give_the_blocks_of_whole_files(spark, files):
    _, whole = rows(spark, files)
    for split in (1_000, 333):
        df, got = rows(spark, files, split_bytes=split)
        assert got == whole and df.rdd.getNumPartitions() > 5
    names = {"a.wav": 1_234, "b.WAV": 777, "cut.wav": 1_228}
    assert {n: sum(r[4] for r in whole if r[0] == n) for n in {r[0] for r in whole}} == names
    raw = spark.createDataFrame([("a.wav", (files / "a.wav").read_bytes()), ("b.WAV", (files / "sub" / "b.WAV").read_bytes())], "clip_id string, content binary")
    want = sorted((r.clip_id, r.block, r.s_us, r.e_us, r.n, round(r.sum_sq, 9), r.lo, r.hi) for r in audio_blocks(raw).collect())
    assert [r for r in whole if r[0] != "cut.wav"] == want
    assert [r[4] for r in whole if r[0] == "a.wav"][-1] == 1_234 % 80


def test_no_files(spark, tmp_path):
    assert rows(spark, tmp_path)[1] == []
