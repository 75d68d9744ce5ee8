"""Audio by byte ranges, other rates, and files that were once read or written wrongly."""

import struct

import numpy as np
import pytest

from passerine.sources import audio, files


def write(path, x, rate, kind="<i2", junk=0, form=b"RIFF"):
    """A WAV file by hand: x is frames x channels in [-1, 1]; junk bytes come before the samples."""
    scale = {"<i2": 32767, "<f4": 1, "u1": 127}[kind]
    data = (x * scale + (128 if kind == "u1" else 0)).astype(kind).tobytes()
    width = np.dtype(kind).itemsize
    fmt = struct.pack("<HHIIHH", 3 if kind == "<f4" else 1, x.shape[1], rate, rate * x.shape[1] * width, x.shape[1] * width, width * 8)
    large = struct.pack("<4sIQQQI", b"ds64", 28, 0, len(data), len(x), 0) if form == b"RF64" else b""
    size = 0xFFFFFFFF if large else len(data)
    path.write_bytes(form + struct.pack("<I", 36) + b"WAVE" + large + b"fmt " + struct.pack("<I", 16) + fmt + b"JUNK" + struct.pack("<I", junk) + bytes(junk + junk % 2) + b"data" + struct.pack("<I", size) + data)


def tone(hz, rate, seconds):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)[:, None] * 0.5


@pytest.mark.parametrize("kind", ["<i2", "<f4", "u1"])
def test_kinds_of_samples(spark, tmp_path, kind):
    write(tmp_path / "a.wav", np.hstack([tone(100, 8000, 1), tone(100, 8000, 1) * 0]), 8000, kind, junk=70_001, form=b"RF64")
    got = np.array(audio.read_audio(spark, str(tmp_path), 8000).first()["samples"])
    assert np.allclose(got, tone(100, 8000, 1)[:, 0] / 2, atol=0.01)


def test_what_is_above_the_new_nyquist_frequency_is_gone(spark, tmp_path):
    for name, hz in (("high", 15_000), ("low", 3_000), ("edge", 9_500)):
        write(tmp_path / f"{name}.wav", tone(hz, 48_000, 1), 48_000)
    got = {r["audio_id"]: np.array(r["samples"]) for r in audio.read_audio(spark, str(tmp_path), 22_050).collect()}
    assert len(got["low"]) == 22_050
    assert np.abs(got["high"][200:-200]).max() < 1e-3
    want = 0.5 * np.sin(2 * np.pi * 3000 * np.arange(22_050) / 22_050)
    assert np.abs(got["low"] - want)[200:-200].max() < 1e-3
    assert 0.49 < np.abs(got["edge"][200:-200]).max() < 0.51


def test_pieces_are_the_whole(spark, tmp_path):
    rng = np.random.default_rng(3)
    write(tmp_path / "n.wav", rng.uniform(-0.5, 0.5, (44_100 * 5 + 17, 1)), 44_100)
    (tmp_path / "empty").mkdir()
    write(tmp_path / "empty" / "none.wav", np.zeros((0, 1)), 8000)
    whole = {r["audio_id"]: np.array(r["samples"]) for r in audio.read_audio(spark, str(tmp_path), 22_050).collect()}
    pieces = audio.read_pieces(spark, str(tmp_path), 22_050, 2).orderBy("start").collect()
    assert [(r["audio_id"], r["start"]) for r in pieces] == [("n", 0.0), ("n", 2.0), ("n", 4.0)] and len(whole["none"]) == 0
    joined = np.concatenate([r["samples"] for r in pieces])
    assert np.allclose(joined[: len(whole["n"])], whole["n"], atol=1e-6)


def test_file_beyond_two_gigabytes(spark, tmp_path):
    """A window at the end of a sparse file of 2.2 GB: only its bytes are read."""
    write(tmp_path / "long.wav", np.zeros((1, 1)), 8000, form=b"RF64")
    frames, path = 1_100_000_000, tmp_path / "long.wav"
    data = path.read_bytes()
    at = data.index(b"ds64") + 16
    with path.open("r+b") as f:
        f.write(data[:at] + struct.pack("<Q", frames * 2) + data[at + 8 :])
        f.seek(data.index(b"data") + 8 + (frames - 8000) * 2)
        f.write((tone(440, 8000, 1)[:, 0] * 32767).astype("<i2").tobytes())
    windows = spark.createDataFrame([("long", frames / 8000 - 1, frames / 8000 + 1)], "audio_id string, start double, end double")
    got = np.array(audio.read_audio(spark, str(tmp_path), 8000, windows).first()["samples"])
    assert len(got) == 16_000 and np.allclose(got[:8000], tone(440, 8000, 1)[:, 0], atol=1e-3) and not got[8000:].any()


def test_no_wav_file(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no WAV file"):
        audio.read_audio(spark, str(tmp_path)).collect()


def test_each_csv_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("audio_id,confidence\nx,0.5\n")
    (tmp_path / "b.csv").write_text('\ufeffconfidence,"audio_id",extra\n0.8,y,"more, yet"\n0.9,z\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("audio_id,confidence\n")
    got = files.read_csv(spark, str(tmp_path))
    assert got.columns == ["audio_id", "confidence", "extra", "source_csv", "source_row"]
    assert {tuple(r)[:3] for r in got.collect()} == {("x", "0.5", ""), ("y", "0.8", "more, yet"), ("z", "0.9", "")}


def test_no_csv_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path)).collect() == []


def test_write_once_after_a_crash(spark, tmp_path):
    (tmp_path / "t" / "_temporary").mkdir(parents=True)
    assert files.write_once(spark.range(3), str(tmp_path / "t")) and not files.write_once(spark.range(9), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
