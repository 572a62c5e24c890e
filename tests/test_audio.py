"""Decoding and resampling: formats, tones, chunks against the whole."""

import struct

import numpy as np
import pytest

from echoweave.sources import audio


def wav(x, rate, bits=16, floating=False, channels=1, extensible=False, extra=b""):
    x = np.repeat(np.asarray(x)[:, None], channels, 1)
    if floating:
        raw = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        raw = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        raw = np.round(x * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        raw = np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    align, kind = channels * bits // 8, 3 if floating else 1
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * align, align, bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + bytes(14)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tone(hz, rate, seconds=1.0):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("bits,floating,extensible", [(8, False, False), (16, False, False), (24, False, True), (32, False, False), (32, True, False), (64, True, True)])
@pytest.mark.parametrize("channels", [1, 2])
def test_formats(bits, floating, extensible, channels):
    x = tone(440, 16_000, 0.1)
    data = wav(x, 16_000, bits, floating, channels, extensible, b"LIST" + struct.pack("<I", 3) + b"abc\0")
    got, rate = audio.decode(data)
    assert rate == 16_000 and np.abs(got - x).max() < (0.01 if bits == 8 else 1e-4)
    assert audio.header(data[:200], len(data)).seconds == pytest.approx(0.1)


def test_broken_headers():
    for data in (b"", b"RIFF0000AVI ", wav([0.1], 8000)[:30], wav([0.1], 8000).replace(b"\x01\x00\x01\x00", b"\x02\x00\x01\x00", 1)):
        with pytest.raises(ValueError):
            audio.header(data)
    never_filled = wav(tone(9, 8000), 8000)
    at = never_filled.index(b"data") + 4
    assert audio.header(never_filled[:at] + b"\xff\xff\xff\xff" + never_filled[at + 4 :]).frames == 8000


@pytest.mark.parametrize("rate", [8_000, 11_025, 22_050, 44_100, 48_000])
def test_tones_pass_and_nothing_folds_back(rate):
    middle = slice(1_000, 15_000)
    kept = audio.resample(tone(1_000, rate), rate)
    assert len(kept) == 16_000 and np.abs(kept - tone(1_000, 16_000))[middle].max() < 2e-3
    if rate > 20_000:
        gone = audio.resample(tone(rate * 0.4 if rate < 40_000 else 12_000, rate), rate)
        assert np.abs(gone)[middle].max() < 1e-3  # above half of 16 kHz
    assert audio.resample(np.ones(rate), rate)[middle] == pytest.approx(np.ones(14_000), abs=1e-12)


@pytest.mark.parametrize("rate", [8_000, 16_000, 44_100, 48_000])
def test_pieces_equal_the_whole(rate):
    x = np.random.default_rng(1).normal(size=30_000)
    whole, n = audio.resample(x, rate), len(x)
    for lo, hi in ((0, 50), (37, 4_000), (len(whole) - 900, len(whole)), (0, len(whole))):
        a, z = audio.needed(lo, hi, n, rate)
        assert np.array_equal(audio.resample(x[a:z], rate, lo=lo, hi=hi, first=a, n=n), whole[lo:hi])
    assert len(audio.resample(np.zeros(0), rate)) == 0


def test_a_long_file_is_many_rows(spark, tmp_path):
    x = np.concatenate([tone(500, 48_000, 1.2), tone(11_000, 48_000, 1.1)])
    (tmp_path / "a.wav").write_bytes(wav(x, 48_000, 24, channels=2))
    (tmp_path / "short.wav").write_bytes(wav(x[:300], 48_000))
    rows = sorted(audio.read_recordings(spark, str(tmp_path), 50, 5).collect(), key=lambda r: r.chunk_no)
    whole = audio.resample(*audio.decode((tmp_path / "a.wav").read_bytes())).astype(np.float32)
    frames = (len(whole) - 400) // 160 + 1
    assert [r.first_frame for r in rows] == list(range(0, frames, 50)) and len(rows) > 4
    for r in rows:
        assert np.array_equal(np.array(r.samples, np.float32), whole[r.first_frame * 160 :][: len(r.samples)])
    assert np.abs(whole[21_000:36_000]).max() < 1e-3
    assert {round(r.seconds, 4) for r in audio.probe_durations(spark, str(tmp_path)).collect()} == {2.3, round(300 / 48_000, 4)}
