"""Readers, writers, models as stages, and streams against their batch forms."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoweave.operators import folds, frames
from echoweave.sources import audio, documents, inference
from echoweave.streaming import segments


def test_wav_to_frames(spark, tmp_path):
    for name, rate in (("a", 16_000), ("b", 8_000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((1, 2, rate, 0, "NONE", ""))
            w.writeframes((np.sin(np.arange(rate * 2) * 0.1) * 9000).astype("<i2").tobytes())
    chunks = audio.read_recordings(spark, str(tmp_path), 50)
    got = frames.fbank_frames(chunks).groupBy("job_id").agg(F.count("*").alias("n"), F.max("frame_id").alias("last")).collect()
    assert [(r.n, r["last"]) for r in got] == [(198, 197)] * 2
    assert {round(r.seconds, 3) for r in audio.probe_durations(spark, str(tmp_path)).collect()} == {2.0}
    assert audio.total_size(spark, str(tmp_path)).first().bytes > 96_000


def test_result_documents(spark, tmp_path):
    doc = {"job_id": "j", "audio_path": "/a", "segments": [{"segment_id": 1, "start_ms": 0, "end_ms": 5, "speaker_label": "s", "raw_text": "t"}], "merged_results": [{"merge_id": 1, "raw_content": "t"}]}
    (tmp_path / "j.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    got = documents.read_documents(spark, str(tmp_path)).where("job_id is not null").first()
    assert got.segments[0].included_in_preview is True and got.merged_results[0].cleaned_content == "" and got.merged_results[0].was_llm_failure is False


def test_atomic_write_and_recovery(spark, tmp_path):
    path = str(tmp_path / "t")
    documents.write_atomic(spark.range(3), path)
    documents.write_atomic(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and documents.recover(spark, path) == "complete"
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert documents.recover(spark, path) == "restored" and spark.read.parquet(path).count() == 5
    assert documents.recover(spark, str(tmp_path / "none")) == "absent"


def test_side_files(spark, tmp_path):
    (tmp_path / "mvn").write_text("<AddShift> 2 2\n<LearnRateCoef> 0 [ -1.5 2 ]\n<Rescale> 2 2\n<LearnRateCoef> 0 [ 0.5 4 ]\n")
    assert tuple(documents.affine_table(spark, str(tmp_path / "mvn")).first()) == ([-1.5, 2.0], [0.5, 4.0])
    (tmp_path / "v.json").write_text('["<unk>", "a", "b", "a"]')
    assert {r.token: r.id for r in documents.vocabulary(spark, str(tmp_path / "v.json")).collect()} == {"<unk>": 0, "a": 1, "b": 2}


def test_models_are_stages(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k long, x array<double>")
    got = inference.infer(df, ["k"], "x", lambda: lambda x: x.sum(1, keepdims=True), (2,))
    assert sorted((r.k, r.output) for r in got.collect()) == [(1, [3.0]), (2, [7.0])]
    with pytest.raises(Exception, match="isn't finite"):
        inference.infer(df, ["k"], "x", lambda: lambda x: x / 0.0 - x / 0.0, (2,)).collect()

    def call(p):
        if p == "b":
            raise TimeoutError("slow")
        return p.upper()

    got = inference.remote(spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string"), ["k"], "p", call).orderBy("k").collect()
    assert [(r.answer, r.error) for r in got] == [("A", None), (None, "TimeoutError: slow")]


def test_live_segments_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    flags = {j: np.repeat(rng.random(30) < 0.5, 25).tolist() for j in ("a", "b")}
    rows = [(j, i, f) for j, v in flags.items() for i, f in enumerate(v)]
    batch = folds.endpoint_segments(spark.createDataFrame(rows, "job_id string, frame_id long, is_speech boolean"))
    schema = "job_id string, frame_id long, is_speech boolean"
    for k in range(4):
        part = [r for r in rows if r[1] * 4 // 750 == k] + ([(j, 750, None) for j in flags] if k == 3 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = segments.live_segments(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.job_id, r.segment_id, r.start_ms, r.end_ms) for r in d.collect())
    assert key(spark.table("live")) == key(batch) and batch.count() > 2


def test_progress_stream(spark, tmp_path):
    schema = "job_id string, ordinal long, end_ms long"
    for part in ([("j", 0, 10), ("j", 2, 30)], [("j", 1, 20)], [("j", 4, 50)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    q = segments.progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, i: seen.extend(tuple(r) for r in df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [("j", 1, 10), ("j", 3, 30), ("j", 3, 30)]


def test_settings_are_the_owners_own(spark, tmp_path):
    path = str(tmp_path / "conf" / "settings.json")
    assert documents.load_settings(spark, path) == {}
    first = {"glossary": ["雅冬"], "cleanup": {"chunkChars": 5}}
    documents.save_settings(spark, path, first)
    documents.save_settings(spark, path, first | {"queue": {"autoStart": True}})
    assert documents.load_settings(spark, path) == first | {"queue": {"autoStart": True}}
    assert (tmp_path / "conf" / "settings.json").stat().st_mode & 0o777 == 0o600
    assert documents.read_documents(spark, path, "settings").first().glossary == ["雅冬"]
    (tmp_path / "conf" / "settings.json").rename(tmp_path / "conf" / "settings.json.staging")  # stopped between the two steps
    assert documents.load_settings(spark, path)["queue"] == {"autoStart": True}
    with pytest.raises(ValueError):
        documents.save_settings(spark, path, {"colour": 1})
