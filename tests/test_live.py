"""The live chain in a stream, restarted half-way, and transactions stopped after every step."""

import json

import numpy as np
import pytest

from echoweave.sources import transactions as T
from echoweave.streaming import live

CHUNKS = "job_id string, chunk_id long, frames array<double>, last boolean"


def hear(frames, cache):
    """A smoothed level, carried in the cache."""
    level, out = (np.frombuffer(cache)[0] if cache else 0.0), []
    for f in frames:
        level = 0.6 * level + 0.4 * f
        out.append(bool(level > 0.5))
    return out, np.array([level]).tobytes()


def recognise(frames):
    """A token for each tenth frame, named by the frames' sum."""
    return [(f"t{round(sum(frames[i : i + 10]), 3)}", i * 10, (i + 10) * 10) for i in range(0, len(frames) - 9, 10)]


def mark(tokens):
    return [3 if t.endswith(("7", "1")) else 2 if t.endswith("5") else 1 for t in tokens]


MODELS = live.Models(hear, recognise, mark)


def recordings(seed=3, jobs=("a", "b", "c")):
    rng, rows = np.random.default_rng(seed), []
    for j in jobs:
        level = np.repeat(rng.random(25) < 0.5, rng.integers(30, 260, 25)) * 0.9 + rng.random(1) * 0.05
        frames = np.round(level + rng.normal(size=len(level)) * 0.05, 3)
        cuts = [0, *sorted(rng.choice(len(frames), 12, replace=False).tolist()), len(frames)]
        rows += [(j, i, frames[a:b].tolist(), i == len(cuts) - 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return rows


def key(df):
    return sorted(tuple(r[c] for c in ("job_id", "pos", "token", "start_ms", "end_ms", "mark")) for r in df.collect())


def test_any_cut_into_chunks_gives_the_same_tokens():
    rows = recordings(5, ("a",))
    frames = [f for r in rows for f in r[2]]

    def run(size):
        chain, out = live.Chain(MODELS), []
        for at in range(0, len(frames), size):
            out += chain.add({"frames": frames[at : at + size], "last": at + size >= len(frames)})
            chain = live.Chain(MODELS).restore(*chain.state())
            assert len(chain.frames) < 2_000 + size
        return out

    whole = run(len(frames))
    assert len(whole) > 20 and run(37) == whole and run(400) == whole
    assert [r["pos"] for r in whole] == list(range(len(whole)))


def test_live_transcripts_equal_one_batch_run_after_a_restart(spark, tmp_path):
    rows = recordings()
    batch = key(live.transcripts(spark.createDataFrame(rows, CHUNKS), MODELS))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(2):  # the second run starts from the first one's checkpoint
            for chunk in range(part * 7, part * 7 + 7):
                spark.createDataFrame([r for r in rows if r[1] == chunk], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) if any(r[1] == chunk for r in rows) else None
            stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
            q = live.live_transcripts(stream, MODELS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.set(provider, before)
    assert key(spark.read.parquet(str(tmp_path / "out"))) == batch and len(batch) > 50


class StopError(Exception):
    pass


def stopping_at(n):
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == n:
            raise StopError(name)

    return step, seen


def state_of(files, names):
    return {n: files.read(n) if files.exists(n) else None for n in names}


def test_writes_happen_together_wherever_they_stop(spark, tmp_path):
    names = ["a/result.json", "b.json", "gone.json", "new.json"]
    old = {"a/result.json": b"old a", "b.json": b"old b", "gone.json": b"x", "new.json": None}
    new = {"a/result.json": b"new a", "b.json": b"new b", "gone.json": None, "new.json": json.dumps({"v": 1}).encode()}
    outcomes, n = set(), 0
    while True:
        n += 1
        root = str(tmp_path / f"w{n}")
        files = T.Files(spark, root)
        for name, content in old.items():
            if content is not None:
                files.write(name, content)
        step, seen = stopping_at(n)
        try:
            T.write_together(spark, root, {k: v for k, v in new.items() if v is not None}, ["gone.json"], step)
            break
        except StopError:
            # a crash while recovering is settled by the next recovery
            again, _ = stopping_at(2)
            try:
                T.Transaction(files, again, files.names(T.FOLDER)[0]).recover() if files.names(T.FOLDER) else None
            except StopError:
                pass
            outcomes |= set(T.recover(spark, root).values())
            assert state_of(files, names) in (old, new), seen[-1]
            assert not files.names(T.FOLDER)
            committed = any(s.startswith(("put aside", "publish", "remove", "clean up")) for s in seen)
            assert state_of(files, names) == (new if committed else old), seen[-1]
    assert n > 10 and outcomes <= {"finished", "undone"} and state_of(T.Files(spark, root), names) == new


def test_deletions_of_files_and_folders(spark, tmp_path):
    for n in range(1, 9):
        root = str(tmp_path / f"d{n}")
        files = T.Files(spark, root)
        files.write("x.json", b"x")
        files.write("table", spark.range(3))
        step, seen = stopping_at(n)
        stopped = True
        try:
            T.delete_together(spark, root, ["x.json", "table", "never"], step)
            stopped = False
        except StopError:
            T.recover(spark, root)
        there = (files.exists("x.json"), files.exists("table"))
        assert there in ((True, True), (False, False)) and (stopped or there == (False, False)), seen


def test_tables_and_bad_names(spark, tmp_path):
    root = str(tmp_path / "t")
    T.write_together(spark, root, {"rows": spark.range(5), "about.json": b"{}"})
    assert spark.read.parquet(f"{root}/rows").count() == 5 and T.recover(spark, root) == {}
    for name in ("../x", "/x", "", f"{T.FOLDER}/x"):
        with pytest.raises(ValueError):
            T.write_together(spark, root, {name: b""})
